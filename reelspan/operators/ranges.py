"""Range joins that stay linear in long videos: an equi-join on key and time cell, then the exact bounds.

Cells come in levels, each 16 times as wide as the one below.  An interval lies at the lowest
level whose cells are as long as itself, so it touches two cells at most, however long it is: an
open end costs one more level, not a copy for each minute.  The other side is copied once to
each level that has intervals; these are asked for first (a small aggregate, at most 13 rows), unless
the caller knows about how long intervals are: then they lie at the levels up to that length, and longer
ones are cut into more pieces.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each level's cells are 2^STEP times as wide as those below; with cells of 60 s at level 0, level 12 is beyond any BIGINT.
STEP, LEVELS = 4, 13


def level_of(length: Column, width_ms: int) -> Column:
    """The lowest level whose cells are at least ``length`` (a DOUBLE) wide."""
    return reduce(lambda above, k: F.when(length <= float(width_ms << STEP * k), F.lit(k)).otherwise(above), reversed(range(LEVELS - 1)), F.lit(LEVELS - 1))


def cell(ms: Column, level: Column, width_ms: int) -> Column:
    """The cell of a time at a level: it never falls as the time grows, even where doubles round."""
    return F.floor(ms / (F.lit(float(width_ms)) * F.pow(F.lit(2.0), level * STEP)))


def _length(lo: Column, hi: Column) -> Column:
    return hi.cast("double") - lo.cast("double")  # open ends may be too far apart for BIGINT


def _present(levels: DataFrame) -> list[int]:
    return sorted(r[0] for r in levels.distinct().collect() if r[0] is not None)  # at most LEVELS


def _top(longest_ms: int, width_ms: int) -> int:
    return next((k for k in range(LEVELS) if longest_ms <= width_ms << STEP * k), LEVELS - 1)


def points_in(points: DataFrame, intervals: DataFrame, key: str, t: Column, lo: Column, hi: Column, width_ms: int = 60_000, longest_ms: int | None = None) -> DataFrame:
    """Points joined with the intervals of their key that hold them: lo <= t < hi.

    ``width_ms`` should be of the order of a usual interval's length, ``longest_ms``, if given, of the longest ones (results
    do not hang on either).  An interval has two copies at most, a point one for each level, and each pair meets once.
    Empty intervals hold nothing; a null time meets nothing.
    """
    level = level_of(_length(lo, hi), width_ms)
    own = intervals.where(lo < hi).withColumn("_level", level if longest_ms is None else F.least(level, F.lit(_top(longest_ms, width_ms))))
    levels = list(range(_top(longest_ms, width_ms) + 1)) if longest_ms is not None else _present(own.select("_level"))
    spread = own.withColumn("_cell", F.explode(F.sequence(cell(lo, F.col("_level"), width_ms), cell(hi - 1, F.col("_level"), width_ms))))
    asked = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels or [0])))).withColumn("_cell", cell(t, F.col("_level"), width_ms))
    return asked.join(spread, [key, "_level", "_cell"]).where((lo <= t) & (t < hi)).drop("_level", "_cell")


def touching(a: DataFrame, b: DataFrame, key: str, a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column, width_ms: int = 60_000) -> DataFrame:
    """Intervals of ``a`` and ``b`` of one key that have a point in common, both ends counted.

    A pair meets at the higher of its two levels, in the cell where the later one of the two starts, so once.  ``b`` should be the
    side with fewer rows: it is asked for its levels, and each of its rows is copied to its own level and all above; a row of ``a`` to its
    own level and those above that ``b`` has; to two cells of each at most.
    An interval that ends before it starts counts as the point where it starts if that lies in the other one.
    """
    one = a.withColumn("_a", level_of(_length(a_lo, F.greatest(a_lo, a_hi)), width_ms))
    two = b.withColumn("_b", level_of(_length(b_lo, F.greatest(b_lo, b_hi)), width_ms))
    there = F.array(*map(F.lit, _present(two.select("_b"))), F.lit(-1))
    every = F.array(*map(F.lit, range(LEVELS)))

    def spread(df: DataFrame, levels: Column, at: str, lo: Column, hi: Column) -> DataFrame:
        up = df.withColumn("_level", F.explode(levels)).withColumn(at, cell(lo, F.col("_level"), width_ms))
        return up.withColumn("_cell", F.explode(F.sequence(F.col(at), F.greatest(F.col(at), cell(hi, F.col("_level"), width_ms)))))

    up = F.array_append(F.filter(there, lambda k: k > F.col("_a")), F.col("_a"))
    both = spread(one, up, "_a_at", a_lo, a_hi).join(spread(two, F.filter(every, lambda k: k >= F.col("_b")), "_b_at", b_lo, b_hi), [key, "_level", "_cell"])
    meets = (F.col("_level") == F.greatest("_a", "_b")) & (F.col("_cell") == F.greatest("_a_at", "_b_at"))
    return both.where(meets & (a_hi >= b_lo) & (a_lo <= b_hi)).drop("_a", "_b", "_a_at", "_b_at", "_level", "_cell")
