"""Mixing sources to target weights over a time-varying curriculum.

Each source has a target in words and a weight schedule, piecewise linear over
training time 0 to 1.  A source's documents stand in a fixed shuffled order; the
words before a document, as a share of its source's target, are a cumulative
demand, and the inverse of the integrated schedule turns that demand into the
time at which the document is trained on.  Documents are then range-sorted by time.

Running sums never see a whole source: a source's rows are cut by hash into
buckets of about BUCKET_ROWS, bucket totals are summed first, and the sums inside
a bucket are its own.  Sums over the sources themselves go by ranges in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspan.llm.names import columns, fresh, quoted
from reelspan.llm.scratch import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Schedules of sources in turn, as (time, weight) knots: rising, level, falling.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.5), (1.0, 0.5)))
BUCKET_ROWS = 8192
#: Up to so many sources their table is broadcast (about 10 MB); above, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def time_of(demand: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which this share (0 to 1) of a schedule's integral is used."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        pieces.append((t0, t1, w0, w1, area))
        area += (w0 + w1) / 2 * (t1 - t0)
    if area <= 0:
        raise ValueError("a schedule needs some weight")
    out = None
    for t0, t1, w0, w1, before in reversed(pieces):
        rest = demand * area - before
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        time = F.when(rest <= 0, F.lit(t0)).otherwise(F.lit(t0) + rest * F.lit(2.0) / (F.lit(w0) + root))
        out = time if out is None else F.when(demand * area < before + (w0 + w1) / 2 * (t1 - t0), time).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """``source, place, rows, source_size, target`` from ``source, size``.

    Sources in code-point order, null last, take the weights in turn and share
    ``share`` times all words by weight.  No target passes ``most`` times its
    source's words; what is left over is shared again by weight until none does.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    out = running(sums.withColumn("one", F.lit(1).cast("bigint")), [F.asc_nulls_last("source")], {"place": "one"}).withColumn("place", F.col("place").cast("int")).drop("one")
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), (F.col("place") % len(weights)) + 1)
    out = out.withColumn("weight", weight).withColumn("most", F.col("source_size") * most)
    # By falling need of the cap: a source is capped if what is left for it and those after reaches its cap.
    out = running(out.withColumn("need", F.col("most") / F.col("weight")), [F.col("need").asc(), F.col("place").asc()], {"most_before": "most", "weight_before": "weight"})
    out = written(out, "mix-needs")
    total = out.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left = F.lit(share) * F.lit(total["size"] or 0) - F.col("most_before")
    level = out.agg(F.max(left / (F.lit(total["weight"] or 1) - F.col("weight_before"))).alias("level")).first()["level"]
    target = F.least(F.col("most").cast("double"), F.lit(level) * F.col("weight"))
    return out.select("source", "place", "rows", "source_size", target.alias("target"))


def running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``rows`` with sums of columns (name: column) over all rows before in ``order``, which must be strict; by ranges of it, so no task has all rows."""
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "mix-ranges")
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(c) for c in set(sums.values())])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    ahead = totals.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{name}") for name, c in sums.items()])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.join(F.broadcast(ahead), "_range")
    return found.withColumns({name: F.col(f"_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()}).drop("_range", *[f"_{name}" for name in sums])


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, schedules=SCHEDULES, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per document: ``doc_id, size, source, source_size, target, taken, positions``.

    ``taken`` is the words the mix takes, repeats counted: whole passes over the
    source and then, in an order fixed by a hash of the id, documents up to the
    target (the last of them in part).  ``positions`` are the training times (0 to 1)
    of the middle of the document in each pass that takes it.  Sources are ordered by
    code point, a null source is one more source, a null text has no words.  Rows
    that repeat an id are ordered by size; identical rows are interchangeable.
    Reruns agree.  Very long texts are counted whole; an empty table gives no rows; other columns are not read.
    """
    return _planned(docs, weights, share, most, schedules, text, id_col, source).drop("text_hash")


def _planned(docs: DataFrame, weights: Sequence[int], share: float, most: int, schedules, text: str, id_col: str, source: str) -> DataFrame:
    """What ``mixed`` returns, and ``text_hash``."""
    own = F.col(quoted(text))
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(source)).alias("source"), n_words(own).alias("size"), F.xxhash64(own).alias("text_hash"))
    rows = written(rows, "mix-sizes")
    rows = rows.withColumn("_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")))
    sources = written(source_targets(rows, weights, share, most), "mix-sources")
    few = sources.count() <= BROADCAST_SOURCES
    known = sources.withColumnRenamed("source", "_source")
    placed = rows.join(F.broadcast(known) if few else known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    buckets = F.ceil(F.col("rows") / BUCKET_ROWS)
    part = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("bigint") * buckets / F.lit(1 << 32)).cast("bigint")
    placed = placed.withColumn("_part", part)
    totals = placed.groupBy("place", "_part").agg(F.sum("size").alias("_total"))
    ahead = Window.partitionBy("place").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("place", "_part", F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("place", "_part").orderBy("_key", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(starts, ["place", "_part"]).withColumn("_before", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    wanted = F.floor(F.col("target") + 0.5).cast("bigint")
    passes = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.lit(0))
    rest = F.least(F.greatest(wanted - passes * F.col("source_size") - F.col("_before"), F.lit(0)), F.col("size"))
    placed = placed.withColumn("taken", passes * F.col("size") + rest)
    n = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    passes_of = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def time(c: Column) -> Column:
        words = F.least(F.col("size"), F.col("taken") - c * F.col("size"))
        demand = (c * F.col("source_size") + F.col("_before") + words / F.lit(2.0)) / wanted
        out = None
        for k, knots in enumerate(schedules):
            own, here = time_of(demand, knots), F.col("place") % len(schedules) == k
            out = F.when(here, own) if out is None else out.when(here, own)
        return out

    return placed.select("doc_id", "size", "source", "source_size", "target", "taken", F.transform(passes_of, time).alias("positions"), "text_hash")


def sequence(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, schedules=SCHEDULES, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """Whole documents in training order: the columns of ``docs``, a row for each time that a document is trained on.

    A document whose part of the last pass is under half its words is left out of
    that pass, otherwise it is taken whole; one without words (null and empty texts) has no row.
    Rows that repeat an id, source and text share one plan, the largest of theirs; reruns agree.
    Range-sorted by training time, ties by id.  Very long texts are one row; an empty table gives no
    rows; all columns are kept, whatever their names.
    """
    plan = _planned(docs, weights, share, most, schedules, text, id_col, source).where("taken > 0")
    plan = plan.groupBy("doc_id", "source", "text_hash").agg(F.max(F.struct("taken", "positions", "size")).alias("p"))
    times = plan.select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_hash").alias("_hash"), F.expr("slice(p.positions, 1, cast(floor(p.taken / p.size + 0.5) as int))").alias("_times")
    )
    hashed, time = fresh(docs, "hash", "time")
    rows = docs.withColumn(hashed, F.xxhash64(F.col(quoted(text)))).alias("d")
    same = F.col(f"d.{quoted(id_col)}").eqNullSafe(F.col("p._id")) & F.col(f"d.{quoted(source)}").eqNullSafe(F.col("p._source")) & (F.col(f"d.{quoted(hashed)}") == F.col("p._hash"))
    found = rows.join(times.alias("p"), same).select(*columns(docs.columns, "d"), F.explode("p._times").alias(time))
    return found.repartitionByRange(time).sortWithinPartitions(time, quoted(id_col)).drop(time)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
    found = found.withColumn("position", F.try_element_at("positions", F.lit(1))).drop("positions")
    # Documents that the mix leaves out have no position; the id spreads them over partitions.
    return found.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


OP3_SQL = r"""
WITH rows_ AS (
  SELECT doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(cast(doc_id AS VARCHAR), 'null')) AS k
  FROM documents),
sums AS (
  SELECT source, cast(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM rows_ GROUP BY source),
weighed AS (SELECT *, [3, 1, 2][cast(place % 3 + 1 AS INT)] AS weight, source_size * 2 AS most FROM sums),
levels AS (
  SELECT *, (cast(1.5 AS DOUBLE) * (SELECT sum(source_size) FROM sums) - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW w AS (ORDER BY cast(most AS DOUBLE) / weight, place)),
targets AS (SELECT source, place, source_size, least(cast(most AS DOUBLE), (SELECT max(level) FROM levels) * weight) AS target FROM levels),
placed AS (
  SELECT r.doc_id, r.size, t.place, t.source_size, t.target, cast(floor(t.target + 0.5) AS BIGINT) AS wanted,
         coalesce(sum(r.size) OVER (PARTITION BY t.place ORDER BY r.k, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
  FROM rows_ r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
took AS (
  SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS passes FROM placed),
done AS (
  SELECT *, cast(passes * size + least(greatest(wanted - passes * source_size - bef, 0), size) AS BIGINT) AS taken FROM took),
demand AS (
  SELECT *, (cast(bef AS DOUBLE) + least(size, taken) / cast(2 AS DOUBLE)) / wanted AS q,
         [cast(0.5 AS DOUBLE), 1, 1.5][cast(place % 3 + 1 AS INT)] AS a
  FROM done)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN q <= 0 THEN 0 ELSE q * 2 / (a + sqrt(greatest(a * a + 2 * (2 - a - a) * q, 0))) END END AS position
FROM demand
"""
