"""Step functions of box positions: where a box is at a time, and its track through a segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.operators.ranges import LEVELS, cell, level_of, points_in

DEFAULTS = {"x": 0.0, "y": 0.0, "w": 1.0, "h": 1.0}
FIRST = -(1 << 62)
LAST = 1 << 62
#: Length of the stretches of time by which boxes are dealt out.
PIECE_MS = 3_600_000


def validity(keyframes: DataFrame) -> DataFrame:
    """Keyframes with ``lo, hi``: each holds from its time to the next one's; the first one from ever.

    Of keyframes at the same time the last in input order (``kf_seq``) wins; the others hold for no time.
    """
    own = Window.partitionBy("box_id").orderBy("t_ms", "kf_seq")
    lo = F.when(F.row_number().over(own) == 1, F.lit(FIRST)).otherwise(F.col("t_ms"))
    return keyframes.withColumn("lo", lo).withColumn("hi", F.coalesce(F.lead("t_ms").over(own), F.lit(LAST)))


def _piece(ms: Column, width_ms: int) -> Column:
    return F.floor(ms / width_ms)


def pieces(probes: DataFrame, keyframes: DataFrame, width_ms: int) -> DataFrame:
    """Both as one table, dealt out by box and stretch of time: ``box_id, _piece, _t, _asked, _seq, _kf, _row``."""
    kind = "struct<" + ", ".join(f"{c}: double" for c in DEFAULTS) + ">"
    own = [F.col(c) for c in probes.columns]
    piece = _piece(F.col("_t"), width_ms).alias("_piece")
    asked = probes.select("box_id", F.col("q_ms").alias("_t"), F.lit(1).alias("_asked"), F.lit(0).cast("bigint").alias("_seq"), F.lit(None).cast(kind).alias("_kf"), F.struct(*own).alias("_row"))
    empty = F.lit(None).cast(asked.schema["_row"].dataType)
    frames = keyframes.where("box_id IS NOT NULL AND t_ms IS NOT NULL").select("box_id", F.col("t_ms").alias("_t"), F.lit(0).alias("_asked"), F.col("kf_seq").cast("bigint").alias("_seq"), F.struct(*DEFAULTS).cast(kind).alias("_kf"), empty.alias("_row"))
    return asked.unionByName(frames).select("box_id", piece, "_t", "_asked", "_seq", "_kf", "_row")


def position_at(probes: DataFrame, keyframes: DataFrame, width_ms: int = PIECE_MS) -> DataFrame:
    """``probes`` (box_id, q_ms and others) with x, y, w, h at that time; a box without keyframes fills the frame, as does a null box or time.

    Two levels: inside a stretch of ``width_ms`` of a box one sort of both by time gives a probe the last keyframe at or before it;
    where the stretch has none yet, the last one of the stretches before holds, which is carried over a table of one row for each
    box and stretch.  A busy box is as many groups as it has stretches.
    """
    both = pieces(probes, keyframes, width_ms)
    at = F.struct("_t", "_seq")
    last = both.groupBy("box_id", "_piece").agg(F.max_by("_kf", F.when(F.col("_asked") == 0, at)).alias("_last"), F.min_by("_kf", F.when(F.col("_asked") == 0, at)).alias("_first"), F.max("_asked").alias("_some"))
    line = Window.partitionBy("box_id").orderBy("_piece")
    before = F.last("_last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(line.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    # Before a box's first keyframe that one holds.
    carried = last.select("box_id", "_piece", F.coalesce(before, after).alias("_carried"), "_some").where("_some = 1").drop("_some")
    inside = Window.partitionBy("box_id", "_piece").orderBy("_t", "_asked", "_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_at", F.last("_kf", ignorenulls=True).over(inside)).where("_asked = 1")
    placed = found.join(carried, ["box_id", "_piece"], "left").withColumn("_at", F.coalesce("_at", "_carried"))
    return placed.select(*[F.col(f"_row.{c}").alias(c) for c in probes.columns], *[F.coalesce(F.col(f"_at.{c}"), F.lit(d)).alias(c) for c, d in DEFAULTS.items()])


def changes(keyframes: DataFrame) -> DataFrame:
    """``box_id, lo, x, y, w, h``: where a box's position may change, that is at each time of keyframes; of several at a time the last in input order.

    The first keyframe holds from ever, so the first time counts only if it has several.
    """
    at = _at_times(keyframes)
    found = at.join(at.groupBy("box_id").agg(F.min("lo").alias("_first")), "box_id").where("lo > _first OR _n > 1")
    return found.select("box_id", "lo", *[F.col(f"_kf.{c}").alias(c) for c in DEFAULTS])


def _at_times(keyframes: DataFrame) -> DataFrame:
    """``box_id, lo, _kf, _lead, _n``: of the keyframes at a time the last and the first in input order, and how many there are."""
    kf, at = F.struct(*DEFAULTS), F.struct("kf_seq")
    own = keyframes.where("box_id IS NOT NULL AND t_ms IS NOT NULL")
    return own.groupBy("box_id", F.col("t_ms").alias("lo")).agg(F.max_by(kf, at).alias("_kf"), F.min_by(kf, at).alias("_lead"), F.count(F.lit(1)).alias("_n"))


def _start_cell(ms: Column, level: Column, width_ms: int) -> Column:
    """The cell of a time; the top level is one cell, whatever the width."""
    return F.when(level == LEVELS - 1, F.lit(0).cast("bigint")).otherwise(cell(ms, level, width_ms))


def held(keyframes: DataFrame, asked: DataFrame, width_ms: int) -> DataFrame:
    """Where a box is throughout each asked cell (``box_id, _level, _cell``, see ``ranges``) and the next one: ``box_id, _level, _cell, _from, _until, x, y, w, h``.

    Nulls of ``_from`` and ``_until`` are before and after all times of both cells.  Only boxes and levels that are asked for have copies: two for
    each keyframe and level.  What holds where a cell begins is carried over a table of one row for each cell.  Boxes without keyframes have no rows.
    """
    cells = ["box_id", "_level", "_cell"]
    levels = asked.groupBy("box_id").agg(F.collect_set("_level").alias("_levels"))  # at most LEVELS
    at = _at_times(keyframes.join(levels, "box_id", "left_semi"))
    boxes = at.groupBy("box_id").agg(F.min("lo").alias("_first"), F.min_by("_lead", "lo").alias("_lead")).join(levels, "box_id")
    moved = at.drop("_lead").join(boxes.drop("_lead"), "box_id").where("lo > _first OR _n > 1")
    moved = moved.select("box_id", F.explode("_levels").alias("_level"), "lo", "_kf").withColumn("_cell", _start_cell(F.col("lo"), F.col("_level"), width_ms))
    both = moved.withColumn("_some", F.lit(0)).unionByName(asked.withColumn("_some", F.lit(1)), allowMissingColumns=True)
    last = both.groupBy(*cells).agg(F.max_by("_kf", "lo").alias("_last"), F.max("_some").alias("_some"))
    line = Window.partitionBy("box_id", "_level").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    heads = last.withColumn("_before", F.last("_last", ignorenulls=True).over(line)).where("_some = 1").join(boxes.select("box_id", "_lead"), "box_id")
    heads = heads.select(*cells, F.lit(None).cast("bigint").alias("lo"), F.coalesce("_before", "_lead").alias("_kf"))
    inside = moved.withColumn("_cell", F.explode(F.array(F.col("_cell"), F.col("_cell") - 1))).join(asked, cells, "left_semi")
    until = F.lead("lo").over(Window.partitionBy(*cells).orderBy(F.col("lo").asc_nulls_first()))
    return heads.unionByName(inside).select(*cells, F.col("lo").alias("_from"), until.alias("_until"), *[F.col(f"_kf.{c}").alias(c) for c in DEFAULTS])


def crop_pixels(width: int, height: int) -> dict:
    """Crop rectangle columns of fractions x, y, w, h: at least 2 wide and high, and 2 from the far edge."""
    return {
        "crop_w": F.greatest(F.lit(2.0), F.col("w") * width), "crop_h": F.greatest(F.lit(2.0), F.col("h") * height),
        "crop_x": F.least(F.lit(width - 2.0), F.col("x") * width), "crop_y": F.least(F.lit(height - 2.0), F.col("y") * height),
    }


def crop_track(slots: DataFrame, keyframes: DataFrame, width: int, height: int, width_ms: int = PIECE_MS) -> DataFrame:
    """Pieces of constant crop of each slot: ``segment_id, slot, start_ms, end_ms, crop_x, crop_y, crop_w, crop_h``.

    ``slots``: segment_id, slot, box_id (null: the whole frame), start_ms, end_ms.  A slot
    starts with its box's position at that time; every later keyframe inside it starts a piece.

    One join: a slot asks where its box is throughout the cell that it starts in and the next one, at the level where it is no longer
    than a cell; each answer is a piece, whose end needs no other.  So slots are not sorted by time, and a busy cell can be split.
    """
    # A hundredth longer, so that cells' rounded bounds do not count.
    length = F.coalesce(F.greatest(F.col("end_ms").cast("double") - F.col("start_ms").cast("double"), F.lit(0.0)), F.lit(0.0)) * 1.01
    own = slots.select("segment_id", "slot", "box_id", "start_ms", "end_ms").withColumn("_level", level_of(length, width_ms))
    # Slots without a box meet nothing; they are dealt out by themselves.
    own = own.withColumn("_cell", F.when(F.col("box_id").isNull(), F.xxhash64("segment_id", "slot")).otherwise(_start_cell(F.col("start_ms"), F.col("_level"), width_ms)))
    asked = own.where("box_id IS NOT NULL AND _level IS NOT NULL AND _cell IS NOT NULL").select("box_id", "_level", "_cell").distinct()
    at = held(keyframes, asked, width_ms).withColumnsRenamed({"box_id": "_box", "_level": "_at_level", "_cell": "_at_cell"})
    same = (F.col("box_id") == F.col("_box")) & (F.col("_level") == F.col("_at_level")) & (F.col("_cell") == F.col("_at_cell"))
    begun = F.col("_from").isNull() | (F.col("_from") <= F.col("start_ms")) | (F.col("_from") < F.col("end_ms"))
    lasts = F.col("_until").isNull() | (F.col("_until") > F.col("start_ms"))
    pieces = own.join(at, same & begun & lasts, "left").select(
        "segment_id", "slot", F.when(F.col("_from") > F.col("start_ms"), F.col("_from")).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(F.col("_until") < F.col("end_ms"), F.col("_until")).otherwise(F.col("end_ms")).alias("end_ms"), *[F.coalesce(F.col(c), F.lit(d)).alias(c) for c, d in DEFAULTS.items()],
    )
    return pieces.withColumns(crop_pixels(width, height)).drop(*DEFAULTS)


def active_at(times: DataFrame, overlays: DataFrame, key: str = "clip_id") -> DataFrame:
    """Overlays on screen at each time, both ends included."""
    o = overlays.withColumnsRenamed({"start_ms": "from_ms", "end_ms": "to_ms"})
    return points_in(times, o, key, F.col("t_ms"), F.col("from_ms"), F.col("to_ms") + 1, width_ms=3_600_000)


def time_grid(clips: DataFrame, step_ms: int, key: str = "clip_id") -> DataFrame:
    """``key, t_ms``: sampled times of each clip in clip time, from 0 on."""
    return clips.where("end_ms > start_ms").select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("end_ms") - F.col("start_ms") - 1, F.lit(step_ms).cast("bigint"))).alias("t_ms"))
