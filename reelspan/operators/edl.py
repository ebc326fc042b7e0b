"""Cut lists: which source plays where, in which rectangle, and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspan.operators.scans import before, carried


#: Slots of a segment at most.
MOST_SLOTS = 3


def slot_count(layout: Column) -> Column:
    return F.when(layout == "split", 2).when(layout == "trio", 3).otherwise(1)


def slots(segments: DataFrame, boxes: DataFrame, known: DataFrame | None = None, by_clip: bool = False) -> DataFrame:
    """A row for each slot of each segment with its box: the i-th box by ``slot_index``, whatever its value.

    ``segment_id, clip_id, sort_order, layout, start_ms, end_ms, slot, box_id,
    source_video_id, source_offset_ms``.  Without a box, or with one whose source is
    not in ``known`` (video_id), the slot shows the primary source (null).

    A segment stands behind its boxes in one sort of both.  ``by_clip``: boxes have clip_id as well; tables that lie by clip do not move.
    """
    group = ["segment_id", "clip_id"] if by_clip else ["segment_id"]
    shown = ["box_id", "source_video_id", "source_offset_ms"]
    own = segments.select("clip_id", F.col("id").alias("segment_id"), F.lit(1).alias("_kind"), "sort_order", "layout", "start_ms", "end_ms")
    b = boxes.where("segment_id IS NOT NULL").select(*group, F.lit(0).alias("_kind"), "slot_index", F.col("id").alias("box_id"), *shown[1:])
    line = Window.partitionBy(*group).orderBy("_kind", "slot_index", "box_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Beyond its boxes a segment finds itself, which has nothing in their columns.
    placed = own.unionByName(b, allowMissingColumns=True).withColumns({f"_{c}{k}": F.nth_value(c, k + 1).over(line) for c in shown for k in range(MOST_SLOTS)}).where("_kind = 1")
    out = placed.withColumn("slot", F.explode(F.sequence(F.lit(0), slot_count(F.col("layout")) - 1)))
    at = {c: F.coalesce(*[F.when(F.col("slot") == k, F.col(f"_{c}{k}")) for k in range(MOST_SLOTS)]) for c in shown}
    out = out.select("segment_id", "slot", "clip_id", "sort_order", "layout", "start_ms", "end_ms", *[v.alias(c) for c, v in at.items()])
    if known is not None:
        k = known.select(F.col("video_id").cast("string").alias("_source")).distinct().withColumn("_known", F.lit(True))
        # Slots of the primary source, which may be most of them, have a key each: none that is known, and no two alike.
        own = F.concat(F.lit("\0"), F.col("segment_id").cast("string"))
        out = out.withColumn("_source", F.coalesce(F.col("source_video_id").cast("string"), own)).join(k, "_source", "left")
        out = out.withColumn("source_video_id", F.when(F.col("_known"), F.col("source_video_id"))).drop("_source", "_known")
    return out


def source_counts(slot_rows: DataFrame) -> DataFrame:
    """``clip_id, source_video_id, n_slots``; the primary source is null."""
    return slot_rows.groupBy("clip_id", "source_video_id").agg(F.count(F.lit(1)).alias("n_slots"))


def slot_rectangle(layout: Column, slot: Column, width: int, height: int) -> dict[str, Column]:
    """Where a slot is shown, and whether it fits inside (else covers): slots of a split or trio are stacked rows."""
    row = F.when(layout == "split", height // 2).when(layout == "trio", height // 3).otherwise(height)
    return {"dst_x": F.lit(0), "dst_y": row * slot, "dst_w": F.lit(width), "dst_h": row, "fit": F.when(layout == "horizontal", "fit").otherwise("cover")}


def segment_offsets(segments: DataFrame, stretch: Column | None = None) -> DataFrame:
    """``segment_id, output_start_ms``: segments one after the other in ``sort_order``.

    With ``stretch``, a column that never falls in that order, a clip is worked on in stretches of equal values (see ``scans``).
    """
    length = F.col("end_ms") - F.col("start_ms")
    rows = segments.withColumn("_stretch", F.lit(0) if stretch is None else stretch)
    total = F.coalesce(F.sum(length).over(before(Window.partitionBy("clip_id", "_stretch").orderBy("sort_order", "id"))), F.lit(0))
    if stretch is not None:
        rows = carried(rows, "clip_id", {"length": F.sum(length)}, lambda line: {"_so_far": F.coalesce(F.sum("length").over(before(line)), F.lit(0))})
        total = total + F.col("_so_far")
    return rows.select(F.col("id").alias("segment_id"), total.alias("output_start_ms"))


def cut_list(segments: DataFrame, boxes: DataFrame, width: int, height: int, known: DataFrame | None = None) -> DataFrame:
    """A row for each segment and slot: source, in and out, rectangle, fit, and where it starts in clip and output time.

    The primary source plays the segment's clip time; another one plays from its
    offset for as long.  Gaps between segments are in clip time only.
    """
    rows = slots(segments, boxes, known).join(segment_offsets(segments), "segment_id")
    offset = F.coalesce("source_offset_ms", F.lit(0))
    other = F.col("source_video_id").isNotNull()
    return rows.select(
        "clip_id", "segment_id", "sort_order", "slot", "box_id", "source_video_id",
        F.when(other, offset).otherwise(F.col("start_ms")).alias("in_ms"), F.when(other, offset + F.col("end_ms") - F.col("start_ms")).otherwise(F.col("end_ms")).alias("out_ms"),
        *[v.alias(k) for k, v in slot_rectangle(F.col("layout"), F.col("slot"), width, height).items()],
        F.col("start_ms").alias("clip_start_ms"), "output_start_ms",
    )
