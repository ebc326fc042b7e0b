"""When someone speaks, and how loud music is meanwhile."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.operators.scans import before, carried

GAP_MS = 500
DUCK, VOLUME = 0.15, 0.5


def speech_ranges(words: DataFrame, gap_ms: int = GAP_MS, key: str = "clip_id", stretch_ms: int | None = None) -> DataFrame:
    """``key, start_ms, end_ms``: words merged while less than ``gap_ms`` parts them.

    A word that ends before it starts counts as ending where it starts.  With ``stretch_ms`` a video is worked on in
    stretches of that time (see ``scans``), for videos too long for one window.
    """
    ends = words.select(key, "start_ms", F.greatest("end_ms", "start_ms").alias("end_ms"))
    parts = [key]
    if stretch_ms:
        ends = ends.withColumn("_stretch", F.floor(F.col("start_ms") / stretch_ms))
        ends = carried(ends, key, {"last": F.max("end_ms")}, lambda line: {"_reached": F.max("last").over(before(line))})
        parts.append("_stretch")
    own = Window.partitionBy(*parts).orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(before(own))
    ends = ends.withColumn("_new", F.when(F.col("start_ms") - (F.greatest(reach, "_reached") if stretch_ms else reach) >= gap_ms, 1).otherwise(0))
    island = F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("_island", island)
    if not stretch_ms:
        return ends.groupBy(key, "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_island")
    # Ranges of a stretch are few; those that no gap parts from the stretch before go on.
    local = ends.groupBy(key, "_stretch", "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    local = carried(local, key, {"n": F.max("_island")}, lambda line: {"_before": F.coalesce(F.sum("n").over(before(line)), F.lit(0))})
    return local.groupBy(key, (F.col("_before") + F.col("_island")).alias("_i")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_i")


def rejects(words: DataFrame, key: str = "clip_id") -> DataFrame:
    """Words per key that end before they start."""
    return words.groupBy(key).agg(F.count_if(F.col("end_ms") < F.col("start_ms")).alias("n_rejected"))


def speech_sessions(words: DataFrame, gap_ms: int = GAP_MS, key: str = "clip_id") -> DataFrame:
    """The same ranges by session windows, which also run over a stream.

    Spark merges sessions that touch, so a session lasts one millisecond less than the gap past its last word.
    """
    gap = F.concat((F.greatest("end_ms", "start_ms") - F.col("start_ms") + (gap_ms - 1)).cast("string"), F.lit(" milliseconds"))
    found = words.withColumn("_ts", F.timestamp_millis("start_ms")).groupBy(key, F.session_window("_ts", gap)).agg(F.min("start_ms").alias("start_ms"), F.max(F.greatest("end_ms", "start_ms")).alias("end_ms"))
    return found.select(key, "start_ms", "end_ms")


def rebased(ranges: DataFrame, clips: DataFrame) -> DataFrame:
    """Ranges in clip time, cut to the clip."""
    c = clips.select("clip_id", F.col("start_ms").alias("_from"), F.col("end_ms").alias("_to"))
    own = ranges.join(c, "clip_id").where((F.col("end_ms") >= F.col("_from")) & (F.col("start_ms") <= F.col("_to")))
    return own.select("clip_id", (F.greatest("start_ms", "_from") - F.col("_from")).alias("start_ms"), (F.least("end_ms", "_to") - F.col("_from")).alias("end_ms"))


def music_gain(tracks: DataFrame, ranges: DataFrame, clips: DataFrame) -> DataFrame:
    """Pieces of constant music gain that tile each clip: ``id, clip_id, start_ms, end_ms, gain, seek_ms``.

    ``tracks``: id, clip_id, volume (null: 0.5), duck, seek_ms (where in the music the
    track begins).  ``ranges`` are disjoint and in clip time.  A ducked track plays at
    0.15 of its volume inside them; speech itself stays at 1.
    """
    length = clips.select("clip_id", (F.col("end_ms") - F.col("start_ms")).alias("length"))
    own = tracks.join(length, "clip_id").withColumn("volume", F.coalesce("volume", F.lit(VOLUME)))
    ducked = own.where("duck").select("id", "clip_id", "length").join(ranges, "clip_id")
    cut = ducked.where((F.col("start_ms") < F.col("length")) & (F.col("end_ms") > F.col("start_ms")))
    # A step at each boundary: 1 into a range, -1 out of it.
    steps = cut.select("id", F.explode(F.array(F.struct(F.col("start_ms").alias("at"), F.lit(1).alias("step")), F.struct(F.least("end_ms", "length").alias("at"), F.lit(-1).alias("step")))).alias("e")).select("id", "e.*")
    edges = steps.unionByName(own.select("id", F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("step"))).unionByName(own.select("id", F.col("length").alias("at"), F.lit(0).alias("step")))
    edges = edges.groupBy("id", "at").agg(F.sum("step").alias("step"))
    order = Window.partitionBy("id").orderBy("at")
    pieces = edges.select("id", F.col("at").alias("start_ms"), F.lead("at").over(order).alias("end_ms"), F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("inside"))
    gain = F.when(F.col("inside") > 0, F.col("volume") * DUCK).otherwise(F.col("volume"))
    return pieces.where(F.col("end_ms").isNotNull()).join(own.select("id", "clip_id", "volume", "seek_ms"), "id").select("id", "clip_id", "start_ms", "end_ms", gain.alias("gain"), "seek_ms")
