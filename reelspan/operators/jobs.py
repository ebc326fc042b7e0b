"""Jobs, progress and status as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspan.functions.media import download_percent, download_progress
from reelspan.schemas import schema


def payloads(jobs: DataFrame) -> DataFrame:
    """``jobs`` with ``p``, the payload as a struct (JSON text or a struct already)."""
    kind = dict(jobs.dtypes)["payload"]
    return jobs.withColumn("p", F.from_json("payload", schema("job_payload")) if kind == "string" else F.col("payload"))


def routes(jobs: DataFrame) -> DataFrame:
    """``jobs`` with is_link, is_retranscribe, is_clip and route: mark_ready, fetch_only or transcribe.

    A bound that is JSON null is present; only a missing one is not.
    """
    value = F.try_parse_json("payload")
    given = lambda k: F.try_variant_get(value, f"$.{k}", "variant").isNotNull()
    text = lambda k: F.coalesce(F.try_variant_get(value, f"$.{k}", "string"), F.lit(""))
    out = jobs.withColumns({
        "is_link": text("storage_path") == "",
        "is_retranscribe": F.coalesce(F.try_variant_get(value, "$.is_retranscribe", "boolean"), F.lit(False)),
        "is_clip": (text("clip_id") != "") & given("clip_start_ms") & given("clip_end_ms"),
    })
    plain = ~F.col("is_clip") & ~F.col("is_retranscribe")
    return out.withColumn("route", F.when(plain & ~F.col("is_link"), "mark_ready").when(plain, "fetch_only").otherwise("transcribe"))


def audio_ranges(jobs: DataFrame) -> DataFrame:
    """``id, start_s, length_s`` of the audio that clip jobs cut out."""
    own = payloads(routes(jobs).where("is_clip"))
    return own.select("id", (F.col("p.clip_start_ms") / 1000).alias("start_s"), ((F.col("p.clip_end_ms") - F.col("p.clip_start_ms")) / 1000).alias("length_s"))


def backlog(jobs: DataFrame, k: int) -> DataFrame:
    """The k oldest queued jobs of each type, with their place."""
    own = Window.partitionBy("type").orderBy("created_at", "id")
    return jobs.where("status = 'queued'").withColumn("place", F.row_number().over(own)).where(F.col("place") <= k)


def with_status(base: DataFrame, events: DataFrame, key: str, columns: list[str], by: str = "event_seq") -> DataFrame:
    """``base`` with the last non-null value of each column among its events, where there is one."""
    last = events.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(by))).alias(f"_{c}") for c in columns])
    return base.join(last, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def progress_changes(log: DataFrame, key: str = "video_id", order: str = "line_no") -> DataFrame:
    """``key, line_no, progress``: download progress each time its whole number changes (from 0)."""
    own = log.select(key, order, download_progress(download_percent(F.col("line"))).alias("progress")).where(F.col("progress").isNotNull())
    before = F.coalesce(F.lag("progress").over(Window.partitionBy(key).orderBy(order)), F.lit(0))
    return own.withColumn("_before", before).where(F.col("progress") != F.col("_before")).drop("_before")
