"""The three operators that make sense over streams, with state that does not grow with the stream's age.

Speech ranges go out once, when the watermark has passed them, and leave the state with that; rows
that come later than the watermark allows are dropped.  Answers are remembered for a time, so that one
that is sent again adds nothing.  Progress keeps one number a video, which is forgotten some
time after the video's last line.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from reelspan.functions.media import download_percent, download_progress
from reelspan.operators.speech import GAP_MS
from reelspan.operators.transcript import anchor_rows, phrase_rows
from reelspan.schemas import schema

#: Columns of a stream of words.
WORDS = "clip_id bigint, start_ms bigint, end_ms bigint, word string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def speech_ranges(words: DataFrame, late: str = "10 minutes", gap_ms: int = GAP_MS, key: str = "clip_id") -> DataFrame:
    """Speech ranges of a stream of words, by session windows with a gap of each word's own length.

    For append mode: a range goes out when the watermark, ``late`` behind the latest start seen, has passed its end, and
    its state goes with it; a word that starts before the watermark is dropped.  A stream that stops holds back the ranges
    of its last ``late``: a ``heartbeat`` lets them out.
    """
    length = F.greatest("end_ms", "start_ms") - F.col("start_ms")
    gap = F.concat((length + (gap_ms - 1)).cast("string"), F.lit(" milliseconds"))
    timed = words.withColumn("_ts", F.timestamp_millis("start_ms")).withWatermark("_ts", late)
    found = timed.groupBy(key, F.session_window("_ts", gap)).agg(F.min("start_ms").alias("start_ms"), F.max(F.greatest("end_ms", "start_ms")).alias("end_ms"))
    return found.select(key, "start_ms", "end_ms")


def heartbeat(words: DataFrame, ahead_ms: int, key: str = "clip_id") -> DataFrame:
    """One row to send after ``words``, of no key, so far ahead that their ranges are over; its own range never goes out unless a later one follows."""
    last = words.agg((F.max(F.greatest("start_ms", "end_ms")) + ahead_ms).alias("_at"))
    at = {"start_ms": F.col("_at"), "end_ms": F.col("_at")}
    return last.select(*[at.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in words.schema.fields])


def appended(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Rows of a stream added to Parquet files, each once even if a batch is repeated."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def answer_stream(spark: SparkSession, path: str, form: str) -> DataFrame:
    """Recognizer answers as their files arrive, with the time of the file in ``arrived``."""
    rows = spark.readStream.schema(f"clip_id string, chunk_idx bigint, response {schema(form).simpleString()}").json(path)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("arrived"))


def first_answers(answers: DataFrame, within: str = "1 day") -> DataFrame:
    """Answers without those on a clip's chunk that has had one, if they arrive ``within`` the time that chunks are remembered for."""
    return answers.withWatermark("arrived", within).dropDuplicatesWithinWatermark(["clip_id", "chunk_idx"])


def answers_to_words(answers: DataFrame, form: str, path: str, checkpoint: str, within: str = "1 day") -> DataStreamWriter:
    """Word rows of each chunk's first answer; an answer or a batch that comes again adds no rows."""
    rows = phrase_rows if form == "phrase_response" else anchor_rows
    return appended(rows(first_answers(answers, within)), path, checkpoint)


class _Changes(StatefulProcessor):
    """Lines of a video whose progress is not that of the line before; the last one is kept for ``keep_ms`` after it was set."""

    def __init__(self, key: str, order: str, keep_ms: int):
        self.key, self.order, self.keep_ms = key, order, keep_ms

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "progress bigint", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names that Spark calls
        lines = pd.concat(list(rows)).sort_values(self.order, kind="stable")  # a micro-batch of one video
        before = self.last.get()[0] if self.last.exists() else 0
        own = lines["progress"].astype("int64")
        changed = own.ne(own.shift(fill_value=before))
        if len(own):
            self.last.update((int(own.iloc[-1]),))
        yield lines.loc[changed, [self.key, self.order, "progress"]]

    def close(self) -> None:
        pass


def progress_changes(lines: DataFrame, key: str = "video_id", order: str = "line_no", keep_ms: int = 86_400_000) -> DataFrame:
    """``key, order, progress`` of a stream of log lines: download progress each time its whole number changes (from 0).

    Lines of a video must come in order from batch to batch; inside one they are sorted by ``order``.
    A video without lines for ``keep_ms`` is forgotten and counts from 0 again.  Start it within ``expiring_state``.
    """
    own = lines.select(key, order, download_progress(download_percent(F.col("line"))).alias("progress")).where(F.col("progress").isNotNull())
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema.fields}
    shape = f"{key} {kinds[key]}, {order} {kinds[order]}, progress bigint"
    return own.groupBy(key).transformWithStateInPandas(_Changes(key, order, keep_ms), shape, "Append", "ProcessingTime")


@contextlib.contextmanager
def expiring_state(spark: SparkSession) -> Iterator[None]:
    """Settings for ``progress_changes``; start the query inside, it keeps them.

    State that expires by row is kept by RocksDB.  Spark would run empty batches without end to look for what has expired:
    here only batches with lines do, so a query that is to stop when its input ends does.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
