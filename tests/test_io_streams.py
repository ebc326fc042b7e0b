"""Sources, sinks and streams through real files."""

import json
import random

from pyspark.sql import functions as F

from reelspan.operators import captions, jobs, speech
from reelspan.plans.fixtures import view
from reelspan.sources import tables
from reelspan.streaming import streams


def test_answers_round_trip(spark, tmp_path):
    folder = tmp_path / "answers"
    folder.mkdir()
    answers = [
        {"clip_id": "c", "chunk_idx": 0, "response": {"language_code": "te-IN", "timestamps": {"words": ["a b", "c"], "start_time_seconds": [0.5], "end_time_seconds": []}}},
        {"clip_id": "c", "chunk_idx": 1, "response": {"language_code": "hi"}},
    ]
    (folder / "a.json").write_text("\n".join(map(json.dumps, answers)))
    from reelspan.operators.transcript import phrase_rows

    rows = phrase_rows(tables.read_answers(spark, str(folder), "phrase_response")).orderBy("phrase_idx").collect()
    assert [(r.phrase, r.start_s, r.end_s) for r in rows] == [("a b", 0.5, 0.0), ("c", 0.0, 0.0)]

    out, checkpoint = str(tmp_path / "words"), str(tmp_path / "checkpoint")
    query = streams.answers_to_words(streams.answer_stream(spark, str(folder), "phrase_response"), "phrase_response", out, checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(out).count() == 2


def ended(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_speech_stream(spark, small, tmp_path):
    words = view(spark, small, "words")
    words.unionByName(streams.heartbeat(words, 3_600_000)).write.parquet(str(tmp_path / "words"))
    stream = streams.speech_ranges(spark.readStream.schema(words.schema).parquet(str(tmp_path / "words")))
    ended(streams.appended(stream, str(tmp_path / "ranges"), str(tmp_path / "checkpoint")))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "ranges")).collect()))
    assert got == sorted(map(tuple, speech.speech_ranges(words).collect())) and got


def test_speech_stream_evicts_and_drops_late_words(spark, tmp_path):
    path, shape = str(tmp_path / "words"), "clip_id bigint, start_ms bigint, end_ms bigint"
    minute = 60_000
    send = lambda rows: spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)
    start = lambda: ended(streams.appended(streams.speech_ranges(spark.readStream.schema(shape).parquet(path)), str(tmp_path / "ranges"), str(tmp_path / "checkpoint")))
    rows = lambda: sorted(map(tuple, spark.read.schema(shape).parquet(str(tmp_path / "ranges")).collect()))
    states = []
    for hour in range(6):
        base = hour * 60 * minute
        send([(k, base + k * 10, base + k * 10 + 100) for k in range(40)])
        query = start()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    # Each hour's forty ranges leave when the next hour's have come.
    assert max(states) <= 40 and len(rows()) == 5 * 40
    send([(1, 30, 90), (2, 2 * 60 * minute, 2 * 60 * minute + 5)])  # hours late
    query = start()
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])
    assert dropped == 2 and len(rows()) == 5 * 40


def test_answers_that_are_sent_again(spark, tmp_path):
    answers = [{"clip_id": "c", "chunk_idx": k, "response": {"timestamps": {"words": [f"a{k} b", "c"], "start_time_seconds": [0.5, 1.0], "end_time_seconds": [1.0, 2.0]}}} for k in range(3)]
    folder = tmp_path / "answers"
    folder.mkdir()
    run = lambda: ended(streams.answers_to_words(streams.answer_stream(spark, str(folder), "phrase_response"), "phrase_response", str(tmp_path / "words"), str(tmp_path / "checkpoint")))
    for name, some in [("1", answers[:2]), ("2", answers[:2]), ("3", [answers[1], answers[2]])]:
        (folder / f"{name}.json").write_text("\n".join(map(json.dumps, some)))
        run()
    rows = sorted((r.chunk_idx, r.phrase_idx, r.phrase) for r in spark.read.parquet(str(tmp_path / "words")).collect())
    assert rows == [(k, p, w) for k in range(3) for p, w in enumerate((f"a{k} b", "c"))]


def test_progress_stream(spark, tmp_path):
    shape, path = "video_id string, line_no bigint, line string", str(tmp_path / "log")
    draw = random.Random(3)
    lines, batches = [], []
    for k in range(4):
        batch = [(f"v{v}", 10 * k + n, draw.choice(["x", f"[download]  {draw.choice([0, 10, 10.1, 50, 99.5])}% of"])) for v in range(3) for n in range(10)]
        lines += batch
        batches.append(draw.sample(batch, len(batch)))
    for batch in batches:
        spark.createDataFrame(batch, shape).write.mode("append").parquet(path)
        found = streams.progress_changes(spark.readStream.schema(shape).parquet(path))
        with streams.expiring_state(spark):
            query = streams.appended(found, str(tmp_path / "progress"), str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    want = jobs.progress_changes(spark.createDataFrame(lines, shape))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "progress")).collect())) == sorted(map(tuple, want.collect())) and want.count()


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", "v1"), ("b", "v2")], "id string, video_id string")
    new = spark.createDataFrame([("c", "v1")], "id string, video_id string")
    path = str(tmp_path / "transcripts")
    for _ in range(2):
        tables.append_transcripts(old, path, "run1", key="id")
    assert spark.read.parquet(path).count() == 2
    tables.append_transcripts(old.unionByName(new.selectExpr("'d' AS id", "video_id")), path, "run2", key="id")  # another run adds what is not there
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b", "d"]
    tables.append_transcripts(old.where("id = 'b'"), path, "run1", key="id")  # a run that is made again replaces its own
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["b", "d"]
    tables.append_transcripts(old, path, "run1", key="id")
    tables.replace_transcripts(spark, path, new, str(tmp_path / "next"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "next")).collect()) == ["b", "c"]
    for name, size in (("parts", 100), ("many", 1)):  # keys that share a folder, and not
        tables.overwrite_keys(old, str(tmp_path / name), bucket_rows=size)
        tables.overwrite_keys(new, str(tmp_path / name), bucket_rows=size)
        found = spark.read.parquet(str(tmp_path / name))
        assert sorted(r.id for r in found.collect()) == ["b", "c"] and {r.of for r in found.collect()} == {1 if size == 100 else 2}
    words = spark.createDataFrame([("c", 0, "Hi.", 0, 400)], "clip_id string, i int, word string, start_ms bigint, end_ms bigint")
    styles = spark.createDataFrame([("s", "c", None, 0, None, 0.0)], "id string, clip_id string, font string, size int, color string, position_y double")
    tables.write_scripts(captions.scripts(captions.events(words, ["i"]), styles, 100, 200), str(tmp_path / "scripts"))
    lines = [r.line for r in tables.read_script(spark, str(tmp_path / "scripts"), "c").collect()]
    assert lines[0] == "[Script Info]" and lines[-1] == "Dialogue: 0,0:00:00.00,0:00:00.60,Default,,0,0,0,,{\\pos(50,168)}Hi."
    ids = words.select(tables.transcript_id("clip_id", "run").alias("x")).first().x
    assert len(ids) == 64
    tables.write_specs(words.select(F.to_json(F.struct("*")).alias("json")), str(tmp_path / "specs"))
    assert spark.read.json(str(tmp_path / "specs")).first().word == "Hi."


def test_table_reader(spark, tmp_path):
    spark.createDataFrame([("s", "c", 1, "split", 0, 5)], "id string, clip_id string, sort_order int, layout string, start_ms bigint, end_ms bigint").write.parquet(str(tmp_path / "segments.parquet"))
    assert tables.read_table(spark, str(tmp_path), "segments").first().layout == "split"


def test_database_round_trip(spark):
    words = spark.createDataFrame([(f"t{k % 3}", k, f"w{k}") for k in range(1200)], "transcript_id string, word_idx bigint, word string")
    url, options = "jdbc:derby:memory:reels;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    some = words.where("transcript_id <> 't2'")
    for run, rows in (("r1", some), ("r1", some), ("r2", words), ("r2", words)):
        tables.append_jdbc(rows, url, "transcript_words", run, **options)
    whole = tables.read_jdbc(spark, url, "transcript_words", **options)
    parts = tables.read_jdbc(spark, url, "transcript_words", column='"word_idx"', lower=0, upper=1200, partitions=4, **options)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) == sorted(map(tuple, words.collect()))
    assert len({r.p for r in parts.selectExpr("spark_partition_id() AS p").collect()}) == 4


def test_bucketed_table(spark, tmp_path):
    rows = spark.range(6000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 50).alias("video_id"))
    assert tables.save_bucketed(rows, "bucketed_test", str(tmp_path / "one"), bucket_rows=1000) == 6
    new = spark.createDataFrame([("n1", 7), ("n2", 7), ("n3", 999)], "id string, video_id bigint")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = tables.kept_rows(spark, "bucketed_test", new)._jdf.queryExecution().executedPlan().toString()
        scans = plan[: plan.index("Exchange hashpartitioning")]
        # The old side comes first: no exchange stands over its scan.
        assert "SortMergeJoin" in scans and "FileScan parquet spark_catalog.default.bucketed_test" in scans and "Bucketed: true" in scans
        tables.replace_bucketed(spark, "bucketed_test", new, str(tmp_path / "two"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    want = sorted([(r.id, r.video_id) for r in rows.where("video_id <> 7").collect()] + [tuple(r) for r in new.collect()])
    assert sorted(map(tuple, spark.table("bucketed_test").collect())) == want and tables.buckets_of(spark, "bucketed_test") == 6
    spark.sql("DROP TABLE bucketed_test")
    tables.declare_bucketed(spark, "bucketed_again", str(tmp_path / "two"), "id string, video_id bigint", 6)
    assert sorted(map(tuple, spark.table("bucketed_again").collect())) == want
    spark.sql("DROP TABLE bucketed_again")


def test_shared_folders_are_cleared(spark):
    import os

    folder = tables.shared_folder(spark, "some")
    spark.range(3).write.parquet(folder)
    assert os.path.exists(folder)
    tables.clear_folders(spark)
    assert not os.path.exists(folder)
