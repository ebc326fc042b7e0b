"""Running results in stretches are those of one window over a video."""

import random

import pytest
from pyspark.sql import functions as F

from reelspan.operators import captions, edl, scans, speech, transcript

STRETCHES = [1, 3, 64, 10_000]


@pytest.fixture(scope="module")
def talk(spark):
    draw = random.Random(13)
    rows = []
    for c in range(3):
        t = 0
        for i in range(700 if c else 5):
            t += draw.choice([0, 0, 100, 299, 300, 301, 499, 500, 501, 2000])
            end = t + draw.choice([-20, 0, 60, 60, 60, 5000])
            rows.append((f"c{c}", i, draw.choice(["w", "w", "w", "w", "w", "a.", "a!", "अ। "]), t, end, t / 1000, end / 1000, 9000.0))
            t += draw.choice([0, 60])
    return spark.createDataFrame(rows, "clip_id string, i int, word string, start_ms bigint, end_ms bigint, start_s double, end_s double, total_s double").cache()


def same(a, b, columns):
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(a) == rows(b) and a.count()


@pytest.mark.parametrize("n", STRETCHES)
def test_lines(talk, n):
    own = ["clip_id", "i", "line", "place"]
    same(captions.lines(talk, ["i"], stretch=F.floor(F.col("i") / n)), captions.lines(talk, ["i"]), own)
    same(captions.events(talk, ["i"], stretch=F.floor(F.col("i") / n)), captions.events(talk, ["i"]), ["clip_id", "line", "start_ms", "end_ms", "text"])


@pytest.mark.parametrize("n", STRETCHES)
def test_clamped_ends(talk, n):
    same(transcript.clamp_ends(talk, ["i"], stretch=F.floor(F.col("i") / n)), transcript.clamp_ends(talk, ["i"]), talk.columns)


@pytest.mark.parametrize("ms", [1, 700, 60_000, 10**9])
def test_speech(talk, ms):
    same(speech.speech_ranges(talk, stretch_ms=ms), speech.speech_ranges(talk), ["clip_id", "start_ms", "end_ms"])


@pytest.mark.parametrize("n", [1, 3, 64])
def test_offsets(spark, n):
    draw = random.Random(5)
    rows = [(k, k % 2, k // 2 if k % 7 else 3, 100 * k, 100 * k + draw.randint(0, 90)) for k in range(300)]
    segments = spark.createDataFrame(rows, "id bigint, clip_id int, sort_order int, start_ms bigint, end_ms bigint")
    same(edl.segment_offsets(segments, F.floor(F.col("sort_order") / n)), edl.segment_offsets(segments), ["segment_id", "output_start_ms"])


def test_no_window_holds_a_video(talk):
    plan = captions.lines(talk, ["i"], stretch=F.floor(F.col("i") / 64))._jdf.queryExecution().optimizedPlan().toString()
    wide = [x for x in plan.splitlines() if "Window [" in x and "_stretch" not in x.rsplit("], [", 2)[-2]]
    # Windows over a whole video run over its stretches only.
    assert wide and all("_inside" not in x and "_island" not in x for x in wide)


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_scripts_read_captions_once(talk):
    styles = talk.select("clip_id").distinct().selectExpr("clip_id AS id", "clip_id", "'roboto' AS font", "10 AS size", "'#fff' AS color", "0.5D AS position_y")
    optimized, _ = planned(captions.scripts(captions.events(talk, ["i"]).persist(), styles, 100, 100))
    assert "Union" not in optimized and "LeftSemi" not in optimized


def test_captions_sort_words_once(talk):
    _, plan = planned(captions.events(talk, ["i"]))
    assert plan.count("Sort [") == 1 and "collect_list" not in plan


def test_tasks_keep_their_size(spark, talk, monkeypatch):
    monkeypatch.setattr(scans, "TASK_ROWS", 50)
    n = talk.count()
    for stretch in (None, F.floor(F.col("i") / 8)):
        found = captions.events(talk, ["i"], stretch=stretch, n_words=n)
        assert "RepartitionByExpression" in planned(found)[0]
        same(found, captions.events(talk, ["i"]), ["clip_id", "line", "start_ms", "end_ms", "text"])
    assert scans.dealt(talk, ["clip_id", "i"], n).rdd.getNumPartitions() == -(-n // 50) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scans.dealt(talk, ["clip_id"], None) is talk
