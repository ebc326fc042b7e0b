"""Nested specs: nothing is lost, and clips have the words that touch them."""

import random

import pytest
from pyspark.sql import functions as F

from reelspan.operators import spec, transcript
from reelspan.plans import queries
from reelspan.plans.fixtures import view
from reelspan.sources import tables


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_every_child_row_is_nested(spark, small, scale):
    d = small.replace("0.001", scale)
    specs = queries._specs(spark, d)
    boxes = F.flatten(F.transform("segments", lambda s: s["crop_boxes"]))
    frames = F.flatten(F.transform(boxes, lambda b: b["box_keyframes"]))
    total = lambda c: F.sum(F.size(c))
    found = specs.agg(
        total("segments").alias("segments"), total(boxes).alias("crop_boxes"), total(frames).alias("box_keyframes"), total("caption_styles").alias("caption_styles"), total("text_overlays").alias("text_overlays"),
        total("audio_tracks").alias("audio_tracks"), total("transitions").alias("transitions"), total("overlays").alias("overlays"), total("words").alias("words"), F.count(F.lit(1)).alias("clips"),
    ).first()
    count = lambda name, where="true": view(spark, d, name).where(where).count()
    assert [found[c] for c in ("segments", "crop_boxes", "box_keyframes", "caption_styles")] == [count(n) for n in ("segments", "crop_boxes", "box_keyframes", "clips")]
    assert [found.text_overlays, found.overlays] == [count("overlays", "id % 2 = 1"), count("overlays", "id % 2 = 0")]
    assert [found.audio_tracks, found.transitions] == [count("audio_tracks"), count("segments", "sort_order > 1")]
    words = transcript.clip_words(view(spark, d, "clips"), queries._transcripts(spark, d), view(spark, d, "words").withColumnRenamed("clip_id", "transcript_id"))
    assert found.words == words.count() > 0
    assert specs.select("clip_id").distinct().count() == found.clips
    # Keyframes are dealt over many boxes, not heaped on a few.
    held = view(spark, d, "dealt_keyframes").groupBy("box_id").count().agg(F.max("count"), F.count(F.lit(1))).first()
    assert held[0] <= 60 and held[1] > 100


def test_spoken_against_loops(spark):
    draw = random.Random(7)
    words, clips = [], []
    for t in range(4):
        for i in range(120):
            start = draw.choice([draw.randint(0, 400_000), 60_000 * draw.randint(0, 6)])
            words.append((t, i, f"w{i}", start, start + draw.choice([-5, 0, 1, 300, 70_000, 1 << 40])))
    for c in range(60):
        start = draw.choice([draw.randint(0, 400_000), 60_000 * draw.randint(0, 6)])
        clips.append((c, c % 6, start, start + draw.choice([0, 1000, 59_999, 60_000, 200_000])))
    transcripts = [(k, k, 5) for k in range(4)] + [(99, 3, 1)]
    w = spark.createDataFrame(words, "transcript_id bigint, i int, word string, start_ms bigint, end_ms bigint")
    c = spark.createDataFrame(clips, "clip_id bigint, video_id bigint, start_ms bigint, end_ms bigint")
    t = spark.createDataFrame(transcripts, "id bigint, video_id bigint, created_at bigint")
    got = {r.clip_id: [(x.start_ms, x.i) for x in r.words] for r in transcript.spoken(c, t, w, ["i"], ["i", "word", "start_ms"]).collect()}
    want = {}
    for k, video, lo, hi in clips:
        own = sorted((s, i) for v, i, _, s, e in words if v == video and e >= lo and s <= hi)
        if own:
            want[k] = own
    assert got == want
    flat = transcript.clip_words(c, t, w).groupBy("clip_id").count().collect()
    assert {r.clip_id: r["count"] for r in flat} == {k: len(v) for k, v in want.items()}


def test_specs_without_words_or_children(spark):
    clips = spark.createDataFrame([(1,), (2,)], "clip_id bigint")
    segments = spark.createDataFrame([], "id bigint, clip_id bigint, sort_order int")
    boxes = spark.createDataFrame([], "id bigint, segment_id bigint, slot_index int")
    frames = spark.createDataFrame([], "box_id bigint, kf_seq bigint, t_ms bigint")
    said = spark.createDataFrame([(1, [("hi", 5)])], "clip_id bigint, words array<struct<word: string, start_ms: bigint>>")
    rows = {r.clip_id: r for r in spec.clip_specs(clips, segments, boxes, frames, {}, said).collect()}
    assert rows[1].words[0].word == "hi" and rows[2].words == [] and rows[2].segments == []


def test_nested_by_clip(spark, small):
    segments, boxes = view(spark, small, "segments"), view(spark, small, "crop_boxes")
    frames = queries._dealt_keyframes(spark, small)
    own = ["box_id", "kf_seq", "t_ms", "x", "y", "w", "h"]
    rows = lambda df: sorted(map(tuple, df.select(*own).collect()))
    assert rows(frames) == rows(view(spark, small, "dealt_keyframes"))
    clips = segments.select("clip_id").distinct().unionByName(spark.sql("SELECT -1L AS clip_id"))
    specs = spec.clip_specs(clips, segments, boxes, frames, {}, by_clip=True).select("clip_id", "segments")
    other = spec.clip_specs(clips, segments, boxes.drop("clip_id"), frames.drop("clip_id"), {}).select("clip_id", "segments")
    assert {r.clip_id: r.segments for r in specs.collect()} == {r.clip_id: r.segments for r in other.collect()}


def test_specs_move_by_clip_and_are_compressed(spark, small, tmp_path):
    plan = queries._specs(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(f"hashpartitioning({c}#" in plan for c in ("segment_id", "id", "box_id"))
    tables.write_specs(spark.sql("SELECT '{}' AS json"), str(tmp_path / "specs"))
    assert list((tmp_path / "specs").glob("part-*.gz"))
