"""Boundaries of the rules, on literal frames."""

import random

import pytest
from pyspark.sql import functions as F

from reelspan.functions import languages, media, text
from reelspan.catalog import QUERIES
from reelspan.operators import alignment, captions, edl, jobs, keyframes, spec, speech, transcript


def one(spark, values, column, kind="string"):
    """Results of a column over literal values, in order."""
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"n int, v {kind}")
    return [r.x for r in rows.select("n", column(F.col("v")).alias("x")).orderBy("n").collect()]


def words(spark, spans, marks=None):
    rows = [("c", i, (marks or {}).get(i, "w"), s, e) for i, (s, e) in enumerate(spans)]
    return spark.createDataFrame(rows, "clip_id string, i int, word string, start_ms bigint, end_ms bigint")


def ranges_of(spans):
    out = []
    for s, e in sorted(spans):
        if out and s - out[-1][1] < 500:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("seed", range(4))
def test_speech_ranges(spark, seed):
    draw = random.Random(seed)
    spans, t = [], 0
    for _ in range(60):
        t += draw.choice([0, 1, 299, 300, 499, 500, 501, 900])
        spans.append((t, t + draw.choice([0, 10, 700])))
        t = spans[-1][1] if draw.random() < 0.8 else t
    frame = words(spark, spans)
    for f in (speech.speech_ranges, speech.speech_sessions):
        assert sorted((r.start_ms, r.end_ms) for r in f(frame).collect()) == ranges_of(spans)


def test_words_that_end_early(spark):
    frame = words(spark, [(0, 100), (200, 150), (699, 710)])
    assert [(r.start_ms, r.end_ms) for r in speech.speech_ranges(frame).collect()] == [(0, 710)]
    assert speech.rejects(frame).first().n_rejected == 1


def lines_of(spans, marks):
    out, current = [], []
    for i, (_, e) in enumerate(spans):
        current.append(i)
        last = i == len(spans) - 1
        word = marks.get(i, "w").rstrip()
        if last or (word and word[-1] in ".!?।") or spans[i + 1][0] - e > 300 or len(current) >= 5:
            out.append(current)
            current = []
    return out


@pytest.mark.parametrize("seed", range(4))
def test_caption_lines(spark, seed):
    draw = random.Random(seed)
    spans, t, marks = [], 0, {}
    for i in range(80):
        t += draw.choice([0, 299, 300, 301])
        spans.append((t, t + 50))
        t += 50
        if draw.random() < 0.2:
            marks[i] = draw.choice(["a.", "a. ", "a!", "a?", "अ।", "a.\n", "", "a,"])
    found = captions.lines(words(spark, spans, marks), ["i"]).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.i):
        got.setdefault(r.line, []).append(r.i)
    assert [got[k] for k in sorted(got)] == lines_of(spans, marks)


def test_caption_events(spark):
    frame = words(spark, [(-50, 100), (120, 200), (900, 950)], {0: "a", 1: "b.", 2: "  "})
    assert [tuple(r) for r in captions.events(frame, ["i"]).collect()] == [("c", 0, 0, 400, "a b.")]
    clip = spark.createDataFrame([("c", 100, 900)], "clip_id string, start_ms bigint, end_ms bigint")
    assert captions.in_clips(frame, clip).count() == 3  # a word that ends at the start and one that starts at the end count


def aligned(a, b):
    """The alignment rule as a loop: times of each word of a."""
    import math

    def norm(w):
        return "".join(c for c in w.lower() if c.isalnum())

    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, k in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != k))
        return row[-1]

    def alike(x, y):
        x, y = norm(x), norm(y)
        n = max(len(x), len(y))
        return x == y or (n > 2 and distance(x, y) / n < 0.45)

    m, n = len(a), len(b)
    hit, least = [None] * m, 0
    half_up = lambda v: math.floor(v + 0.5)
    for i in range(m):
        ex, win = half_up(i * (n - 1) / max(m - 1, 1)), max(3, half_up(n / 4))
        near = [(abs(j - ex), j) for j in range(max(least, ex - win), min(n - 1, ex + win) + 1) if alike(a[i], b[j][0])]
        if near:
            hit[i] = min(near)[1]
            least = hit[i] + 1
    out = []
    for i in range(m):
        if hit[i] is not None:
            out.append(b[hit[i]][1:])
            continue
        lo = next((k for k in range(i - 1, -1, -1) if hit[k] is not None), -1)
        hi = next((k for k in range(i + 1, m) if hit[k] is not None), m)
        t0 = b[hit[lo]][2] if lo >= 0 else b[0][1]
        t1 = b[hit[hi]][1] if hi < m else b[-1][2]
        width, size = max(0.0, t1 - t0), hi - lo - 1
        out.append((t0 + (i - lo - 1) / size * width, t0 + (i - lo) / size * width))
    return out


def test_alignment(spark):
    draw = random.Random(5)
    stock = ["the", "a", "cat", "cart", "house", "horse", "mouse", "it's", "it", "?!", "go", "going"]
    phrases, anchors, want = [], [], {}
    for c in range(60):
        a = [draw.choice(stock) for _ in range(draw.randint(1, 9))]
        b, t = [], 0.25
        for _ in range(draw.randint(0, 9)):
            b.append((draw.choice(stock), t, t + 0.5))
            t += draw.choice([0.25, 0.75])
        phrases.append((c, 0, 0, " ".join(a), 0.0, 100.0))
        anchors += [(c, 0, j, *x) for j, x in enumerate(b)]
        anchors += [(c, 0, 50, "edge", -1.0, 0.0), (c, 0, 51, "edge", 100.0, 101.0)]  # touching is not overlapping
        want[c] = aligned(a, b) if b else [(i / len(a) * 100.0, (i + 1) / len(a) * 100.0) for i in range(len(a))]
    p = spark.createDataFrame(phrases, "clip_id int, chunk_idx int, phrase_idx int, phrase string, start_s double, end_s double")
    q = spark.createDataFrame(anchors, "clip_id int, chunk_idx int, anchor_idx int, word string, start_s double, end_s double")
    got = {}
    for r in alignment.align(p, q).orderBy("clip_id", "word_idx").collect():
        got.setdefault(r.clip_id, []).append((r.start_s, r.end_s))
    assert got.keys() == want.keys()
    for c in want:
        assert [x for t in got[c] for x in t] == pytest.approx([x for t in want[c] for x in t])


def test_similarity_bounds(spark):
    # Nine edits of twenty letters are 0.45 exactly, which is not alike.
    twenty = "abcdefghijklmnopqrst"
    pairs = [("ab", "ax", False), ("?!", "..", True), ("abc", "abd", True), (twenty, "X" * 9 + twenty[9:], False), (twenty, "X" * 8 + twenty[8:], True)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "n int, a string, b string")
    assert [r.x for r in frame.select("n", text.similar(F.col("a"), F.col("b")).alias("x")).orderBy("n").collect()] == [x for *_, x in pairs]
    assert one(spark, ["విలన్", "It's-9"], text.normalize_word) == ["వలన", "its9"]
    assert one(spark, [" a b c "], text.tokens) == [["a", "b", "c"]]


def test_clamped_ends(spark):
    rows = [("a", 0, 0.0, 0.5, 20.0), ("a", 1, 10.0, 10.5, 20.0), ("a", 2, 11.0, 11.5, 20.0), ("b", 0, 1.0, 9.0, 5.0)]
    frame = spark.createDataFrame(rows, "clip_id string, i int, start_s double, end_s double, total_s double")
    assert [r.end_s for r in transcript.clamp_ends(frame, ["i"]).orderBy("clip_id", "i").collect()] == [4.0, 11.0, 20.0, 9.0]


def test_keyframes(spark):
    frames = spark.createDataFrame([("a", 1, 100, 0.1), ("a", 0, 50, 0.2), ("a", 2, 100, 0.3), ("b", 0, 10, 0.4)], "box_id string, kf_seq bigint, t_ms bigint, x double")
    frames = frames.withColumns({c: F.lit(0.5) for c in "ywh"})
    probes = spark.createDataFrame([("a", 0), ("a", 50), ("a", 99), ("a", 100), ("a", 101), ("b", 0), ("z", 0)], "box_id string, q_ms bigint")
    got = {(r.box_id, r.q_ms): (r.x, r.w) for r in keyframes.position_at(probes, frames).collect()}
    assert got == {("a", 0): (0.2, 0.5), ("a", 50): (0.2, 0.5), ("a", 99): (0.2, 0.5), ("a", 100): (0.3, 0.5), ("a", 101): (0.3, 0.5), ("b", 0): (0.4, 0.5), ("z", 0): (0.0, 1.0)}
    slots = spark.createDataFrame([("s", 0, "a", 60, 200), ("s", 1, None, 0, 9)], "segment_id string, slot int, box_id string, start_ms bigint, end_ms bigint")
    track = [(r.slot, r.start_ms, r.end_ms, r.crop_x, r.crop_w) for r in keyframes.crop_track(slots, frames, 100, 100).orderBy("slot", "start_ms").collect()]
    assert track == [(0, 60, 100, 20.0, 50.0), (0, 100, 200, 30.0, 50.0), (1, 0, 9, 0.0, 100.0)]


def test_keyframes_against_loops(spark):
    draw = random.Random(11)
    frames = [(draw.choice("abc"), n, draw.choice([draw.randint(-50, 400), 100 * draw.randint(0, 4)]), n / 1000) for n in range(200)] + [("late", 0, 10_000_000, 0.7)]
    probes = [(draw.choice(["a", "b", "c", "late", "none", None]), draw.randint(-100, 600), k) for k in range(300)]
    f = spark.createDataFrame(frames, "box_id string, kf_seq bigint, t_ms bigint, x double").withColumns({c: F.lit(0.5) for c in "ywh"})
    p = spark.createDataFrame(probes, "box_id string, q_ms bigint, n int")
    for width in (7, 100, keyframes.PIECE_MS):
        got = {r.n: r.x for r in keyframes.position_at(p, f, width).collect()}
        for box, q, n in probes:
            own = sorted((t, seq, x) for b, seq, t, x in frames if b == box)
            at = [x for t, _, x in own if t <= q]
            assert got[n] == (at[-1] if at else own[0][2] if own else 0.0), (box, q, width)


def test_a_busy_box_is_many_groups(spark):
    f = spark.range(20_000).select(F.lit("hot").alias("box_id"), F.col("id").alias("kf_seq"), (F.col("id") * 1000).alias("t_ms"), *[F.lit(0.5).alias(c) for c in "xywh"])
    p = spark.range(20_000).select(F.lit("hot").alias("box_id"), (F.col("id") * 997).alias("q_ms"))
    sizes = [r["count"] for r in keyframes.pieces(p, f, 60_000).groupBy("box_id", "_piece").count().collect()]
    assert len(sizes) > 300 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    # The only window over a whole box has a row for each stretch.
    assert keyframes.position_at(p, f, 60_000).count() == 20_000


def telugu(word, keep):
    out, i = "", 0
    while i < len(word):
        c = word[i]
        after = word[i + 1] if i + 1 < len(word) else ""
        if c in languages.CONSONANTS:
            out += languages.CONSONANTS[c] + ("" if after and after in languages.SIGNS else "a")
        else:
            out += (languages.VOWELS | languages.SIGNS | languages.CODAS).get(c, c if c in keep else "")
        i += 1
    return out.lower()


def test_telugu(spark):
    assert one(spark, ["విలన్", "నేను", "అం", "కః", "సినిమా Hit1"], languages.romanize_telugu) == ["vilan", "nenu", "am", "kah", "sinimaa hit1"]
    draw = random.Random(1)
    letters = "".join(languages.CONSONANTS) + "".join(languages.SIGNS) * 2 + "".join(languages.VOWELS) + "ంః" + "aZ9 .,!?'-*ñ"
    drawn = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 9))) for _ in range(500)]
    keep = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .,!?'-"
    assert one(spark, drawn, languages.romanize_telugu) == [telugu(w, keep) for w in drawn]
    got = one(spark, ["విలన్.", "Hello", "  ", "१२", None], lambda w: languages.roman_word(w, F.lit("te-IN")))
    assert got == ["vilan", "hello", None, None, None]
    assert one(spark, ["విలన్*", "abc", None], lambda w: languages.display_with_script(w, F.lit(""))) == ["vilan*", "abc", ""]


def test_codes(spark):
    assert one(spark, ["te-IN", "te", "telugu", "od-IN", "or", "xx", ""], languages.short_code) == ["te", "te", "te", "or", "or", "xx", ""]
    assert one(spark, ["od-IN"], lambda c: languages.short_code(c, strict_reference=True)) == ["od"]
    assert one(spark, ["ଅ", "abc", "அ अ"], languages.script_locale) == [None, None, "hi-IN"]


def test_lists(spark):
    answers = ['["a","b"]', '```json\n["a"," "]\n```', '{"words":["x",2,null]}', '{"0":"a","1":"b"}', "[", None]
    assert one(spark, answers, text.model_list) == [["a", "b"], ["a", None], ["x", None, None], ["a", "b"], None, None]
    assert one(spark, ["[0] a [1] b", "x [0]", ""], text.split_markers) == [["a", "b"], [""], []]
    assert one(spark, ["éçñṅś"], text.strip_diacritics) == ["ecnns"]
    assert one(spark, ["a.", "a. ", "a", "", None, "अ।"], text.ends_sentence) == [True, True, False, False, False, True]
    assert one(spark, ["a. "], lambda w: text.ends_sentence(w, trim=False)) == [False]


def test_media(spark):
    assert one(spark, [0, 9, 10, 59_999, 60_000, 3_599_999, 36_000_000], media.ass_time, "bigint") == ["0:00:00.00", "0:00:00.00", "0:00:00.01", "0:00:59.99", "0:01:00.00", "0:59:59.99", "10:00:00.00"]
    assert one(spark, ["#fff", "#FFFFFF", "0a0b0c"], media.ass_color) == ["&H00FFFFFF", "&H00FFFFFF", "&H000C0B0A"]
    plans = one(spark, ["12.5", "N/A", "", "0", "1800", "5000", None], media.encode_budget)
    assert [(p.duration_s, p.video_kbps, p.trimmed) for p in plans] == [(12.5, 28739, False), *[(60.0, 5911, False)] * 3, (1800.0, 104, False), (1800.0, 104, True), (60.0, 5911, False)]
    assert one(spark, ["a/b.mp4", "nodot"], media.audio_key) == ["a/b_audio.flac", "nodot"]
    assert one(spark, ["480p", "x", None], lambda q: media.dimensions(q)["w"]) == [480, 1080, 1080]
    assert one(spark, ["out_time_ms=2500000", "x"], media.encoded_seconds) == [2.5, None]
    assert one(spark, [0, 1800], lambda s: media.encode_progress(s, F.lit(60.0)), "int") == [47, 55]


def test_jobs(spark):
    rows = [
        ("link", "{}"), ("upload", '{"storage_path":"a"}'), ("again", '{"storage_path":"a","is_retranscribe":true}'),
        ("clip", '{"clip_id":"c","clip_start_ms":0,"clip_end_ms":5}'), ("null", '{"storage_path":"a","clip_id":"c","clip_start_ms":null,"clip_end_ms":5}'), ("half", '{"storage_path":"a","clip_id":"c","clip_start_ms":1}'),
    ]
    found = {r.id: r.route for r in jobs.routes(spark.createDataFrame(rows, "id string, payload string")).collect()}
    assert found == {"link": "fetch_only", "upload": "mark_ready", "again": "transcribe", "clip": "transcribe", "null": "transcribe", "half": "mark_ready"}


def test_slots_and_sources(spark):
    segments = spark.createDataFrame([("s1", "c", 0, "split", 0, 1000), ("s2", "c", 1, "odd", 2000, 2500)], "id string, clip_id string, sort_order int, layout string, start_ms bigint, end_ms bigint")
    boxes = spark.createDataFrame([("b1", "s1", 30, "v1", 500), ("b2", "s1", 10, None, 0), ("b3", "s2", 0, "gone", 0)], "id string, segment_id string, slot_index int, source_video_id string, source_offset_ms bigint")
    videos = spark.createDataFrame([("v1", "p"), ("v2", "")], "video_id string, storage_path string")
    got = [(r.segment_id, r.slot, r.box_id, r.source_video_id, r.in_ms, r.out_ms, r.dst_y, r.output_start_ms) for r in edl.cut_list(segments, boxes, 10, 21, videos).orderBy("segment_id", "slot").collect()]
    assert got == [("s1", 0, "b2", None, 0, 1000, 0, 0), ("s1", 1, "b1", "v1", 500, 1500, 10, 0), ("s2", 0, "b3", None, 2000, 2500, 0, 1000)]
    counts = {r.source_video_id: r.n_slots for r in edl.source_counts(edl.slots(segments, boxes, videos)).collect()}
    assert counts == {None: 2, "v1": 1}
    clip_boxes = boxes.withColumn("clip_id", F.lit("c"))
    assert [tuple(r) for r in spec.secondary_sources(clip_boxes, videos).collect()] == [("c", "v1", "p")]
    missing = spec.missing_assets(spark.createDataFrame([("p",), ("q",)], "key string"), spark.createDataFrame([("p",)], "key string"))
    assert [r.key for r in missing.collect()] == ["q"]


def test_nested_spec(spark):
    clips = spark.createDataFrame([("c",), ("d",)], "clip_id string")
    segments = spark.createDataFrame([("s2", "c", 1), ("s1", "c", 0)], "id string, clip_id string, sort_order int")
    boxes = spark.createDataFrame([("b", "s1", 0)], "id string, segment_id string, slot_index int")
    frames = spark.createDataFrame([("b", 1, 9), ("b", 0, 5)], "box_id string, kf_seq bigint, t_ms bigint")
    specs = {r.clip_id: r for r in spec.clip_specs(clips, segments, boxes, frames, {}).collect()}
    assert [s.id for s in specs["c"].segments] == ["s1", "s2"] and specs["d"].segments == []
    assert [k.t_ms for k in specs["c"].segments[0].crop_boxes[0].box_keyframes] == [5, 9] and specs["c"].segments[1].crop_boxes == []
    json = spec.as_json(spec.clip_specs(clips, segments, boxes, frames, {}).withColumn("note", F.lit(None).cast("string"))).first().json
    assert '"note":null' in json


def test_languages_of_chunks(spark):
    rows = [("a", 0, None, None), ("a", 1, "hi", None), ("a", 2, "", None), ("a", 3, "unknown", None), ("b", 0, "te-IN", None), ("b", 1, "hi", None), ("c", 0, "te", "ta-IN"), ("c", 1, "te", "ta-IN")]
    frame = spark.createDataFrame(rows, "clip_id string, chunk_idx int, lang string, given string")
    assert {r.clip_id: r.language for r in transcript.transcript_language(frame).collect()} == {"a": "hi", "b": "hi", "c": "te"}
    asked = {(r.clip_id, r.chunk_idx): r.request_lang for r in transcript.request_language(frame).collect()}
    assert asked[("b", 0)] == "unknown" and asked[("b", 1)] == "te-IN" and asked[("c", 0)] == "ta-IN" and asked[("a", 2)] == "unknown"
    plan = transcript.chunk_plan(spark.createDataFrame([("a", 50.0), ("b", 50.1), ("c", 0.0)], "video_id string, total_s double"))
    assert {r.video_id: r.n for r in plan.groupBy("video_id").agg(F.count("*").alias("n")).collect()} == {"a": 2, "b": 3}


def test_crop_track_against_loops(spark):
    draw = random.Random(5)
    frames = [(draw.choice("abc"), n, 100 * draw.randint(-3, 60), n / 1000) for n in range(120)] + [("twice", 0, 500, 0.6), ("twice", 1, 500, 0.7), ("twice", 2, 900, 0.8), ("late", 0, 10_000_000, 0.9)]
    slots = []
    for n in range(300):
        start = draw.randint(-500, 6500)
        slots.append((n, draw.choice(["a", "b", "c", "twice", "late", "none", None]), start, start + draw.choice([0, 1, 30, 700, 5000, 90_000, 20_000_000])))
    slots += [(300, "a", 50, 20), (301, "a", None, 50), (302, "a", 250, None), (303, "twice", -(1 << 62), 1 << 62)]
    f = spark.createDataFrame(frames, "box_id string, kf_seq bigint, t_ms bigint, x double").withColumns({c: F.lit(0.5) for c in "ywh"})
    s = spark.createDataFrame(slots, "segment_id int, box_id string, start_ms bigint, end_ms bigint").withColumn("slot", F.lit(0))
    want = []
    for n, box, start, end in slots:
        own = sorted((t, seq, x) for b, seq, t, x in frames if b == box)
        if start is None or not own:
            want.append((n, start, end, 0.0))
            continue
        at = [x for t, _, x in own if t <= start]
        pieces = [(start, at[-1] if at else own[0][2])]
        for t in sorted({t for t, _, _ in own if end is not None and start < t < end}):
            here = [x for u, _, x in own if u == t]
            if t > own[0][0] or len(here) > 1:
                pieces.append((t, here[-1]))
        stops = [t for t, _ in pieces[1:]] + [end]
        want += [(n, t, stop, x * 1000) for (t, x), stop in zip(pieces, stops)]
    for width in (64, 1000, keyframes.PIECE_MS):
        got = [(r.segment_id, r.start_ms, r.end_ms, r.crop_x) for r in keyframes.crop_track(s, f, 1000, 1000, width).collect()]
        key = lambda r: (r[0], r[1] is not None, r[1] or 0)
        assert [(*r[:3], round(r[3], 6)) for r in sorted(got, key=key)] == [(*r[:3], round(r[3], 6)) for r in sorted(want, key=key)], width


def test_crop_track_computes_slots_once_and_moves_them_once(spark, small):
    """The query's slots are read back, never derived again, and meet keyframes in one join without being sorted by time."""
    plan = QUERIES["crop_track"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_orderkey" not in plan and "nth_value" not in plan
    assert "segment_id" not in "".join(line for line in plan.split("\n") if "Window" in line)


def test_slots_by_clip_do_not_move(spark):
    n = 9
    segments = spark.range(400).select((F.col("id") % 50).alias("clip_id"), "id", F.lit(0).alias("sort_order"), F.element_at(F.array(*map(F.lit, ["split", "trio", "odd"])), (F.col("id") % 3 + 1).cast("int")).alias("layout"), F.lit(0).alias("start_ms"), F.lit(9).alias("end_ms"))
    boxes = spark.range(1200).where("id % 400 % 4 < 3").select((F.col("id") % 400 % 50).alias("clip_id"), "id", (F.col("id") % 400).alias("segment_id"), (-F.col("id")).alias("slot_index"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("source_video_id"), F.col("id").alias("source_offset_ms"))
    want = sorted((k, j, (k + 400 * (2 - j)) if k % 4 < 3 else None) for k in range(400) for j in range((2, 3, 1)[k % 3]))
    for by_clip in (False, True):
        got = edl.slots(segments.repartition(n, "clip_id"), boxes.repartition(n, "clip_id"), by_clip=by_clip)
        assert sorted((r.segment_id, r.slot, r.box_id) for r in got.collect()) == want
        assert all(r.source_video_id == (r.box_id % 7 if r.box_id % 5 else None) for r in got.where("box_id IS NOT NULL").collect())
        assert ("ENSURE_REQUIREMENTS" in got._jdf.queryExecution().executedPlan().toString()) == (not by_clip)
