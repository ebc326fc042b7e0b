"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelspan.llm import bpe, exact_dedup, fingerprints, language_id, line_dedup, near_dedup, source_mix, substring_dedup, tool_calls, toxicity

#: Names that operators and stages use inside, and names that need quoting.
CLASHING = ["_maybe", "_key", "maybe", "key", "kept", "_id", "_words", "_size", "_times", "time", "hash", "_lang_pred", "score", "fit", "lang_pred", "th", "gone", "part", "bit", "bitmap", "d.x", "a`b", "_hash", "p", "d", "g", "N_Lines", "Doc_Id_", "Keep_ID", "_ROW", "Group_Size"]
SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, bucket string, `od.d` string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in CLASHING)
LONG = " ".join(f"word{k % 977}" for k in range(60_000))
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, "one", "en", None, 3), (5, "one", "en", "b", 3), (5, "one", "en", "b", 3),
    (6, "The same words again and again\nline two", "de", "a", None), (7, "The same words again and again\nline two", None, "c", None), (None, "no id", "en", "a", 5), (None, None, None, None, None),
    (8, LONG, "en", "d", None), (9, LONG + " end", "en", "e", None), (10, "é中😀́ \x00", "fr", "f", 5), (11, "12 34 !!", "en", "a", 8),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "n", "b", "x", *CLASHING) for r in ODD], SHAPE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1), (4, 0), (6, 0), (None, 1), (8, None)], "doc_id bigint, toxic int")


def ranks():
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


OPERATORS = {
    "line_dedup": lambda d, _: line_dedup.dedup_lines(d, min_sites=2),
    "fingerprints": lambda d, _: fingerprints.fingerprint_pairs(d),
    "source_mix": lambda d, _: source_mix.mixed(d),
    "substring": lambda d, _: substring_dedup.remove_repeats(d),
    "exact": lambda d, _: exact_dedup.exact_duplicates(d),
    "bpe": lambda d, _: bpe.encode_documents(d, *ranks()),
    "language": lambda d, _: language_id.identify(d),
    "near": lambda d, _: near_dedup.near_duplicates(d),
    "toxicity": lambda d, labels: toxicity.toxicity(d, labels),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, labels, name):
    rows = OPERATORS[name](odd, labels).collect()
    assert len(rows) == len(ODD)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in ODD)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(none, labels, name):
    assert OPERATORS[name](none, labels).collect() == []


def test_exact_ties(odd):
    rows = exact_dedup.exact_duplicates(odd).collect()
    ones = [r for r in rows if r.text_sha256 == hashlib.sha256(b"one").hexdigest()]
    assert [r.keep_id for r in ones] == [5, 5, 5] and sum(r.kept for r in ones) == 1 and {r.group_size for r in ones} == {3}
    empty = [r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in empty} == {2} and len(empty) == 3 and [r.doc_id for r in empty if r.kept] == [2]


def test_many_rows_of_one_id_and_text_stay_apart(spark, monkeypatch):
    from reelspan.llm import hot

    monkeypatch.setattr(hot, "HOT_ROWS", 1000)
    docs = spark.range(0, 200_000, 1, 8).select(F.lit(None).cast("bigint").alias("doc_id"), F.when(F.col("id") % 100 == 0, F.concat(F.lit("own "), "id")).otherwise("same").alias("text"))
    found = exact_dedup.exact_duplicates(docs)
    by_task = found.where("group_size > 1").groupBy(F.spark_partition_id()).count().collect()
    sizes = [r["count"] for r in by_task]
    assert sum(sizes) == 198_000 and max(sizes) < 0.6 * sum(sizes)
    kept = found.where("kept").groupBy("group_size").count().collect()
    assert {r.group_size: r["count"] for r in kept} == {1: 2000, 198_000: 1}


def test_rounds_keep_rows_out_of_the_shuffle(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(F.col("id") < 100, F.col("id") % 50).otherwise(F.col("id"))).alias("text"))
    digests = docs.select("doc_id", F.xxhash64("text").alias("_h"))
    passed = lambda bits: exact_dedup.marked(digests, 40_000, bits).where("NOT _maybe").count() / 40_000
    assert exact_dedup.rounds_for(40_000, 1 << 16) == 10
    # One filter of that size would be full.
    full = exact_dedup.bloom.build(digests.select("_h"), 40_000, repeated=True, max_bits=1 << 16)
    assert digests.where(~full.maybe("_h")).count() / 40_000 < 0.6
    assert passed(1 << 16) > 0.95 and passed(1 << 20) > 0.95
    small = sorted(map(tuple, exact_dedup.exact_duplicates(docs, max_bits=1 << 16).collect()))
    assert small == sorted(map(tuple, exact_dedup.exact_duplicates(docs).collect())) and sum(not r[3] for r in small) == 50


def test_near_ties(odd):
    rows = near_dedup.near_duplicates(odd, shingle_words=2).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(0, 1, True)] and by[3] == [(0, 3, True)] and by[4] == [(1, 4, True)] and by[5] == [(1, 4, False)] * 2
    assert by[7][0][1:] == (6, False) and by[9][0][1:] == (8, False)


def test_substring_ties(odd):
    rows = {r.doc_id: r for r in substring_dedup.remove_repeats(odd).collect()}
    # LONG repeats itself, but only what an earlier document has goes.
    assert rows[8].n_removed == 0 and rows[9].n_removed == 60_000 and rows[9].kept_text == "end" and rows[1].n_words == 0


def test_line_sites(odd):
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(odd, min_sites=2).collect()}
    assert rows[6].n_removed == 0 and rows[7].n_removed == 2 and rows[7].text == "" and rows[1].text is None and rows[1].n_lines == 0
    assert rows[6]["od.d"] == "x"


def test_every_line_of_one_site(spark):
    docs = spark.createDataFrame([(1, "a\nb\na", "s"), (2, "b\nc", None), (3, None, "t"), (4, "c\n ", "t")], "doc_id bigint, text string, source string")
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs, min_sites=1).collect()}
    assert [rows[k].text for k in (1, 2, 3, 4)] == ["a\nb", "c", None, " "] and [rows[k].n_removed for k in (1, 2, 3, 4)] == [1, 1, 0, 1]


def test_hot_lines_and_keys(spark, monkeypatch):
    from reelspan.llm import hot

    monkeypatch.setattr(hot, "HOT_ROWS", 3)
    docs = spark.createDataFrame([(k, f"everywhere\nonly {k}\nsome {k // 4}", f"s{k}") for k in range(40)], "doc_id bigint, text string, source string")
    rows = {r.doc_id: r for r in line_dedup.dedup_lines(docs, min_sites=4).collect()}
    assert all(rows[k].text == "\n".join((["everywhere"] if not k else []) + [f"only {k}"] + ([f"some {k // 4}"] if k % 4 == 0 else [])) for k in range(40))




def test_stages_keep_clashing_columns(spark):
    rows = [(i, t, x, s, n, *[f"{c} of {i}" for c in CLASHING]) for i, t, x, s, n in ODD]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id bigint, text string, lang string, source string, n_chars bigint", *(f"`{c.replace('`', '``')}` string" for c in CLASHING)]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found and all(r[5 + k] == f"{c} of {r.doc_id}" for r in found for k, c in enumerate(CLASHING)), name
    assert corpus_pipeline.tokens(spark, docs, "").count() == len(ODD)


def test_pairs_of_extreme_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 10)
    ids = [-(1 << 63), (1 << 63) - 1, 0, *[7] * 120, *range(100, 160), *[None] * 50]
    rows = [(i, f"{k:05d} text " * (k % 5 + 1)) for k, i in enumerate(ids)]  # half of each tells it from the others
    got = fingerprints.fingerprint_pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(got) == len(rows) and len({r.fingerprint for r in got}) == len(rows)
    one = {r.doc_id: r for r in got if r.doc_id not in (7, None)}
    edited = lambda a, b: a[: len(a) - len(a) // 2] + b[: len(a) // 2]
    text = {i: t for i, t in rows if i not in (7, None)}
    for a, b in [((1 << 63) - 1, 159), (101, 100)]:
        assert one[a].edited_sha256 == hashlib.sha256(edited(text[a], text[b]).encode()).hexdigest()
    # Those without an id come last; after the last of them comes the largest.
    nones = [t for i, t in rows if i is None]
    assert one[-(1 << 63)].edited_sha256 in {hashlib.sha256(edited(text[-(1 << 63)], t).encode()).hexdigest() for t in nones}
    sevens = [t for i, t in rows if i == 7]
    assert one[100].edited_sha256 in {hashlib.sha256(edited(text[100], t).encode()).hexdigest() for t in sevens}
    # Each text's first half is followed by that of one other, and none is next twice.
    after = collections.Counter()
    whole = {hashlib.sha256(edited(a, b).encode()).hexdigest(): b for a in nones for b in [*nones, text[(1 << 63) - 1]]}
    for r in got:
        if r.doc_id is None:
            after[whole[r.edited_sha256]] += 1
    assert len(after) == 50


def test_many_sources(spark):
    rows = [(k, "w " * (k % 17 + 1), None if k == 5 else f"s{k % 900:04d}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.source: r for r in source_mix.source_targets(docs.select("source", source_mix.n_words("text").alias("size"))).collect()}
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    open_, target = set(names), {}
    while open_:
        left, total = 1.5 * sum(size.values()) - sum(target.values()), sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * size[s]}
        target.update({s: 2.0 * size[s] for s in full} if full else {s: left * weight[s] / total for s in open_})
        open_ -= full or open_
    assert [found[s].place for s in names] == list(range(len(names))) and all(abs(found[s].target - target[s]) < 1e-6 for s in names)


def test_values_of_null_and_empty_texts(odd, labels):
    nothing = hashlib.sha256(b"").hexdigest()
    pairs = {r.doc_id: r for r in fingerprints.fingerprint_pairs(odd).collect() if r.doc_id in (1, 2)}
    assert all((r.n_chars, r.edited_sha256, r.near_edited, r.common_prefix) == (0, nothing, 1.0, 0) for r in pairs.values())
    assert pairs[1].fingerprint == pairs[2].fingerprint == pairs[1].edited_fingerprint and pairs[2].near_next == 1.0  # the next one is null
    codes = {r.doc_id: r for r in bpe.encode_documents(odd, *ranks()).collect() if r.doc_id in (1, 2, 10)}
    assert all((codes[k].n_tokens, bytes(codes[k].ids), bytes(codes[k].decoded)) == (0, b"", b"") for k in (1, 2))
    assert bytes(codes[10].decoded).decode() == ODD[12][1] and codes[10].n_tokens * 4 == len(codes[10].ids)
    scores = {r.doc_id: r for r in toxicity.toxicity(odd, labels).collect() if r.doc_id in (1, 2, 3, 11)}
    assert len({(r.score, r.predicted, tuple(r.evidence)) for r in scores.values()}) == 1 and scores[1].evidence == [] and abs(scores[1].score - 0.1) < 1e-9
    kept = {r.doc_id: r for r in substring_dedup.remove_repeats(odd).collect()}
    assert all((kept[k].n_words, kept[k].n_removed, kept[k].kept_text) == (0, 0, "") for k in (1, 2, 3))


def test_tokens_of_an_empty_table(spark, none):
    out = corpus_pipeline.tokens(spark, none, "")
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.collect() == []


def test_mix_takes_no_more_than_twice(odd):
    rows = source_mix.mixed(odd).collect()
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5


def test_language_of_nothing(odd):
    rows = {r.doc_id: r for r in language_id.identify(odd).collect()}
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (1, 2, 3, 11))


def test_pipeline_stages(spark, odd, none):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, "").columns == docs.columns, name
            assert stage(spark, frame, "").count() >= 0
    kept = [r.doc_id for r in corpus_pipeline.one_of_each(spark, docs.where("doc_id IS NOT NULL"), "").collect()]
    assert sorted(kept) == [1, 2, 3, 4, 6, 8, 10, 11]


def test_near_stage_keeps_rows_without_an_id(spark):
    copied, near = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, copied), (None, copied), (None, "alone without an id"), (None, near), (None, near + " end"), (None, "twice the same"), (None, "twice the same"), (None, ""), (7, "with an id")]
    for top in (7, (1 << 63) - 1):
        docs = spark.createDataFrame([(top if i == 7 else i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        kept = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
        assert [r for r in kept if r[0] is not None] in ([(1, copied), (top, "with an id")], [(top, "with an id"), (1, copied)])
        none = sorted(t for i, t in kept if i is None)
        if top == 7:
            assert [t for t in none if t not in (near, near + " end")] == ["", "alone without an id", "twice the same"] and len(none) == 4
        else:  # no room above the ids: copies may stay, nothing is lost
            assert {"", "alone without an id", "twice the same"} <= set(none) and {near, near + " end"} & set(none)


CALLS = "conv_id string, call_id string, position int, name string, arguments string, depends_on array<string>"


def test_calls(spark):
    own = tool_calls.Schema("object", fields={"n": tool_calls.Schema("integer", least=0, most=9), "s": tool_calls.Schema("string", required=False)})
    rows = [
        ("c", "a", "f", '{"s": "x", "n": 3}', ["b"]), ("c", "b", "f", '{"n": 1}', []), ("c", "x", "f", '{"n": 1}', ["y"]), ("c", "y", "f", '{"n": 1}', ["x"]), ("c", "z", "f", '{"n": 1}', ["y"]),
        ("c", "e1", "f", "{", None), ("c", "e2", "g", "{}", ["gone"]), ("c", "e3", "f", '{"n": "1", "t": null}', []), ("c", "e4", "f", '{"n": 10}', []), ("c", "e5", "f", None, []), ("c", "e6", "f", "[1]", []), ("c", "e7", "f", "{}", []),
        ("d", "a", "f", '{"n": 0}', []), (None, "a", "f", "{}", []), ("d", None, "f", "{}", []), ("d", "a", "f", '{"n": 7}', ["a"]), (None, "a", "f", "{}", []),
    ]
    rows = [(c, i, k, *rest, "v", 1) for k, (c, i, *rest) in enumerate(rows)]
    calls = spark.createDataFrame(rows, CALLS + ", place string, links int")  # names that the operator uses inside
    results = spark.createDataFrame([("c", "a", 'say "é"\n', 1), ("c", "a", "zz", 1), ("d", "q", None, 1), ("d", "a", None, 1), ("c", None, "lost", 1)], "conv_id string, call_id string, content string, status int")
    messages = spark.createDataFrame([("c", 0, "system", LONG), (None, None, None, None)], "conv_id string, position int, role string, content string")
    found = tool_calls.link_calls(calls, results, {"f": own}, messages).collect()
    got = {(r.conv_id, r.call_id): r for r in found if r.status not in ("unlinked", "message")}
    assert len(got) == 14 and len(found) == 20
    assert sorted((str(r.conv_id), str(r.call_id), r.errors) for r in found if r.status == "unlinked") == [("None", "a", "missing:n")] * 2 + [("c", "None", ""), ("d", "None", "missing:n")]
    assert sorted(r.json for r in found if r.status == "message") == ['{"content":"' + LONG + '","role":"system"}', '{"content":null,"role":null}']
    assert got[("c", "a")].json == '{"arguments":{"n":3,"s":"x"},"id":"a","name":"f","result":"say \\"é\\"\\n","status":"answered"}'
    assert [tuple(got[("c", k)])[2:6] for k in "ab"] == [(0, 1, "b", 1), (1, 1, "b", 0)] and got[("c", "b")].status == "unanswered"
    assert {got[("c", k)].status for k in "xyz"} == {"cyclic"} and got[("d", "q")].status == "orphan" and got[("d", "a")].status == "answered"
    errors = {k: got[("c", k)].errors for k in ("e1", "e2", "e3", "e4", "e5", "e6", "e7")}
    assert errors == {"e1": "json", "e2": "tool", "e3": "type:n,unknown:t", "e4": "range:n", "e5": "json", "e6": "json", "e7": "missing:n"}
    assert tool_calls.link_calls(calls.where("false"), results.where("false"), {"f": own}, messages.where("false")).count() == 0


def test_nested_schemas(spark):
    s = tool_calls.Schema
    own = s("object", fields={
        "a.b": s("integer"), "it's \"q\"": s("boolean", required=False), "who": s("object", required=False, open=True, fields={"name": s("string", least=2, most=4)}),
        "tags": s("array", required=False, most=2, items=s("object", fields={"k": s("string", pattern="^x")})), "mode": s("string", required=False, one_of=('"on"', '"off"')), "any": s(required=False),
    })
    want = {
        '{"a.b": 3, "a": {"b": "x"}}': "unknown:a", '{"a.b": 3, "it\'s \\"q\\"": 1}': 'type:it\'s "q"', '{"a.b": 1, "who": {"name": "n", "more": 1}}': "length:who.name", '{"a.b": 1, "who": {}}': "missing:who.name",
        '{"a.b": 1, "tags": [{"k": "xa"}, {"k": "a", "z": 1}, 5]}': "pattern:tags[1].k,size:tags,type:tags[2],unknown:tags[1].z", '{"a.b": 1, "mode": "up"}': "enum:mode", '{"a.b": 1.5, "any": [1]}': "type:a.b",
        '{"a.b": 1, "mode": "on", "tags": [], "who": null}': "", '{"a.b": true, "tags": {"k": "x"}}': "type:a.b,type:tags",
    }
    rows = spark.createDataFrame(list(want.items()), "arguments string, want string")
    got = rows.select("arguments", F.array_join(tool_calls.argument_errors(F.lit("f"), "arguments", {"f": own}), ",").alias("got")).collect()
    assert {r.arguments: r.got for r in got} == want


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds, keep = [], tool_calls.stored
    monkeypatch.setattr(tool_calls, "stored", lambda df, name: rounds.append(name) or keep(df, name))
    monkeypatch.setattr(tool_calls, "STRETCH", 100)
    rows = [("f", f"{k:05d}", k, [f"{k + 1:05d}"]) for k in range(2000)] + [("b", f"{k:05d}", k, [f"{k - 1:05d}"]) for k in range(500)] + [("b", "x", 500, ["y"]), ("b", "y", 501, [])]
    rows += [("o", f"{k:05d}", k, [f"{(k + 1) % 777:05d}"]) for k in range(777)]
    # Each on two before it, behind a tangle: in no round at all.
    rows += [("m", f"{k:05d}", k, [f"{k - 1:05d}", f"{k - 2:05d}"] if k > 2 else [f"{k + 1:05d}"][: 2 - k]) for k in range(900)]
    found = tool_calls.ordered(spark.createDataFrame(rows, "conv_id string, call_id string, position int, depends_on array<string>")).collect()
    assert rounds.count("call-places") <= 15
    own = sorted((r.after_position, r.after_call, r.wave, r.call_id) for r in found if r.conv_id == "f")
    assert [x[-1] for x in own] == [f"{k:05d}" for k in reversed(range(2000))] and len(found) == 2000 + 502 + 900


def test_evidence(spark, odd, labels):
    rows = toxicity.toxicity(odd, labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert toxicity.toxicity(odd, labels.where("false")).agg(F.max("score")).first()[0] <= 0.5


def test_copies_of_toxic_examples_find_them(spark):
    draw = random.Random(4)
    learned = [i for i in range(1, 200) if zlib.crc32(str(i).encode()) % 3 != 1][:60]
    text = {i: " ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(30)) for i in learned}
    # Each toxic word stands in one example only, and most of a copy's own words in none.
    toxic = learned[:6]
    rows = [(i, text[i], "en") for i in learned] + [(1000 + i, text[i].upper() + " something else", "en") for i in learned]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in learned], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(got[1000 + i].evidence[0] == i for i in learned)
    assert min(got[1000 + i].score for i in toxic) > max(got[1000 + i].score for i in learned[6:])
    assert toxicity.toxicity(docs.selectExpr("doc_id", "'unseen ' || doc_id AS text"), labels.where("false")).where("size(evidence) > 0").count() == 0


def test_unknown_terms_count_in_the_length():
    model = toxicity.Model(toxicity.Vocabulary(np.array([5, 9], np.uint64)), np.array([1.0, 2.0]), None, 3.0, 0.1, 0.1)
    assert np.allclose(model.units(np.array([0, 2, 2]), np.array([1, -1]), np.array([1, 1])), np.array([2.0, 3.0]) / 13**0.5)


def test_cycles_of_drawn_calls(spark):
    draw = random.Random(18)
    edges = {(c, i): draw.sample(range(9), draw.randint(0, 2)) for c in range(40) for i in range(9)}
    rows = [(c, str(i), i, [*map(str, deps), "gone"]) for (c, i), deps in edges.items()]
    found = {(r.conv_id, int(r.call_id)): r for r in tool_calls.ordered(spark.createDataFrame(rows, "conv_id int, call_id string, position int, depends_on array<string>")).collect()}
    for c in range(40):
        left, done = set(range(9)), {}
        while ready := [i for i in left if all(d in done for d in edges[c, i])]:
            for i in ready:
                done[i] = max([(i, 0), *((done[d][0], done[d][1] + (d >= i)) for d in edges[c, i])])
                left.discard(i)
        assert {i: (found[c, i].after_position, found[c, i].wave) for i in range(9) if (c, i) in found} == done


def test_order_of_drawn_calls(spark):
    draw = random.Random(8)
    rows, edges = [], {}
    for c in range(25):
        order = list(range(draw.randint(1, 14)))
        draw.shuffle(order)  # the order that dependencies agree with
        for k, i in enumerate(order):
            deps = draw.sample(order[:k], min(k, draw.randint(0, 2)))
            edges[c, i] = deps
            rows.append((c, f"{i:03d}", i, [f"{d:03d}" for d in deps]))
    found = tool_calls.ordered(spark.createDataFrame(rows, "conv_id int, call_id string, position int, depends_on array<string>")).collect()
    assert len(found) == len(rows)
    for c in range(25):
        own = sorted((r.after_position, r.after_call, r.wave, int(r.call_id)) for r in found if r.conv_id == c)
        place = {x[-1]: n for n, x in enumerate(own)}
        assert all(place[d] < place[i] for (k, i), deps in edges.items() if k == c for d in deps)


def test_scratch_leaves_nothing(spark):
    import os

    from reelspan.llm import scratch

    name, folder = "spark.sql.execution.arrow.maxBytesPerBatch", scratch.run_dir(spark)
    before = spark.conf.get(name)
    have = sorted(os.listdir(folder)) if os.path.isdir(folder) else []
    with scratch.scratch(spark):
        docs = spark.createDataFrame([(1, "a b"), (2, "a b")], "doc_id bigint, text string")
        assert near_dedup.near_duplicates(docs, shingle_words=2).where("kept").count() == 1
        assert os.listdir(scratch.run_dir(spark))
    assert scratch.run_dir(spark) == folder and (sorted(os.listdir(folder)) if os.path.isdir(folder) else []) == have and spark.conf.get(name) == before
