"""Fill-in-middle, vector codes and the suffix model: brute force, round trips and odd rows."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.llm import fill_in_middle, suffix_model, vector_codes


def fim(i, t):
    """The contract as written."""
    t = t or ""
    digits = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digits[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return len(t), *(("spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"))


def test_fill_in_middle(spark):
    draw = random.Random(3)
    letters = ["a", "b ", "<", ">", "P", "é", "中", "😀", "́", "\x00", "\n"]
    rows = [(None, None), (1, None), (2, ""), (3, "x<S>y"), (4, "<P"), (None, "no id"), (5, "é" * 300_000 + "tail" * 100_000), (-7, "negative"), (8, "same"), (8, "same")]
    rows += [(k, "".join(draw.choices(letters, k=draw.randint(0, 60)))) for k in range(10, 400)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = fill_in_middle.fill_in_middle(frame)
    got = found.select("*", fill_in_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, *fim(i, t)) for i, t in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    text = collections.defaultdict(list)
    for i, t in rows:
        text[i].append(t or "")
    for r in got:
        if r.form != "plain" and r.doc_id is not None:
            whole = text[r.doc_id][0]
            assert r.prefix_bytes == len(whole[: r.prefix_chars].encode()) and r.middle_bytes == len(whole[r.prefix_chars :][: r.middle_chars].encode())
    assert fill_in_middle.fill_in_middle(frame.limit(0)).collect() == []


def test_fill_in_middle_of_clashing_columns_and_sentinels(spark):
    frame = spark.createDataFrame([(1, "ab" * 20, 5, "x", "y", 1, 2, "z")], "`d.id` bigint, `a``t` string, n int, output string, _hash string, _a int, _b int, FORM string")
    r = fill_in_middle.fill_in_middle(frame, text="a`t", id_col="d.id", sentinels=("[pre]", "[suf]", "[mid]"), plain_from=100, spm_below=100).first()
    assert r.form == "spm" and r.output.startswith("[suf]") and r.output.replace("[suf]", "").replace("[pre]", "").replace("[mid]", "").count("ab") >= 17
    for bad in (("<P>", "<P>", "<M>"), ("<>", "><", "<M>"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle.fill_in_middle(frame, text="a`t", id_col="d.id", sentinels=bad)


def test_exception_index():
    text = "a中é😀bc😀"
    data = text.encode()
    index = fill_in_middle.ExceptionIndex(np.frombuffer(data, np.uint8))
    cuts = [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert index.bytes(np.arange(len(text) + 1)).tolist() == cuts and index.chars(np.array(cuts)).tolist() == list(range(len(text) + 1))
    assert len(index.bytes_at) == 4  # ASCII is not recorded


def codes_of(rows, parts, entries, rounds, scale=256):
    kept = [(i is None, i or 0, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[:3])
    x = np.array([r[2] for r in kept])
    cuts = [k * x.shape[1] // parts for k in range(parts + 1)]
    books = [x[:entries, a:b].copy() for a, b in zip(cuts, cuts[1:])]

    def assign():
        code, error = np.zeros((len(x), parts), int), np.zeros(len(x), int)
        for k, book in enumerate(books):
            d = ((x[:, None, cuts[k] : cuts[k + 1]] - book[None]) ** 2).sum(2)
            code[:, k] = d.argmin(1)
            error += d.min(1)
        return code, error

    for _ in range(rounds):
        code, _ = assign()
        for k, book in enumerate(books):
            for e in range(len(book)):
                own = x[code[:, k] == e, cuts[k] : cuts[k + 1]]
                if len(own):
                    book[e] = own.sum(0) // len(own)
    code, error = assign()
    by = collections.Counter()
    for r, e in zip(kept, error):
        by[r[3]] += int(e)
    return [(None if r[0] else r[1], "".join(f"{c:02x}" for c in code[n]), int(error[n]), by[r[3]]) for n, r in enumerate(kept)], books


@pytest.mark.parametrize("parts,dimension,entries", [(4, 16, 8), (16, 64, 64), (3, 7, 5)])
def test_vector_codes(spark, parts, dimension, entries):
    draw = np.random.default_rng(parts)
    grid = np.round(draw.normal(size=(300, dimension)), 1)  # coarse: ties and equal parts
    rows = [(int(k), [float(c) for c in v], int(k) % 3 if k % 5 else None) for k, v in enumerate(grid)]
    rows += [(None, rows[3][1], None), (7, rows[9][1], 1), (7, rows[9][1], 1), (1000, None, 1), (1001, [None] * dimension, 2), (1002, [math.nan] * dimension, 2), (1003, [math.inf] * dimension, 2)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(5)
    found, books = vector_codes.compress(frame, parts=parts, entries=entries)
    want, want_books = codes_of(rows, parts, entries, 2)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert all((a == b).all() for a, b in zip(books, want_books))
    assert vector_codes.decoded(want[0][1], books).shape == (dimension,)


def test_vectors_that_do_not_fit_and_odd_tables(spark):
    shape = "vec_id bigint, embedding array<float>, label string, _x string, code string, ERROR int"
    rows = [(1, [1.0, -0.5], "a", "", "", 1), (2, [1.0], "a", "", "", 1), (3, [1.0e30, 0.0], None, "", "", 1), (4, [0.25, 0.25], "", "", "", 1), (5, [], None, "", "", 1)]
    found, books = vector_codes.compress(spark.createDataFrame(rows, shape), parts=2, rounds=0)
    assert sorted(map(tuple, found.collect())) == [(1, "0000", 0, 0), (4, "0101", 0, 0)] and books[1].tolist() == [[-128], [64]]
    for some in (rows[:0], rows[-1:], [(1, None, "a", "", "", 1)]):
        found, books = vector_codes.compress(spark.createDataFrame(some, shape))
        assert found.collect() == [] and all(not b.size for b in books)


def test_hot_labels(spark, monkeypatch):
    from reelspan.llm import hot

    monkeypatch.setattr(hot, "HOT_ROWS", 20)
    rows = [(k, [float(k % 7), float(k % 11)], None if k % 2 else k % 30) for k in range(200)]
    found, _ = vector_codes.compress(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), parts=2, entries=4)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(codes_of(rows, 2, 4, 2)[0], key=key)


def test_pivots_rule_out_and_lose_nothing():
    draw = np.random.default_rng(9)
    parts, entries = draw.integers(-300, 300, (3000, 4)), draw.integers(-300, 300, (64, 4))
    entries[40], entries[41] = entries[3], entries[3]
    pivots = entries[vector_codes.pivots_of(entries)]
    code, error, evaluated = vector_codes.nearest(parts, vector_codes.distances(parts, pivots), entries, vector_codes.distances(entries, pivots).T)
    every = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (code == every.argmin(1)).all() and (error == every.min(1)).all()
    assert evaluated < 0.25 * every.size


def tree_scores(rows, depth, least, gain, discount=0.75, added=0.1):
    """The definition with dictionaries: (n_tokens, n_known, base, score) by row."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    docs = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None] for _, t, _ in rows]
    held = [h for *_, h in rows]
    counts = [collections.defaultdict(collections.Counter) for _ in range(depth + 1)]
    for words, h in zip(docs, held):
        if not h:
            for level in range(depth + 1):
                for i in range(level, len(words)):
                    counts[level][tuple(words[i - level : i])][words[i]] += 1
    root = counts[0][()]
    n_all, distinct = sum(root.values()), len(root)
    states = {(): None}

    def p(context, word):
        while context not in states:
            context = context[1:]
        if not context:
            return (root[word] + added) / (n_all + added * (distinct + 1))
        c = counts[len(context)][context]
        total = sum(c.values())
        return (max(c[word] - discount, 0) + discount * len(c) * p(context[1:], word)) / total

    for level in range(1, depth + 1):
        for context, c in counts[level].items():
            total, own = sum(c.values()), 0.0
            if total < least:
                continue
            for word, n in c.items():
                own += n * (math.log(n - 1 - discount) + round(-math.log(p(context[1:], word)) * 2048) / 2048 - math.log(total - 1)) if n > 1 else math.log(discount * (len(c) - 1) / (total - 1))
            if own > gain:
                states[context] = True
    out = []
    for (i, *_), words, h in zip(rows, docs, held):
        scores = [math.log10(p(tuple(words[max(0, k - depth) : k]), w)) for k, w in enumerate(words)]
        base = [math.log10(p((), w)) for w in words]
        out.append((i, h, len(words), sum(root[w] > 0 for w in words), n_all, sum(base), sum(scores)))
    return out, len(states), p, root


def drawn_texts(seed, n):
    draw = random.Random(seed)
    stock = [f"w{k}" for k in range(30)]
    after = {w: draw.choices(stock, k=4) for w in stock}
    out = []
    for k in range(n):
        words = [draw.choice(stock)]
        for _ in range(draw.randint(0, 80)):
            words.append(draw.choice(after.get(words[-1], stock)) if draw.random() < 0.7 else draw.choice(["the", draw.choice(stock), f"rare{draw.randint(0, 400)}"]))
        out.append((k, draw.choice([" ", "\n", "\t "]).join(w.upper() if draw.random() < 0.1 else w for w in words), k % 10 == 0))
    return out


@pytest.mark.parametrize("options", [{}, {"block_tokens": 200, "group_pairs": 50}, {"block_tokens": 500, "group_pairs": 200, "hot_share": 8}, {"depth": 1, "least_count": 2, "least_gain": 0.0}, {"depth": 0}])
def test_suffix_model(spark, options):
    rows = [*drawn_texts(1, 250), (None, None, False), (None, "Ärger É <s> <s>", True), (500, "", True), (501, "w1 w2\x0bw3\x1cw4 w5", False), (501, "w1 w2", False), (502, "the " * 3000, False)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, held boolean").repartition(3)
    got = suffix_model.score_texts(frame, F.col("held"), **options).collect()
    want, n_states, *_ = tree_scores(rows, options.get("depth", 3), options.get("least_count", 4), options.get("least_gain", 2.0))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got, want = sorted((tuple(r)[:7] for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [x for r in got for x in r[5:]] == pytest.approx([x for r in want for x in r[5:]], rel=1e-9)
    assert options.get("depth") == 0 or n_states > 30


def test_states_sum_to_one():
    _, n_states, p, root = tree_scores(drawn_texts(2, 60), 3, 4, 2.0)
    draw = random.Random(4)
    contexts = [(), ("w1",), *[tuple(draw.choices([w for w in root if w], k=draw.randint(1, 3))) for _ in range(30)]]
    assert n_states > 10
    for c in contexts:
        assert sum(p(c, w) for w in root) + p(c, "never") == pytest.approx(1)


def test_suffix_model_of_odd_tables(spark):
    shape = "`d.id` bigint, text string, score string, HELD_OUT string, block int, level int, a string"
    rows = [(1, "a b a b a b a b a b", "", "", 1, 1, ""), (2, None, "", "", 1, 1, ""), (None, "a b", "", "", 1, 1, "")]
    frame = spark.createDataFrame(rows, shape)
    assert suffix_model.score_texts(frame.limit(0), F.lit(False), id_col="d.id").collect() == []
    none = suffix_model.score_texts(frame, F.lit(True), id_col="d.id").collect()
    assert len(none) == 3 and all(r.score == r.base_score == 0 and r.n_known == r.train_tokens == 0 for r in none)
    some = {r.doc_id: r for r in suffix_model.score_texts(frame, F.col("`d.id`") == 2, id_col="d.id").collect()}
    assert some[2].n_tokens == 1 and some[1].n_tokens == 11 and some[None].train_tokens == 14 and some[1].score > some[1].base_score


def test_suffix_model_beats_word_frequencies(spark, small):
    docs = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    r = suffix_model.score_texts(docs, held).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (r[0] - r[1]) / r[2] > 0.5  # half a digit a word better, on texts that it has not seen
