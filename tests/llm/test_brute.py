"""Operators against brute force, on the smallest tables and on drawn texts."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from reelspan.llm import bloom, bpe, components, fingerprints, language_id, near_dedup, queries, substring_dedup, toxicity

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(small):
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    found = queries.QUERIES[name](spark, small)
    columns = sorted(found.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, found.select(columns).collect()), key=key) == sorted(want, key=key)


def components_of(sets, percent=80):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


def shingled(text, size):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("size", [2, 5])
def test_near(spark, small, docs, size):
    sets = {i: shingled(t, size) for i, t, *_ in docs}
    want = components_of(sets)
    got = near_dedup.near_duplicates(spark.read.parquet(f"{small}/documents.parquet"), shingle_words=size).collect()
    assert sorted(map(tuple, got)) == [(i, len(sets[i]), want[i], want[i] == i) for i in sorted(sets)]


def test_near_copies_around_the_threshold(spark):
    draw = random.Random(2)
    texts = []
    for _ in range(12):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.choice([6, 60, 300]))]
        for _ in range(12):
            own = list(base)
            for _ in range(draw.randrange(0, max(2, len(base) // 10))):
                own[draw.randrange(len(own))] = f"x{draw.randrange(9)}"
            texts.append(" ".join(own))
    sets = {i: shingled(t, 2) for i, t in enumerate(texts)}
    want = components_of(sets)
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), shingle_words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ELEMENTS", 300)
    monkeypatch.setattr(near_dedup, "COMPARED", 3)  # so that keys go both ways
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join([*base[: 100 - k], *[f"y{k}-{j}" for j in range(k)]]) for k in range(0, 40)]
    sets = {i: shingled(t, 2) for i, t in enumerate(texts)}
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), shingle_words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == components_of(sets)


def cut(texts, span):
    first, words = {}, {}
    for i in sorted(texts):
        w = words[i] = re.findall(WORD, texts[i] or "")
        for s in range(len(w) - span + 1):
            first.setdefault(tuple(w[s : s + span]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - span + 1):
            if first[tuple(w[s : s + span])] < i:
                gone.update(range(s, s + span))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substrings(spark, small, docs):
    got = substring_dedup.remove_repeats(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == cut({i: t for i, t, *_ in docs}, 50)


def test_drawn_substrings(spark):
    draw = random.Random(4)
    pool = [[draw.choice("abcdefgh") for _ in range(draw.randint(5, 40))] for _ in range(12)] + [["z"] * 30]
    texts = {i: " ".join(w for _ in range(draw.randint(0, 6)) for w in draw.choice(pool)) for i in range(150)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = substring_dedup.remove_repeats(frame, span_words=8, edge_words=4).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == cut(texts, 8)


@pytest.mark.parametrize("seed", [4, 5])
def test_spans_and_their_sources(spark, seed):
    draw = random.Random(seed)
    pool = [[draw.choice("abcdefgh") for _ in range(draw.randint(5, 90))] for _ in range(12)]
    texts = {i: " ".join(w for _ in range(draw.randint(0, 6)) for w in draw.choice(pool)) for i in range(80)}
    words = {i: t.split() for i, t in texts.items()}
    found = substring_dedup.repeated_spans(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), span_words=8, edge_words=4).collect()
    covered = collections.defaultdict(set)
    for r in found:
        n = r.stop - r.place
        assert r.source_doc < r.doc_id and n >= 8 and words[r.doc_id][r.place : r.stop] == words[r.source_doc][r.source_place : r.source_place + n]
        covered[r.doc_id].update(range(r.place, r.stop))
    want = cut(texts, 8)
    assert all(len(covered[i]) == want[i][1] for i in texts)


def test_a_long_copy_is_one_span_after_few_rounds(spark, monkeypatch):
    rounds, keep = [], substring_dedup.stored
    monkeypatch.setattr(substring_dedup, "stored", lambda df, name: rounds.append(name) or keep(df, name))
    text = " ".join(f"w{k}" for k in range(30_000))
    docs = spark.createDataFrame([(1, "a b " + text), (2, text + " c"), (3, "nothing else")], "doc_id bigint, text string")
    assert [tuple(r) for r in substring_dedup.repeated_spans(docs).collect()] == [(2, 0, 30_000, 1, 2)]
    assert rounds.count("graph-done") <= 13


def reference_encoding():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, small, docs):
    _, want = reference_encoding()
    got = {r.doc_id: r for r in queries.QUERIES["op6_byte_bpe"](spark, small).collect()}
    for i, text, *_ in docs:
        ids = want.encode_ordinary(text)
        packed = np.array(ids, "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_of_odd_and_long_texts():
    ranks, want = reference_encoding()
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    draw = random.Random(3)
    signs = " \t\n\r\x0b\x1c\x1f\x85\xa0 　abcABC'sdé1²中文١😀́\x00!?-"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    texts += ["a" * 20_000, "ab" * 9_000, "".join(draw.choice("abcdef") for _ in range(30_000))]
    for text in texts:
        packed = encoder.encode(text)
        assert list(memoryview(packed).cast("I")) == want.encode_ordinary(text)
        assert encoder.decode(packed) == text.encode()


def test_fingerprints(spark, small, docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 30)
    got = {r.doc_id: r for r in queries.QUERIES["op2_fingerprints"](spark, small).collect()}
    down = sorted(docs, reverse=True)
    names = collections.defaultdict(set)
    for k, (i, text, *_) in enumerate(down):
        after = down[(k + 1) % len(down)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        common = next((n for n, (a, b) in enumerate(zip(text, edited, strict=False)) if a != b), min(len(text), len(edited)))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.common_prefix) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), common)
        assert fingerprints.pairs([edited, ""])["fingerprint"][0] == r.edited_fingerprint
        names[r.fingerprint].add(text)
        windows = [{t[j : j + 12] for j in range(max(1, len(t) - 11))} for t in (text, edited)]
        assert abs(r.near_edited - len(windows[0] & windows[1]) / len(windows[0] | windows[1])) < 0.35
    assert all(len(v) == 1 for v in names.values()) and len(names) == len({d[1] for d in docs})


def test_prefixes():
    draw = random.Random(9)
    text = "".join(draw.choice("abé😀") for _ in range(300)) * 2
    p = fingerprints.Prefixes(np.frombuffer(text.encode("utf-32-le"), "<u4"))
    a, b = np.array([0, 1, 5, 299]), np.array([300, 301, 306, 300])
    most = 600 - np.maximum(a, b)
    want = [next((k for k in range(m) if text[x + k] != text[y + k]), m) for x, y, m in zip(a, b, most, strict=True)]
    assert p.extension(a, b, most).tolist() == want


def test_language_held_out(spark, small, docs):
    lang = {i: x for i, _, x, _ in docs}
    got = queries.QUERIES["op7_language_id"](spark, small).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) >= 0.95


def gram_counts(text):
    """The n-gram buckets of a text, character by character."""
    own = re.sub(r"[\x00-\x60\x7b-\x7f]+", " ", (text or "").lower())
    out = collections.Counter()
    for i in range(len(own)):
        gram = 0
        for order, c in enumerate(own[i : i + 3]):
            gram = (gram * 0x100000001B3 + ord(c) + order) % (1 << 64)
            out[gram * 0x9E3779B97F4A7C15 % (1 << 64) >> 50] += 1
    return out


def follow_the_leader(rows, labels, n_labels, epochs=3, alpha=0.5, beta=1.0, l1=0.3, l2=1e-3):
    """FTRL-proximal, a coordinate at a time; rows are {bucket: weight} and None is the bias."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(j, c):
        own, (a, b) = z[j, c], ((0, 0) if j is None else (l1, l2))
        return 0.0 if abs(own) <= a else -(own - math.copysign(a, own)) / ((beta + math.sqrt(n[j, c])) / alpha + b)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            own = {**rows[i], None: 1.0}
            w = {(j, c): weight(j, c) for j in own for c in range(n_labels)}
            score = [sum(x * w[j, c] for j, x in own.items()) for c in range(n_labels)]
            e = [math.exp(s - max(score)) for s in score]
            for j, x in own.items():
                for c in range(n_labels):
                    g = x * (e[c] / sum(e) - (c == labels[i]))
                    z[j, c] += g - (math.sqrt(n[j, c] + g * g) - math.sqrt(n[j, c])) / alpha * w[j, c]
                    n[j, c] += g * g
    return {(j, c): weight(j, c) for j, c in list(z)}


def test_language_against_plain_loops(spark, small, docs):
    """The whole query again, from the definitions, without arrays."""
    learned = [(x, gram_counts(t)) for i, t, x, _ in docs if x is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    df = collections.Counter(b for _, bag in learned for b in bag)
    idf = lambda b: math.log((1 + len(learned)) / (1 + df[b])) + 1

    def unit(bag):
        x = {b: n * idf(b) for b, n in sorted(bag.items())}
        length = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / length for b, v in x.items()}

    rows = []
    for x, bag in learned:
        own = unit(bag)
        rows.append((x, np.array(list(own), "<u2").tobytes(), np.array(list(own.values()), "<f4").tobytes(), own))
    rows.sort(key=lambda r: r[:3])
    labels = sorted({r[0] for r in rows})
    y = [labels.index(r[0]) for r in rows]
    back = np.random.default_rng(11).permutation(len(y)) % 5 == 0
    fitted, rest = [i for i in range(len(y)) if not back[i]], [i for i in range(len(y)) if back[i]]
    w = follow_the_leader([rows[i][3] for i in fitted], [y[i] for i in fitted], len(labels))
    score = lambda own: np.array([w.get((None, c), 0) + sum(v * w.get((b, c), 0) for b, v in own.items()) for c in range(len(labels))])
    scores = [score(rows[i][3]) for i in rest]

    def loss(t):
        out = 0
        for z, i in zip(scores, rest, strict=True):
            logp = z / t - max(z / t) - math.log(sum(np.exp(z / t - max(z / t))))
            e = 1 / (len(rest) + 2)
            out -= sum(logp[c] * ((1 - e) if c == y[i] else e / (len(labels) - 1)) for c in range(len(labels)))
        return out

    t = min(np.exp(np.linspace(math.log(0.02), math.log(20), 1500)), key=loss)
    got = {r.doc_id: r for r in queries.QUERIES["op7_language_id"](spark, small).collect()}
    assert len(got) == len(docs)
    for i, text, *_ in docs:
        if not re.search(r"[^\W\d_]", text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        p = np.exp(score(unit(gram_counts(text))) / t)
        p /= p.sum()
        assert abs(got[i].score - p.max()) < 5e-3 and (p.max() - np.sort(p)[-2] < 1e-2 or got[i].lang_pred == labels[int(p.argmax())])


def test_most_language_weights_are_zero(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs.selectExpr("doc_id AS id", "text", "lang").where("crc32(cast(cast(id AS string) AS binary)) % 4 <> 2"))
    seen = (model.usual > model.usual.min(axis=0)).any(axis=1)
    assert (model.weights[seen] == 0).mean() > 0.8
    held = language_id.predict(docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2"), model).collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98


#: Languages that the tables do not have, some of them near to those that they have, and texts in none.
NEAR_MISSES = [
    "La città si sveglia presto e le strade si riempiono di persone che vanno al lavoro mentre il sole sorge dietro le colline e i negozi aprono le loro porte ai primi clienti della giornata.",
    "A cidade acorda cedo e as ruas enchem-se de pessoas que vão para o trabalho enquanto o sol nasce atrás das colinas e as lojas abrem as suas portas aos primeiros clientes do dia.",
    "De stad wordt vroeg wakker en de straten lopen vol met mensen die naar hun werk gaan terwijl de zon achter de heuvels opkomt en de winkels hun deuren openen voor de eerste klanten.",
    "Staden vaknar tidigt och gatorna fylls av människor som går till arbetet medan solen går upp bakom kullarna och butikerna öppnar sina dörrar för dagens första kunder.",
    "Orașul se trezește devreme și străzile se umplu de oameni care merg la muncă în timp ce soarele răsare în spatele dealurilor și magazinele își deschid ușile.",
    "Kota ini bangun pagi-pagi dan jalanan dipenuhi orang yang pergi bekerja sementara matahari terbit di balik bukit dan toko-toko membuka pintu mereka.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco.",
    "cheap-viagra-online.biz www.casino-bonus.xxx/buy?id=99 http://bit.ly/qwzx CLICK >>> best-loans.info/apply www.replica-watch.shop promo=XKCD77 http://pills4u.ru/order.php?ref=zz",
    "def main(argv):\n    for i in range(len(argv)):\n        if not argv[i].startswith('--'):\n            print(os.path.join(cwd, argv[i]))\n    return {k: v for k, v in sorted(cfg.items())}",
]


def test_language_stage(spark):
    """What is in no language that the table has goes; all that is, however short, mixed or loud, stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", "Все люди рождаются свободными и равными в своем достоинстве и правах",
        "人人生而自由,在尊严和权利上一律平等", "xqzvkj wrtplk bvnmcx qwrtzp lkjhgf dsmnbv xzcvbq wkrtpl mnvbcx zqwxrt", "1234 567 !!", "", None, "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar", *NEAR_MISSES,
    ]
    planted = spark.createDataFrame([(-1 - k, t, None, "s", 0) for k, t in enumerate(foreign)], docs.schema)
    kept = {r.doc_id for r in language_id.keep_known(docs.unionByName(planted)).select("doc_id").collect()}
    assert not [i for i in kept if i < 0]
    lettered = {r.doc_id for r in docs.where("text RLIKE '\\\\p{L}'").select("doc_id").collect()}
    assert len(lettered - kept) <= 2 and kept <= lettered  # 0.2 %


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    label = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{d}/labels.parquet'").fetchall())
    got = queries.QUERIES["op10_toxicity"](spark, d).collect()
    held = [r for r in got if r.held_out and r.doc_id in label]
    hits = sum(r.predicted and label[r.doc_id] for r in held)
    assert hits / sum(label[r.doc_id] for r in held) >= 0.6 and hits / sum(r.predicted for r in held) >= 0.9


def test_block_max_finds_what_a_full_scan_finds(monkeypatch):
    monkeypatch.setattr(toxicity, "DENSE_TERMS", 8)
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    draw = np.random.default_rng(1)
    x = draw.random((300, 20)) * (draw.random((300, 20)) < 0.2)
    x[17:30] = x[5]
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
    ids = draw.permutation(300)
    index = toxicity.Index(*np.nonzero(x), x[np.nonzero(x)], 20, np.ones(300, int), np.zeros(300, int), ids.tolist())
    queries = [(np.sort(draw.choice(20, k, replace=False)), draw.random(k)) for k in (4, 1, 0, 9, 20) * 10]
    cuts = np.cumsum([0] + [len(t) for t, _ in queries])
    found = index.nearest(cuts, np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries]))
    for (term, weight), (places, cosines) in zip(queries, found, strict=True):
        full = np.round(x[:, term] @ weight, 9)
        want = [k for k in np.lexsort((ids, -full)) if full[k] > 0][:16]
        assert [index.doc_ids[k] for k in places] == ids[want].tolist() and np.allclose(cosines, full[want])


def test_toxicity_against_every_pair(spark, small, docs):
    """The whole query again: terms, weights, all cosines, votes and the curve, from their definitions."""
    labels = duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{small}/labels.parquet' WHERE toxic IS NOT NULL GROUP BY doc_id").fetchall()
    learned = {i: y for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    bags = {i: collections.Counter(re.findall("[a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t, *_ in docs}
    examples = {}  # (text, label) once, by its smallest id
    for i, t, *_ in docs:
        if i in learned and (t, learned[i]) not in examples:
            examples[t, learned[i]] = i
    places = {}
    for (_, y), i in examples.items():
        if bags[i]:
            places.setdefault(tuple(sorted(bags[i].items())), []).append((i, y))
    terms = sorted({w for vector in places for w, _ in vector})
    df = collections.Counter(w for bag in bags.values() for w in bag)
    rows, positive = len(examples), sum(y for _, y in examples)

    def weight(w):
        out = np.log((1 + len(docs)) / (1 + df[w])) + 1
        own = [y for vector, group in places.items() if w in dict(vector) for _, y in group]
        n, bad, part = len(own), sum(own), positive / rows
        if bad <= n * part:
            return out
        cells = [(bad, n * part), (n - bad, n * (1 - part)), (positive - bad, (rows - n) * part), (rows - positive - n + bad, (rows - n) * (1 - part))]
        return out * (1 + max(2 * sum(k * np.log(k / m) for k, m in cells if k) - np.log(len(terms)), 0))

    of = {w: weight(w) for w in terms}
    rare = np.log((1 + len(docs)) / 2) + 1

    def unit(bag):
        x = {w: (1 + np.log(n)) * of.get(w, rare) for w, n in bag.items()}
        length = sum(v * v for v in x.values()) ** 0.5
        return {w: v / length for w, v in x.items()}

    vectors = [(unit(dict(vector)), group) for vector, group in places.items()]
    base = (positive + 0.5) / (rows + 5)

    def vote(bag, minus=None):
        x, own = unit(bag), []
        for y, group in vectors:
            rest = [g for g in group if g != minus]
            cosine = round(sum(v * y.get(w, 0) for w, v in x.items()), 9)
            if rest and cosine > 0:
                own.append((-cosine, min(group)[0], sum(g[1] for g in rest), len(rest)))
        own = sorted(own)[:16]
        w = [(-c / (1.05 + c)) ** 2 / n**0.5 for c, _, _, n in own]
        share = (sum(a * t for a, (_, _, t, _) in zip(w, own, strict=True)) + base) / (sum(a * n for a, (_, _, _, n) in zip(w, own, strict=True)) + 1)
        return np.log(share / (1 - share)), [i for _, i, _, _ in own]

    votes = [(vote(bags[i], (i, y))[0], y) for _, group in vectors for i, y in group]
    slope, shift = toxicity.fit_logistic(*map(np.array, zip(*votes, strict=True)))
    plain = [y for (_, y), i in examples.items() if not bags[i]]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")).collect()}
    assert len(got) == len(docs)
    for i, bag in bags.items():
        v, near = vote(bag) if bag else (0, [])
        want = 1 / (1 + np.exp(-(slope * v + shift))) if near else (sum(plain) + 0.5) / (len(plain) + 5)
        assert abs(got[i].score - want) < 1e-6 and got[i].evidence == near[:3] and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_logistic_curve_has_the_least_loss():
    draw = np.random.default_rng(3)
    x = draw.normal(size=400)
    y = (draw.random(400) < 1 / (1 + np.exp(-(1.7 * x - 0.4)))).astype(int)
    target = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / (400 - y.sum() + 2))
    loss = lambda a, b: (np.log1p(np.exp(a * x + b)) - target * (a * x + b)).sum() + 5e-4 * (a - 1) ** 2
    a, b = toxicity.fit_logistic(x, y)
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(2000).selectExpr("xxhash64(id % 1500) AS h")
    again = bloom.build(keys, 2000, repeated=True)
    hit = {r.h: r.m for r in keys.select("h", again.maybe("h").alias("m")).collect()}
    twice = [r.h for r in spark.range(500).selectExpr("xxhash64(id) AS h").collect()]
    assert all(hit[h] for h in twice) and sum(hit.values()) < 700
    full = bloom.build(keys, 2000, max_bits=1 << 16)
    assert keys.select(full.maybe("h").alias("m")).where("NOT m").count() == 0


def test_components(spark):
    draw = random.Random(6)
    links = [(draw.randrange(200), draw.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for a, b in links if a != b for x in (a, b)}


def mixed_up(sizes, weights=(3, 1, 2)):
    """Words taken by the mix of [(id, source, size)], and the time of each pass of a document."""
    total, out = sum(n for *_, n in sizes), {}
    names = sorted({s for _, s, _ in sizes}, key=lambda s: (s is None, s))
    size = {s: sum(n for _, x, n in sizes if x == s) for s in names}
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        left = 1.5 * total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * size[s]]
        target.update({s: 2.0 * size[s] for s in full} if full else share)
        open_ -= set(full or open_)
    for k, s in enumerate(names):
        a = (0.5, 1.0, 1.5)[k % 3]
        wanted, before = math.floor(target[s] + 0.5), 0
        for i, _, n in sorted((r for r in sizes if r[1] == s), key=lambda r: (hashlib.md5(str(r[0]).encode()).hexdigest(), r[0], r[2])):
            passes = wanted // size[s] if size[s] else 0
            taken = passes * n + min(max(wanted - passes * size[s] - before, 0), n)
            times = []
            for c in range(math.ceil(taken / n) if n else 0):
                q = (c * size[s] + before + min(n, taken - c * n) / 2) / wanted
                times.append(q * 2 / (a + math.sqrt(max(a * a + 4 * (1 - a) * q, 0))))
            out[i] = taken, times
            before += n
    return out


def test_pipeline_stages_against_brute_force(spark, small, docs):
    frame = spark.read.parquet(f"{small}/documents.parquet")
    lines = [(i, x, k, line.strip(" \t\r")) for i, t, _, x in docs for k, line in enumerate((t or "").split("\n"))]
    sites, first = collections.defaultdict(set), {}
    for i, x, k, line in lines:
        sites[line].add(x)
        first[line] = min(first.get(line, (i, k)), (i, k))
    gone = {(i, k) for i, x, k, line in lines if line and len(sites[line] - {None}) >= 5 and first[line] != (i, k)}
    want = {i: "\n".join(line for k, line in enumerate(t.split("\n")) if (i, k) not in gone) for i, t, *_ in docs if t is not None}
    got = {r.doc_id: r.text for r in corpus_pipeline.clean_lines(spark, frame, small).collect()}
    assert gone and {i: t for i, t in got.items() if t is not None} == want

    plan = mixed_up([(i, x, len(re.findall(WORD, t or ""))) for i, t, _, x in docs])
    size = {i: len(re.findall(WORD, t or "")) for i, t, *_ in docs}
    want = sorted((time, i) for i, (taken, times) in plan.items() for time in times[: math.floor(taken / size[i] + 0.5) if size[i] else 0])
    order = corpus_pipeline.in_training_order(spark, frame, small)
    got = [r.doc_id for r in order.collect()]
    assert order.columns == frame.columns and collections.Counter(got) == collections.Counter(i for _, i in want)
    time_of = {}
    for time, i in want:
        time_of.setdefault(i, []).append(time)
    seen = collections.Counter()
    times = []
    for i in got:
        times.append(time_of[i][seen[i]])
        seen[i] += 1
    assert all(a <= b + 1e-9 for a, b in zip(times, times[1:], strict=False))

    _, encoding = reference_encoding()
    text = {i: t or "" for i, t, *_ in docs}
    for r in corpus_pipeline.tokens(spark, frame, small).collect():
        ids = encoding.encode_ordinary(text[r.doc_id])
        assert bytes(r.ids) == np.array(ids, "<u4").tobytes() and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_pipeline(spark, small, docs):
    rows = corpus_pipeline.run(spark, small).collect()
    ids = collections.Counter(r.doc_id for r in rows)
    assert set(ids) <= {d[0] for d in docs} and max(ids.values()) <= 2
    frame = spark.read.parquet(f"{small}/documents.parquet")
    known = {r.doc_id for r in corpus_pipeline.known_language(spark, frame, small).collect()}
    assert len(known) >= 0.98 * len(docs)
    near = {r.doc_id for r in corpus_pipeline.one_of_each(spark, frame, small).collect()}
    want = components_of({i: shingled(t, 5) for i, t, *_ in docs})
    assert near == {i for i in want if want[i] == i}
    order = corpus_pipeline.in_training_order(spark, frame, small)
    assert order.columns == frame.columns and language_id.UNKNOWN == "und"
