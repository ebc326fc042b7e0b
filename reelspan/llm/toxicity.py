"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

A text's terms are its words in lower case (split at every ASCII character but
letters), and all of them count.  The index holds every term of the examples;
document frequencies are counted over all documents.  A term that stands in toxic
examples more often than chance weighs more, by its log-likelihood ratio; none is left
out.  A term of a text that no example has cannot add to a cosine but to the text's
length: there it counts as one that a single document has.

Examples with the same vector are one place with its counts of either label.
Places are sorted so that alike ones share a block, and a common term's postings lie
block by block, each with its largest weight.  A query reads the short lists of its
rarer terms whole, then the blocks of the highest bounds, then every other block whose
bound reaches its k-th neighbour: the neighbours are those of a full scan, ties by the
smaller id.  Votes are weighted by distance; a logistic curve fitted on the examples,
each scored without itself in a Spark task, turns them into probabilities.

Learning reads at most ``FIT_ROWS`` labelled rows (a documented bound; those with
the smallest hash of the id); the index is therefore of bounded size and is
broadcast.  Counting and scoring run over all documents and shuffle no text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.language_id import held_out
from reelspan.llm.names import quoted
from reelspan.llm.scratch import bounded_batches, written
from reelspan.llm.spans import LOWER, Words, text_chunks

FIT_ROWS = 8000
NEIGHBOURS = 16
#: Votes fall with this power of the distance; of examples with one vector each counts less, by this power of their number.
POWER, SPREAD = 2.0, 0.5
BLOCK = 64
#: Of so many of the commonest terms a block's postings lie as a matrix.
DENSE_TERMS = 512
#: Texts that are searched at once (8 MB of cosines), and scores that a task remembers for texts of the same terms.
TEXTS_AT_ONCE, REMEMBERED = 128, 20_000
#: Blocks that a query reads before it leaves any out.
FIRST_BLOCKS = 8
#: Terms whose counts travel in one row.
SLICE = 1 << 14
THRESHOLD = 0.7

#: Bytes that are no part of a word here: ASCII but for letters.
OTHER = np.zeros(256, bool)
OTHER[:128] = True
OTHER[65:91] = OTHER[97:123] = False


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term hash) of each word."""
    words = Words(data, offsets, LOWER, OTHER)
    return np.repeat(np.arange(len(offsets) - 1), np.diff(words.first)), words.hash


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, count) of each term of each text, in order."""
    text, term = terms(data, offsets)
    found, of = np.unique(term, return_inverse=True)
    size = max(len(found), 1)
    pair, n = np.unique(text * size + of, return_counts=True)
    return pair // size, found[pair % size], n


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each example all term hashes, in order, and then their counts."""
    for batch in batches:
        for at, data, offsets in text_chunks(batch.column(2)):
            text, term, n = term_counts(data, offsets)
            cuts = np.searchsorted(text, np.arange(len(offsets)))
            own = [batch.column(k).slice(at.start, at.stop - at.start) for k in (0, 1)]
            vectors = [term[i:j].astype("<u8").tobytes() + n[i:j].astype("<u4").tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(vectors, pa.binary())], names=["doc_id", "toxic", "vector"])


class Vocabulary:
    """Sorted term hashes with a small table that turns most others away."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes}

    @functools.cached_property
    def door(self) -> np.ndarray:
        out = np.zeros(1 << 22, bool)
        out[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        return out

    def numbers(self, term: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for one that is not known."""
        out = np.full(len(term), -1)
        maybe = np.flatnonzero(self.door[(term >> np.uint64(42)).astype(np.int64)])
        at = np.searchsorted(self.hashes, term[maybe])
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == term[maybe[known]]
        out[maybe[known]] = at[known]
        return out

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term number, count) of each term of each text; those that are not known are -1."""
        text, term, n = term_counts(data, offsets)
        return text, self.numbers(term), n


def _document_counts(vocabulary: Vocabulary):
    """In how many texts of this task each known term stands, in slices; slice -1 has the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(len(vocabulary.hashes), np.int64), 0
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column(0)):
                number = vocabulary.vectors(data, offsets)[1]
                found += np.bincount(number[number >= 0], minlength=len(found))
            rows += len(batch)
        if not rows:
            return
        parts = [np.array([rows], "<i8"), *(found[k : k + SLICE].astype("<i8") for k in range(0, len(found), SLICE))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(parts) - 1), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["slice", "n"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of the rows of each slice."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[k] = np.frombuffer(n, "<i8") + found.get(k, 0)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["slice", "n"])


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def bisected(x: np.ndarray) -> np.ndarray:
    """An order of rows in which alike ones share a block: cut in halves along the main direction, again and again."""

    def halves(at: np.ndarray) -> list[np.ndarray]:
        if len(at) <= BLOCK:
            return [at]
        y = x[at] - x[at].mean(axis=0)
        along = y[np.argmax((y * y).sum(axis=1))]
        for _ in range(8):
            along = y.T @ (y @ along)
            along /= np.linalg.norm(along) or 1
        at = at[np.argsort(y @ along, kind="stable")]
        cut = max(len(at) // 2 // BLOCK, 1) * BLOCK
        return halves(at[:cut]) + halves(at[cut:])

    return np.concatenate(halves(np.arange(len(x))))


class Index:
    """Labelled example vectors as postings of every term, in blocks with the largest weight of each term in each block.

    Of the ``DENSE_TERMS`` commonest terms a block's postings lie as a matrix, since most examples
    have them; the others have a short list each.  Texts are searched some at a time, so that a block is read once for them.
    """

    def __init__(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, n: np.ndarray, toxic: np.ndarray, doc_ids: list):
        """From (example, term, weight) triples of ``size`` terms, and each example's count, toxic ones among them, and an id."""
        common = np.argsort(-np.bincount(term, minlength=size), kind="stable")[:DENSE_TERMS]
        self.dense = np.full(size, -1, np.int32)  # a term's row in the blocks' matrices
        self.dense[common] = np.arange(len(common))
        inside = self.dense[term] >= 0
        rows = np.zeros((len(n), len(common)), np.float32)
        rows[row[inside], self.dense[term[inside]]] = weight[inside]
        order = bisected(rows)
        del rows
        self.n, self.toxic, self.doc_ids, self.size = n[order], toxic[order], [doc_ids[k] for k in order], size
        self.rank = np.argsort(np.argsort(np.array(self.doc_ids, np.int64), kind="stable"), kind="stable")  # decides ties
        self.blocks = -(-len(n) // BLOCK)
        of = np.empty(len(n), np.int64)
        of[order] = np.arange(len(n))
        place = of[row].astype(np.int32)
        # Cells of the matrices; the matrices themselves are made from them wherever the index arrives.
        self.shape = self.blocks, len(common), BLOCK
        self.cell = np.ravel_multi_index((place[inside] // BLOCK, self.dense[term[inside]], place[inside] % BLOCK), self.shape).astype(np.int32)
        self.cell_weight = weight[inside]
        own, place, weight = term[~inside], place[~inside], weight[~inside]
        by_term = np.lexsort((place, own))
        self.place, self.weight = place[by_term].astype(np.int32), weight[by_term]
        self.first = np.searchsorted(own[by_term], np.arange(size + 1))  # of each term's list

    @functools.cached_property
    def matrix(self) -> np.ndarray:
        out = np.zeros(self.shape)
        out.ravel()[self.cell] = self.cell_weight
        return out

    @functools.cached_property
    def bounds(self) -> np.ndarray:
        return np.ascontiguousarray(self.matrix.max(axis=2, initial=0.0).T)

    def nearest(self, cuts: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text (its terms and weights are those from cuts[i] to cuts[i + 1]) places and cosines of the
        k nearest examples with a cosine above zero, the best first, ties by the smaller id.  ``without``: a place that each text leaves out, or -1."""
        texts = len(cuts) - 1
        if not self.blocks:
            return [(np.empty(0, np.int64), np.empty(0))] * texts
        text = np.repeat(np.arange(texts), np.diff(cuts))
        inside = self.dense[term] >= 0
        common = np.zeros((texts, self.shape[1]))
        common[text[inside], self.dense[term[inside]]] = weight[inside]
        text, term, weight = text[~inside], term[~inside], weight[~inside]
        # The lists of the rarer terms, whole; then a block can reach its best such sum and what its common terms' maxima allow.
        width = self.first[term + 1] - self.first[term]
        posting = runs(self.first[term], width)
        into = np.repeat(text * (self.blocks * BLOCK), width) + self.place[posting]
        cosine = np.bincount(into, weights=self.weight[posting] * np.repeat(weight, width), minlength=texts * self.blocks * BLOCK)
        cosine = cosine.astype(np.float64, copy=False).reshape(texts, self.blocks, BLOCK)
        bound = common @ self.bounds + cosine.max(axis=2)

        def read(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                own = np.flatnonzero(wanted[:, b])
                cosine[own, b] += common[own] @ self.matrix[b]
            if without is not None:
                left_out = np.flatnonzero(without >= 0)
                cosine[left_out, without[left_out] // BLOCK, without[left_out] % BLOCK] = 0

        # First the blocks of the highest bounds, then every other one whose bound reaches the k-th neighbour so far.
        first = np.zeros(bound.shape, bool)
        few = min(FIRST_BLOCKS, self.blocks)
        top = np.argpartition(-bound, few - 1, axis=1)[:, :few]
        np.put_along_axis(first, top, True, axis=1)
        read(first & (bound > 0))
        seen = np.take_along_axis(cosine, top[:, :, None], axis=1).reshape(texts, -1)
        worst = np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] >= k else np.zeros(texts)
        rest = ~first & (bound > 0) & (bound >= worst[:, None] - 1e-9)
        read(rest)
        cosine[~first & ~rest] = 0  # only in part, and too little
        cosine = cosine.reshape(texts, -1)
        out = []
        for own, least in zip(cosine, np.maximum(worst - 1e-9, 0), strict=True):
            places = np.flatnonzero(own > least)
            found = own[places]
            if len(places) > k:
                keep = found > np.partition(found, -k)[-k] - 1e-9
                places, found = places[keep], found[keep]
            cosines = np.round(found, 9)
            best = np.lexsort((self.rank[places], -cosines))[:k]
            best = best[cosines[best] > 0]
            out.append((places[best], cosines[best]))
        return out


class Model:
    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, index: Index, rare: float, base: float, none: float):
        self.vocabulary, self.idf, self.index, self.rare = vocabulary, idf, index, rare  # rare: for terms that are not known
        self.base, self.none = base, none  # shares of toxic examples: all, and those without a term

    def units(self, cuts: np.ndarray, term: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Weights of whole texts' terms (-1 for one that is not known), each text's of length one."""
        weight = (1 + np.log(n)) * np.where(term >= 0, self.idf[term] if len(self.idf) else self.rare, self.rare)
        squares = np.concatenate(([0.0], np.cumsum(weight * weight)))
        length = np.sqrt(squares[cuts[1:]] - squares[cuts[:-1]])
        return weight / np.repeat(np.maximum(length, 1e-12), np.diff(cuts))

    def nearest(self, cuts: np.ndarray, term: np.ndarray, n: np.ndarray, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Neighbours of each text; terms that are not known count in its length alone."""
        weight, known = self.units(cuts, term, n), term >= 0
        own = np.concatenate(([0], np.cumsum(known)))[cuts]
        return self.index.nearest(own, term[known], weight[known], without=without)

    def vote(self, places: np.ndarray, cosines: np.ndarray, minus: int = -1, label: int = 0) -> float:
        """Log odds of the neighbours' weighted votes; ``minus``: one example at this place less."""
        n, toxic = self.index.n[places].astype(float), self.index.toxic[places].astype(float)
        n[places == minus] -= 1
        toxic[places == minus] -= label
        w = (cosines / (1.05 - cosines)) ** POWER / np.maximum(n, 1) ** SPREAD
        share = ((w * toxic).sum() + self.base) / ((w * n).sum() + 1)
        share = min(max(share, 1e-6), 1 - 1e-6)
        return float(np.log(share / (1 - share)))

    def score(self, places: np.ndarray, cosines: np.ndarray, curve: tuple[float, float]) -> tuple[float, list]:
        """Calibrated probability (by the curve's slope and shift) and the ids of the nearest examples."""
        if not len(places):
            return self.none, []
        z = curve[0] * self.vote(places, cosines) + curve[1]
        return float(1 / (1 + np.exp(-z))), [self.index.doc_ids[k] for k in places[:3]]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps, with targets drawn in a little."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - target) * x).sum() + 1e-3 * (a - 1), (p - target).sum()])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return max(float(a), 0.05), float(b)


def ratios(n: np.ndarray, toxic: np.ndarray, rows: int, positive: int) -> np.ndarray:
    """Log-likelihood ratio of a term's share in toxic against other examples; 0 where it is rarer in toxic ones."""

    def x_log(k: np.ndarray, m: np.ndarray) -> np.ndarray:
        return np.where(k > 0, k * np.log(np.maximum(k, 1e-12) / np.maximum(m, 1e-12)), 0.0)

    negative, other = rows - positive, n - toxic
    part = positive / max(rows, 1)
    seen = x_log(toxic, n * part) + x_log(other, n * (1 - part))
    rest = x_log(positive - toxic, (rows - n) * part) + x_log(negative - other, (rows - n) * (1 - part))
    return np.where(toxic > n * part, 2 * (seen + rest), 0.0)


def train(docs: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Broadcast, tuple[float, float]]:
    """A model, broadcast, from ``doc_id, text`` of all documents and ``doc_id, toxic`` of those to learn from; and its curve.

    Repeated labels of an id count once (the largest); examples with equal text count
    once for each label.
    """
    own = labelled.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = own.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(fit_rows).drop("_h")  # a bounded sample, so it may be broadcast
    rows = docs.join(F.broadcast(drawn), "doc_id").groupBy(F.xxhash64("text").alias("_t"), "toxic").agg(F.min_by(F.struct("doc_id", "text"), "doc_id").alias("r"))
    sample = written(rows.select("r.doc_id", "toxic", F.col("r.text").alias("text")).repartition(16, "doc_id"), "toxic-sample")

    got = sample.select("doc_id", "toxic", "text").mapInArrow(_example_terms, "doc_id bigint, toxic int, vector binary").orderBy("doc_id", "toxic").collect()
    vectors: dict[bytes, bytes] = {}
    groups: dict[bytes, list] = {}
    n_rows, positive = len(got), 0
    got.reverse()
    while got:
        r = got.pop()
        key = hashlib.blake2b(r["vector"], digest_size=16).digest()
        vectors.setdefault(key, r["vector"])
        groups.setdefault(key, []).append((r["doc_id"], min(max(r["toxic"], 0), 1)))
        positive += groups[key][-1][1]
    nothing = next((key for key, vector in vectors.items() if not vector), b"")
    plain = groups.pop(nothing, [])
    vectors.pop(nothing, None)
    members = list(groups.values())
    width = np.array([len(vector) // 12 for vector in vectors.values()], np.int64)
    cuts = np.concatenate(([0], np.cumsum(width)))
    hashes, times = np.empty(cuts[-1], np.uint64), np.empty(cuts[-1], np.int32)
    for i, j, vector in zip(cuts[:-1], cuts[1:], vectors.values(), strict=True):
        hashes[i:j], times[i:j] = np.frombuffer(vector, "<u8", j - i), np.frombuffer(vector, "<u4", j - i, 8 * (j - i))
    del groups, vectors
    vocabulary = Vocabulary(np.unique(hashes))
    term = vocabulary.numbers(hashes).astype(np.int32)
    del hashes

    size = len(vocabulary.hashes)
    parts = docs.select("text").mapInArrow(_document_counts(vocabulary), "slice int, n binary").repartition("slice").mapInArrow(_added, "slice int, n binary").collect()
    counted = {r["slice"]: np.frombuffer(r["n"], "<i8") for r in parts}
    total = int(counted.pop(-1, np.zeros(1))[0])
    df = np.concatenate([counted[k] for k in sorted(counted)]) if counted else np.zeros(size)
    idf = np.log((1 + total) / (1 + df)) + 1

    own_n, own_toxic = np.array([len(g) for g in members], np.int64), np.array([sum(y for _, y in g) for g in members], np.int64)
    seen, bad = (np.bincount(term, weights=np.repeat(x, width), minlength=size) for x in (own_n, own_toxic))
    idf = idf * (1 + np.maximum(ratios(seen, bad, n_rows, positive) - np.log(max(size, 1)), 0))  # 1 + what no chance among so many terms explains

    model = Model(vocabulary, idf, None, float(np.log((1 + total) / 2) + 1), (positive + 0.5) / (n_rows + 5), (sum(y for _, y in plain) + 0.5) / (len(plain) + 5))
    weight = model.units(cuts, term, times)
    model.index = Index(np.repeat(np.arange(len(members)), width), term, weight, size, own_n, own_toxic, [g[0][0] for g in members])
    place = {doc: k for k, doc in enumerate(model.index.doc_ids)}
    own = {(doc, y): (place[g[0][0]], len(g) == 1) for g in members for doc, y in g}
    del term, times, weight
    shared = docs.sparkSession.sparkContext.broadcast(model)
    del model
    # Every example is scored without itself, in tasks.
    votes = sample.mapInArrow(_votes(shared, own), "doc_id bigint, toxic int, vote double").orderBy("doc_id", "toxic").select("toxic", "vote").collect()
    toxic = np.array([r["toxic"] for r in votes])
    curve = fit_logistic(np.array([r["vote"] for r in votes]), toxic) if len(set(toxic.tolist())) > 1 else (1.0, 0.0)
    return shared, curve


def _votes(shared, own: dict):
    """The vote on each example by the others, for the examples that have a term; ``own``: each one's place, and whether it is alone there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, data, offsets in text_chunks(batch.column(2)):
                text, term, n = model.vocabulary.vectors(data, offsets)
                cuts = np.searchsorted(text, np.arange(len(offsets)))
                rows = list(zip(*(batch.column(k).slice(at.start, at.stop - at.start).to_pylist() for k in (0, 1)), strict=True))
                rows = [(doc, min(max(y, 0), 1)) for doc, y in rows]
                at_place = np.array([own.get(r, (-1, False)) for r in rows], np.int64)
                found = model.nearest(cuts, term, n, np.where(at_place[:, 1] > 0, at_place[:, 0], -1))
                out = [(doc, y, model.vote(*near, place, y)) for (doc, y), (place, _), near in zip(rows, at_place.tolist(), found, strict=True) if place >= 0]
                doc, y, vote = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(y, pa.int32()), pa.array(vote, pa.float64())], names=["doc_id", "toxic", "vote"])

    return run


def score(docs: DataFrame, shared: Broadcast, curve: tuple[float, float]) -> DataFrame:
    """``doc_id, score, evidence`` (ids of the nearest examples) from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            for at, data, offsets in text_chunks(batch.column(1)):
                text, term, n = model.vocabulary.vectors(data, offsets)
                cuts = np.searchsorted(text, np.arange(len(offsets)))
                keys = [hashlib.blake2b(term[i:j].tobytes() + n[i:j].tobytes(), digest_size=16).digest() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                if len(known) >= REMEMBERED:
                    known.clear()
                new = {key: k for k, key in enumerate(keys) if key not in known}
                for low in range(0, len(new), TEXTS_AT_ONCE):
                    some = np.array(list(new.values())[low : low + TEXTS_AT_ONCE])
                    width = np.diff(cuts)[some]
                    own = runs(cuts[some], width)
                    found = model.nearest(np.concatenate(([0], np.cumsum(width))), term[own], n[own])
                    known.update((keys[k], model.score(*near, curve)) for k, near in zip(some.tolist(), found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at.start, at.stop - at.start), pa.array([known[k][0] for k in keys], pa.float64()), pa.array([known[k][1] for k in keys], pa.list_(pa.int64()))],
                    names=["doc_id", "score", "evidence"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, evidence array<bigint>")


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted, evidence``.

    Learns from labels whose crc32 of the id (as text) modulo 3 is not 1.  A text
    without a term, or with none that an example has, gets the share of toxic examples
    among those without a term; without such an example that is 0.1.  Null counts as
    empty, equal texts get equal scores, and a very long text is one vector like any
    other (memory: about 60 bytes for each byte of the longest text).  A null id is
    scored and never learned from.  Other columns are not read; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    learnable = labels.where(~held_out("doc_id", 3, 1)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic")
    scored = score(rows, *train(rows, learnable, fit_rows))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
