"""Document fingerprints from prefix polynomial hashes.

For a batch of texts laid end to end the code points' polynomial prefix sums
modulo the prime 2**31 - 1 are kept for two bases.  Any span's hash is then one
difference and one product with a power of the inverse base, so span equality
costs O(1) and a longest common extension a binary search; all texts of a batch
are searched at once.

A fingerprint is the length and the two whole-text hashes (equal texts have equal
fingerprints), and a sketch: the smallest hash of the ``WINDOW``-character spans in
each of ``BINS`` classes.  Two fingerprints' likeness, the share of classes that
agree, estimates the share of spans in common.  Sketches of pieces of a text
combine, so an edited text is never hashed again where it was left unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.names import quoted
from reelspan.llm.scratch import bounded_batches

P = np.uint64((1 << 31) - 1)
BASES = (np.uint64(1_000_003_999 % int(P)), np.uint64(1_234_567_891 % int(P)))
INVERSES = tuple(np.uint64(pow(int(b), -1, int(P))) for b in BASES)
WINDOW = 12
BINS = 64
EMPTY = np.uint32(0xFFFFFFFF)
#: Characters handled at once, unless one text is longer.
CHUNK_CHARS = 1 << 19
#: Documents in a bucket of neighbouring ids, and buckets at most.
BUCKET_ROWS, MAX_BUCKETS = 1024, 20_000


def modulo(x: np.ndarray) -> np.ndarray:
    """x mod 2**31 - 1 for x < 2**63."""
    x = (x & P) + (x >> np.uint64(31))
    x = (x & P) + (x >> np.uint64(31))
    return np.where(x >= P, x - P, x)


_tables: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo P, kept between calls; each doubling is one product."""
    have = _tables.get(int(base))
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        step = np.uint64(pow(int(base), len(have), int(P)))
        have = np.concatenate((have, modulo(have * step)))
    _tables[int(base)] = have
    return have[:n]


class Prefixes:
    """Prefix polynomial hashes of one sequence of code points."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        values = points.astype(np.uint64) + np.uint64(1)
        self.length = n
        self.sums = []
        for base in BASES:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(modulo(values * powers(base, n)), out=sums[1:])  # below 2**63 up to 2**32 code points
            self.sums.append(modulo(sums))

    def span(self, start: np.ndarray, stop: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of the spans [start, stop): sum of (code point + 1) * base**offset."""
        sums = self.sums[which]
        return modulo((sums[stop] + P - sums[start]) * powers(INVERSES[which], self.length + 1)[start])

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Are the spans of n code points at a and at b equal?"""
        return (self.span(a, a + n) == self.span(b, b + n)) & (self.span(a, a + n, 1) == self.span(b, b + n, 1))

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extension of the suffixes at a and b, up to ``most``, by binary search."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a, b, middle)
            low, high = np.where(open_ & same, middle, low), np.where(open_ & ~same, middle - 1, high)
        return low


def joined(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    """Hash of a span of n_a code points with hash a followed by one with hash b."""
    shift = np.array([pow(int(BASES[which]), int(n), int(P)) for n in n_a], np.uint64)
    return modulo(a + modulo(b * shift))


def _scatter(sketch: np.ndarray, owner: np.ndarray, hashes: np.ndarray) -> None:
    """Lower each owner's bins to these span hashes."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    place = owner * BINS + (x >> np.uint64(58)).astype(np.int64)
    np.minimum.at(sketch.reshape(-1), place, ((x >> np.uint64(24)) & np.uint64(0xFFFFFFFE)).astype(np.uint32))


def _ranges(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of n[i] places from start[i] on."""
    n = np.maximum(n, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[owner]


def sketches(prefixes: Prefixes, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sketch of each span; one shorter than WINDOW is its own only window."""
    out = np.full((len(n), BINS), EMPTY, np.uint32)
    owner, place = _ranges(start, n - WINDOW + 1)
    _scatter(out, owner, prefixes.span(place, place + WINDOW))
    few = np.flatnonzero((n > 0) & (n < WINDOW))
    _scatter(out, few, prefixes.span(start[few], start[few] + n[few]))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bins that either sketch fills in which they agree; 1 for two empty ones."""
    filled = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & filled).sum(axis=-1)
    total = filled.sum(axis=-1)
    return np.where(total > 0, same / np.maximum(total, 1), 1.0)


def _named(n: np.ndarray, whole: list[np.ndarray], sketch: np.ndarray) -> list[str]:
    raw = sketch.astype(">u4").tobytes()
    return [f"{a:x}-{b:08x}{c:08x}-{raw[4 * BINS * k : 4 * BINS * (k + 1)].hex()}" for k, (a, b, c) in enumerate(zip(n.tolist(), whole[0].tolist(), whole[1].tolist(), strict=True))]


def read_fingerprint(text: str) -> tuple[int, str, np.ndarray]:
    """Length, whole-text hash and sketch of a fingerprint."""
    n, whole, raw = text.split("-")
    return int(n, 16), whole, np.frombuffer(bytes.fromhex(raw), ">u4").astype(np.uint32)


def pairs(texts: list[str]) -> dict[str, list]:
    """For each text but the last: its fingerprint and that of its edit with the next text."""
    m = len(texts) - 1
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    prefixes = Prefixes(points)
    full = sketches(prefixes, start, size)
    whole = [prefixes.span(start, start + size, k) for k in (0, 1)]

    n, s, t = size[:-1], start[:-1], start[1:]
    half = n // 2
    kept, given = n - half, np.minimum(half, size[1:])
    edited = kept + given
    # The kept head and the given head keep their windows; only those across the seam are new.
    sketch = np.full((m, BINS), EMPTY, np.uint32)
    for at, count in ((s, kept), (t, given)):
        owner, place = _ranges(at, count - WINDOW + 1)
        _scatter(sketch, owner, prefixes.span(place, place + WINDOW))
    for k in range(1, WINDOW):  # k code points of the head, the others of what follows
        own = np.flatnonzero((kept >= k) & (given >= WINDOW - k))
        a, b = s[own] + kept[own], t[own]
        left, right = prefixes.span(a - k, a), prefixes.span(b, b + WINDOW - k)
        _scatter(sketch, own, modulo(left + modulo(right * np.uint64(pow(int(BASES[0]), k, int(P))))))
    few = np.flatnonzero((edited > 0) & (edited < WINDOW))
    _scatter(sketch, few, joined(prefixes.span(s[few], s[few] + kept[few]), kept[few], prefixes.span(t[few], t[few] + given[few]), 0))
    both = [joined(prefixes.span(s, s + kept, k), kept, prefixes.span(t, t + given, k), k) for k in (0, 1)]
    shared = prefixes.extension(s + kept, t, given)  # the edit's tail against the text's own
    return {
        "n_chars": n.tolist(),
        "edited": [texts[i][: kept[i]] + texts[i + 1][: given[i]] for i in range(m)],
        "fingerprint": _named(n, [w[:-1] for w in whole], full[:-1]),
        "edited_fingerprint": _named(edited, both, sketch),
        "near_edited": likeness(full[:-1], sketch).tolist(),
        "near_next": likeness(full[:-1], full[1:]).tolist(),
        "common_prefix": (kept + shared).tolist(),
    }


FOUND = (("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64()))
SHAPE = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix bigint"


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, own, doc_id, text) in order: each own row of a bucket with the row after it."""
    waiting: list[tuple] = []
    size = 0

    def answered() -> pa.RecordBatch:
        found = pairs([w[3] for w in waiting])
        found["edited_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in found["edited"]]
        keep = [i for i in range(len(waiting) - 1) if waiting[i][1] and waiting[i][0] == waiting[i + 1][0]]
        return pa.RecordBatch.from_arrays(
            [pa.array([waiting[i][2] for i in keep], pa.int64()), *(pa.array([found[name][i] for i in keep], kind) for name, kind in FOUND)], names=["doc_id", *(name for name, _ in FOUND)]
        )

    for batch in batches:
        columns = batch.columns
        for i in range(len(batch)):
            waiting.append(tuple(c[i].as_py() for c in columns))
            size += len(waiting[-1][3])
            if (size > CHUNK_CHARS or len(waiting) > 2048) and len(waiting) > 1:
                yield answered()
                waiting = waiting[-1:]
                size = len(waiting[0][3])
    if len(waiting) > 1:
        yield answered()


def in_pairs(rows: DataFrame) -> DataFrame:
    """``bucket, own, doc_id, _text`` from ``doc_id, _text``, partitioned and sorted so that each document's next one follows it.

    Buckets are ranges of ids of about BUCKET_ROWS rows (more above MAX_BUCKETS of
    them).  The first row of every bucket is sent to the bucket before it as well,
    with ``own`` false, so each text moves once and no bucket needs another.
    """
    spark = rows.sparkSession
    ids = rows.select("doc_id")
    counted = ids.agg(F.count("doc_id").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    buckets = max(1, min(MAX_BUCKETS, counted["n"] // BUCKET_ROWS))
    cuts = ids.stat.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    cuts, times = np.unique(np.array(cuts, np.float64), return_counts=True)
    # An id that is several cuts at once has as many buckets' rows: these, and those without an id, are cut by hash as well.
    shares = np.where((times > 1) & (np.abs(cuts) < 1 << 53), times, 0)
    none = max(1, min(MAX_BUCKETS, counted["none"] // BUCKET_ROWS))
    starts = np.concatenate(([0], np.cumsum(1 + shares[::-1]), [1 + len(cuts) + shares.sum()])).astype(np.int64)

    @F.pandas_udf("int")
    def bucket_of(id_: pd.Series, h: pd.Series) -> pd.Series:
        x, unit = id_.fillna(0).to_numpy(np.float64), h.to_numpy(np.int64) / 2.0**64 + 0.5
        at = np.searchsorted(cuts, x, "right")
        out = starts[len(cuts) - at]
        if len(cuts):
            low = np.maximum(at - 1, 0)
            split = (at > 0) & (shares[low] > 0) & (cuts[low] == x)
            out = out + np.where(split, 1 + np.minimum((unit * shares[low]).astype(np.int64), shares[low] - 1), 0)
        return pd.Series(np.where(id_.isna(), starts[-1] + np.minimum((unit * none).astype(np.int64), none - 1), out).astype(np.int32))

    rows = rows.withColumn("_h", F.xxhash64("_text")).withColumn("bucket", bucket_of("doc_id", "_h"))
    down = F.bitwise_not(F.col("doc_id"))  # falls as the id grows, for every id
    key = F.struct(down.isNull().alias("n"), down.alias("i"), F.col("_h").alias("h"))
    heads = sorted((r["bucket"], r["head"]["i"], r["head"]["h"]) for r in rows.groupBy("bucket").agg(F.min(key).alias("head")).collect())  # at most some MAX_BUCKETS rows
    known = [(b, heads[k - 1][0], i, h) for k, (b, i, h) in enumerate(heads)]  # the first head follows the last bucket
    head = F.broadcast(spark.createDataFrame(known, "bucket int, _to int, _i bigint, _first bigint"))
    own = F.struct(F.col("bucket"), F.lit(True).alias("own"))
    is_head = down.eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_first"))
    placed = rows.join(head, "bucket", "left").withColumn("_at", F.explode(F.when(is_head, F.array(own, F.struct(F.col("_to").alias("bucket"), F.lit(False).alias("own")))).otherwise(F.array(own))))
    return (
        placed.select("_at.bucket", "_at.own", "doc_id", "_text", "_h")
        .repartition("bucket")
        .sortWithinPartitions("bucket", F.desc("own"), F.desc_nulls_last("doc_id"), "_h", "_text")
        .drop("_h")
    )


def fingerprint_pairs(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix``.

    The edited text is the document's own with the last floor(n_chars / 2) code
    points replaced by the first as many (or all) of the next document.  Next is the
    next smaller id; after the smallest comes the largest, so a lone document is its
    own next.  Equal ids follow each other by text hash and text, null ids come last.
    ``common_prefix`` is the longest common extension of text and edited text at
    their starts.  Null counts as empty; two empty texts are alike (1).  Other
    columns are not read; an empty table gives no rows.  Memory: about 100 bytes for
    each character of the longest pair.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("_text"))
    return in_pairs(rows).mapInArrow(_streamed, SHAPE)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
