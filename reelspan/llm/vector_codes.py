"""Product quantisation of vectors in exact integers, with LAESA pivots.

A vector's components become integers and are cut into parts; each part position has its
own codebook, made better by rounds of assigning and averaging.  The pivots of a
position are fixed entries of its first codebook.  Distances of parts to pivots are
computed once and stored with the parts.  In each round only the distances of
pivots to entries are new: their differences are lower bounds by the triangle inequality,
which order the entries for each part and rule most of them out; what is left is
evaluated in integers, so codes, ties and errors are exact.

A round is one scan.  Tasks send sums and counts of their own rows, one row for each
component of a codebook, so no entry gathers its vectors anywhere; codebooks
(parts x entries x components) are all that the driver sees.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.hot import looked_up
from reelspan.llm.names import columns, fresh, quoted
from reelspan.llm.scratch import bounded_batches, written

SCALE, PARTS, ENTRIES, ROUNDS, PIVOTS = 256, 16, 64, 2, 4
#: Rows of a batch that are compared with a codebook at once.
BLOCK_ROWS = 4096
#: Entries whose bounds are least, which are evaluated before any is ruled out.
FIRST = 2

Codebooks = list[np.ndarray]


def integers(vector: Column, scale: int = SCALE) -> Column:
    """Components times ``scale``, rounded down."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def _whole(vector: Column) -> Column:
    """Has no null, NaN or infinite component."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf))), F.lit(False))


def largest(dimension: int) -> int:
    """Integers up to this size in ``dimension`` components keep a squared distance within 62 bits."""
    return math.isqrt((1 << 62) // max(dimension, 1)) // 2


def bounds(dimension: int, parts: int) -> list[int]:
    """Where parts begin and the last one ends; of equal length if ``parts`` divides ``dimension``."""
    return [k * dimension // parts for k in range(parts + 1)]


def pivots_of(entries: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Places of ``n`` entries that are far from one another: the first, then each time the one farthest from those chosen."""
    chosen: list[int] = []
    far = np.full(len(entries), np.inf)
    while len(chosen) < min(n, len(entries)):
        k = int(far.argmax()) if chosen else 0
        if chosen and far[k] == 0:
            break
        chosen.append(k)
        far = np.minimum(far, ((entries - entries[k]).astype(np.float64) ** 2).sum(1))
    return np.array(chosen, np.int64)


def distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of parts (rows) to pivots, as float32."""
    return np.stack([np.sqrt(((parts - p) ** 2).sum(1).astype(np.float64)) for p in pivots], 1).astype(np.float32)


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivot_entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Place of each part's nearest entry (of several the first), its squared distance, and how many distances were evaluated.

    ``to_pivots``: distances of the parts to the pivots; ``pivot_entries``: of pivots to entries.
    """
    low = np.zeros((len(parts), len(entries)), np.float32)
    for k in range(to_pivots.shape[1]):
        np.maximum(low, np.abs(to_pivots[:, k, None] - pivot_entries[k].astype(np.float32)), out=low)
    # Bounds are rounded to float32: none may come out above the distance itself.
    slack = np.float32(1e-3 + 1e-6 * max(float(to_pivots.max(initial=0)), float(pivot_entries.max(initial=0))))
    rows = np.arange(len(parts))
    first = np.argpartition(low, FIRST - 1, axis=1)[:, :FIRST] if len(entries) > FIRST else np.broadcast_to(np.arange(len(entries)), low.shape)
    exact = ((parts[:, None, :] - entries[first]) ** 2).sum(2)
    least = exact.min(1)
    # Entries of an equal distance but a lower place are still looked at.
    low[rows[:, None], first] = np.inf
    row, entry = np.nonzero(low <= (np.sqrt(least.astype(np.float64)).astype(np.float32) * np.float32(1 + 1e-6) + slack)[:, None])
    more = ((parts[row] - entries[entry]) ** 2).sum(1)
    row, entry, value = np.concatenate([np.repeat(rows, first.shape[1]), row]), np.concatenate([first.ravel(), entry]), np.concatenate([exact.ravel(), more])
    order = np.lexsort((entry, value, row))
    at = order[np.searchsorted(row[order], rows)] if len(rows) else order
    return entry[at], value[at], len(value)


def _matrix(column: pa.Array, dtype, rows: int) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(rows, -1)


class _Books:
    """Codebooks of all positions with the pivots' distances to their entries: a few hundred kB, sent with each scan."""

    def __init__(self, books: Codebooks, pivots: Codebooks, cuts: list[int]):
        self.books, self.pivots, self.cuts = books, pivots, cuts
        self.apart = [distances(b, p).T if len(b) else np.zeros((len(p), 0), np.float32) for b, p in zip(books, pivots, strict=True)]

    def assigned(self, vectors: np.ndarray, to_pivots: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each position: its number, the parts, their codes and their squared distances."""
        at = 0
        for k, (book, pivots) in enumerate(zip(self.books, self.pivots, strict=True)):
            parts = vectors[:, self.cuts[k] : self.cuts[k + 1]]
            code, error, _ = nearest(parts, to_pivots[:, at : at + len(pivots)], book, self.apart[k])
            at += len(pivots)
            yield k, parts, code, error


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), BLOCK_ROWS):
            yield batch.slice(low, BLOCK_ROWS)


def _with_pivots(kept: DataFrame, vector: str, pivots: Codebooks, cuts: list[int], names: tuple[str, str]) -> DataFrame:
    """``kept`` with the distances of each vector's parts to their pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            vectors = _matrix(batch.column(vector), np.int64, len(batch))
            found = np.concatenate([distances(vectors[:, a:b], p) for a, b, p in zip(cuts, cuts[1:], pivots, strict=False)], 1)
            listed = pa.ListArray.from_arrays(np.arange(len(batch) + 1, dtype=np.int32) * found.shape[1], pa.array(found.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], names=[*batch.schema.names, names[1]])

    shape = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{shape}, {quoted(names[1])} array<float>")


def _averaged(rows: DataFrame, books: _Books, vector: str, apart: str) -> Codebooks:
    """Codebooks of each entry's parts' floored means; an entry without parts stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, np.int64) for b in books.books]
        counts = [np.zeros(len(b), np.int64) for b in books.books]
        for batch in _blocks(batches):
            for k, parts, code, _ in books.assigned(_matrix(batch.column(0), np.int64, len(batch)), _matrix(batch.column(1), np.float32, len(batch))):
                np.add.at(sums[k], code, parts)
                counts[k] += np.bincount(code, minlength=len(counts[k]))
        for k, (total, n) in enumerate(zip(sums, counts, strict=True)):
            entry, place = np.nonzero(np.broadcast_to(n[:, None] > 0, total.shape))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(entry), k), pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), pa.array(total[entry, place], pa.int64()), pa.array(n[entry], pa.int64())],
                names=["part", "entry", "place", "total", "n"],
            )

    told = rows.select(*columns([vector, apart])).mapInArrow(run, "part int, entry int, place int, total bigint, n bigint")
    # Sums of tasks may pass 64 bits together.
    whole = told.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = [b.copy() for b in books.books]
    for r in whole.collect():  # at most parts x entries x components
        out[r.part][r.entry, r.place] = int(r.total) // r.n
    return out


def _coded(rows: DataFrame, books: _Books, id_col: str, key: str, vector: str, apart: str) -> DataFrame:
    """``vec_id, _key, code, error`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            codes, errors = np.zeros((len(batch), len(books.books)), np.uint8), np.zeros(len(batch), np.int64)
            for k, _, code, error in books.assigned(_matrix(batch.column(2), np.int64, len(batch)), _matrix(batch.column(3), np.float32, len(batch))):
                codes[:, k] = code
                errors += error
            digits = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digits, pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "_key", "code", "error"])

    return rows.select(*columns([id_col, key, vector, apart])).mapInArrow(run, "vec_id bigint, _key string, code string, error bigint")


def digest(books: Codebooks) -> str:
    """SHA-256 of all components by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """One row per kept vector, ``vec_id, code, error, label_error``, and the final codebooks (one matrix a part).

    Rows whose vector is null or empty or has a null, NaN or infinite component are dropped.  All vectors
    must have one length, that of the kept vector with the smallest id: rows of another length are dropped too, as are
    those with an integer beyond ``largest`` (2^27 for 64 components), whose errors would not fit
    BIGINT.  Parts are equal if their number divides that length, else as equal as they can be.

    Each codebook begins as the parts of the ``entries`` (at most 256) smallest ids, ascending; null ids come last, rows
    that share an id by their integers.  Fewer rows make smaller codebooks.  A
    part takes its nearest entry, of several the first; an entry becomes the floored mean of its
    parts, or stays if it has none.  ``code`` has two hex digits a part; ``error`` sums squared
    distances over parts; ``label_error`` sums ``error`` over rows of an equal label, nulls together.
    An empty table gives no rows and empty codebooks.  A label may have any share of the rows.
    """
    if not 1 <= entries <= 256 or parts < 1 or scale < 1:
        raise ValueError("entries must be 1 to 256, parts and scale 1 or more")
    spark = vectors.sparkSession
    bounded_batches(spark)
    own = vectors.select(F.col(quoted(id_col)).cast("bigint").alias("vec_id"), F.col(quoted(label)).cast("string").alias("_label"), F.col(quoted(vector)).alias("_vector"))
    key = F.coalesce(F.concat(F.lit("="), F.col("_label")), F.lit(""))
    kept = own.where(_whole(F.col("_vector")) & (F.size("_vector") > 0)).select("vec_id", key.alias("_key"), "_vector")
    order = [F.asc_nulls_last("vec_id"), F.asc("_x")]
    least = kept.select("vec_id", F.size("_vector").alias("_n")).orderBy(F.asc_nulls_last("vec_id"), "_n").limit(1).collect()
    dimension = least[0]["_n"] if least else 0
    most = float(largest(dimension)) / scale
    fits = (F.size("_vector") == dimension) & F.forall("_vector", lambda x: F.abs(x.cast("double")) < most)
    kept = kept.where(fits).select("vec_id", "_key", integers(F.col("_vector"), scale).alias("_x"))
    start = np.array([r["_x"] for r in kept.orderBy(*order).limit(entries).collect()], np.int64).reshape(-1, max(dimension, 1))
    cuts = bounds(dimension, parts)
    books = [start[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    pivots = [b[pivots_of(b)] for b in books]
    _, apart = fresh(kept, "_x", "_apart")
    if not len(start):
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error")), books
    rows = written(_with_pivots(kept, "_x", pivots, cuts, ("_x", apart)), "vectors")
    for _ in range(rounds):
        books = _averaged(rows, _Books(books, pivots, cuts), "_x", apart)
    coded = written(_coded(rows, _Books(books, pivots, cuts), "vec_id", "_key", "_x", apart), "codes")
    sums = written(coded.groupBy("_key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label-errors")
    total = sums.agg(F.sum("_n")).first()[0]
    found = looked_up(coded, sums, ["_key"], "_n", total)
    return found.select("vec_id", "code", "error", "label_error"), books


def decoded(code: str, books: Codebooks) -> np.ndarray:
    """The integers that a code stands for."""
    return np.concatenate([b[int(code[2 * k : 2 * k + 2], 16)] for k, b in enumerate(books)]) if books else np.zeros(0, np.int64)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("codebooks_sha256", F.lit(digest(books)))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The definition by all distances; ``|p - e|^2`` without the part that all entries share is ``e.e - 2 p.e``, exact in doubles."""
    steps = []
    for k in range(rounds + 1):
        steps.append(
            f"a{k} AS (SELECT p.vec_id, p.part, any_value(p.label) AS label, any_value(p.x) AS x, arg_min(b.entry, {{'d': list_inner_product(b.x, b.x) - 2 * list_inner_product(p.x, b.x), 'e': b.entry}}) AS entry FROM p JOIN b{k} b USING (part) GROUP BY p.vec_id, p.part)"
        )
        if k < rounds:
            steps.append(
                f"m{k} AS (SELECT part, entry, list(v ORDER BY place) AS x FROM (SELECT part, entry, place, floor(sum(v) / count(*)) AS v FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS place FROM a{k}) GROUP BY part, entry, place) GROUP BY part, entry)"
            )
            steps.append(f"b{k + 1} AS (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry))")
    last = f"a{rounds} a JOIN b{rounds} b USING (part, entry)"
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(cast(c AS DOUBLE) * {SCALE})) AS x, row_number() OVER (ORDER BY vec_id) - 1 AS n
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT vec_id, label, n, part, x[part * len(x) // {parts} + 1:(part + 1) * len(x) // {parts}] AS x FROM v CROSS JOIN (SELECT unnest(range({parts})) AS part)),
b0 AS (SELECT part, n AS entry, x FROM p WHERE n < {entries}),
{", ".join(steps)},
d AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, cast(sum(list_inner_product(a.x, a.x) + list_inner_product(b.x, b.x) - 2 * list_inner_product(a.x, b.x)) AS BIGINT) AS error FROM {last} GROUP BY vec_id),
s AS (SELECT sha256(string_agg(cast(cast(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) AS sha FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS place FROM b{rounds}))
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM d CROSS JOIN s
"""


OP12_SQL = _sql()
