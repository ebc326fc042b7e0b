"""Substring dedup by compaction of a de Bruijn graph of token k-mers.

Edges are the ``span``-word windows of the texts, nodes the ``span - 1`` words that two
windows in a row share.  Windows in a row that have the same minimiser (the least of their
25-word k-mers by hash) travel as one edge, and only minimisers of more than one
document are looked at: equal windows have equal minimisers, so no repeat is lost.

* Scan one finds, for each minimiser, whether several documents have it and whether all
  its occurrences continue alike over the windows that have it.  If so, those windows are
  one edge already; if not, each is an edge of its own.
* Equal edges become one, with the coordinates (document, place) of its source: where it
  stands in the document of the smallest id.  Edges of one document go.
* In- and out-degrees of the nodes: at a node with one edge in and one out, whose source
  coordinates go on from one to the other, the path does not branch.  Such paths compact by
  joins that double their pointers, so rounds are the logarithm of the longest path.
* Occurrences of a path's edges that stand in a row in another document are one long
  repeated span, with the source it repeats.
* Only documents that have spans are shuffled with their text.

That two edges are equal rests on 128 bits of hash (minimiser and window, or minimiser
and context); paths only join what is known to be repeated.  Windows are judged on the input, not on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm import bloom
from reelspan.llm.bloom import mix
from reelspan.llm.names import quoted
from reelspan.llm.scratch import bounded_batches, stored, written
from reelspan.llm.spans import Words, prefix_sums, span_hashes, text_chunks

SPAN_WORDS = 50
EDGE_WORDS = 25


def _least_in_each(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in every stretch of ``width`` values."""
    at, have = np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(h[a] <= h[b], a, b)
        have += step
    return at


class Edges:
    """The windows of a chunk of texts, those in a row with one minimiser together."""

    def __init__(self, words: Words, span: int, edge: int):
        n_words = len(words.hash)
        self.size = 0
        if n_words < span:
            return
        self.prefix = prefix_sums(words.hash)
        place = np.arange(n_words - edge + 1)
        edges = span_hashes(self.prefix, place, place + edge)
        chosen = _least_in_each(edges, span - edge + 1)
        text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        window = np.flatnonzero(text[: n_words - span + 1] == text[span - 1 :])
        if not len(window):
            return
        chosen = chosen[window]
        new = np.concatenate(([True], (np.diff(chosen) != 0) | (np.diff(text[window]) != 0)))
        first = np.flatnonzero(new)
        self.count = np.diff(np.concatenate((first, [len(window)])))
        self.window, edge_at = window[first], chosen[first]
        self.text = text[self.window]
        self.minimiser = edges[edge_at].view(np.int64)
        inside = mix(span_hashes(self.prefix, self.window, self.window + self.count - 1 + span) + (edge_at - self.window).astype(np.uint64))
        self.context = mix(inside + self.count.astype(np.uint64)).view(np.int64)
        self.place = self.window - words.first[self.text]
        self.size = len(first)


def _scan(span: int, edge: int):
    """Minimisers with id and context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_chunks(batch.column(1)):
                found = Edges(Words(data, offsets), span, edge)
                if found.size:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.minimiser), pa.array(found.context), batch.column(0).slice(rows.start, rows.stop - rows.start).take(pa.array(found.text))],
                        names=["minimiser", "context", "doc_id"],
                    )

    return run


OCCURRENCE = "minimiser bigint, label bigint, doc_id bigint, text_hash bigint, place bigint, n bigint, tail bigint, head bigint"


def _occurrences(span: int, edge: int, repeated: bloom.Filter, branching: bloom.Filter):
    """Edges of minimisers that may be repeated, from node ``tail`` to node ``head``; where one may branch, each window by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_chunks(batch.column(2)):
                found = Edges(Words(data, offsets), span, edge)
                if not found.size:
                    continue
                own = np.flatnonzero(repeated.hits(found.minimiser))
                if not len(own):
                    continue
                apart = branching.hits(found.minimiser[own])
                pieces = np.where(apart, found.count[own], 1)
                cuts = np.concatenate(([0], np.cumsum(pieces)))
                of = np.repeat(np.arange(len(own)), pieces)
                shift = np.arange(cuts[-1]) - cuts[:-1][of]
                start, n = found.window[own][of] + shift, np.where(apart, 1, found.count[own])[of]
                label = np.where(apart[of], span_hashes(found.prefix, start, start + span).view(np.int64), found.context[own][of])
                row = pa.array(found.text[own][of] + rows.start)
                node = lambda at: pa.array(span_hashes(found.prefix, at, at + span - 1).view(np.int64))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.minimiser[own][of]), pa.array(label), batch.column(0).take(row), batch.column(1).take(row),
                        pa.array(found.place[own][of] + shift), pa.array(n.astype(np.int64)), node(start), node(start + n),
                    ],
                    names=[c.split()[0] for c in OCCURRENCE.split(", ")],
                )

    return run


def compacted(edges: DataFrame) -> DataFrame:
    """``source, place, start``: where the non-branching path of each edge starts, of edges ``source, place, n, tail, head`` that do not start one.

    A path goes on through a node with one edge in and one out if the source goes on as well.
    """
    ends = edges.select(F.col("head").alias("node"), "source", "place", "n", F.lit(1).alias("into")).unionByName(edges.select(F.col("tail").alias("node"), "source", "place", "n", F.lit(0).alias("into")))
    one = lambda c, into: F.max(F.when(F.col("into") == into, F.col(c)))
    nodes = ends.groupBy("node").agg(
        F.sum("into").alias("n_in"), F.sum(1 - F.col("into")).alias("n_out"), one("source", 1).alias("source"), one("source", 0).alias("source_out"),
        one("place", 1).alias("before"), one("n", 1).alias("n"), one("place", 0).alias("place"),
    )
    straight = nodes.where("n_in = 1 AND n_out = 1 AND source = source_out AND before + n = place")
    # ``jump``: an edge further ahead on the path, at last its first.  The places on a path only grow, so it has no cycle.
    active = straight.groupBy("source", "place").agg(F.min("before").alias("jump"))
    shape, spark = "source bigint, place bigint, jump bigint", edges.sparkSession
    path, done = stored(active, "graph-links"), []
    while True:
        active = spark.read.schema(shape).parquet(path)
        if not active.limit(1).count():
            break
        known = spark.read.schema(shape).parquet(path, *done).select("source", F.col("place").alias("jump"), F.col("jump").alias("_jump"))
        moved = written(active.join(known, ["source", "jump"], "left"), "graph-jumps")
        done.append(stored(moved.where("_jump IS NULL").select("source", "place", "jump"), "graph-done"))
        path = stored(moved.where("_jump IS NOT NULL").select("source", "place", F.col("_jump").alias("jump")), "graph-links")
    found = spark.read.schema(shape).parquet(*done) if done else active
    return found.withColumnRenamed("jump", "start")


def _repeats(rows: DataFrame, span: int, edge: int) -> DataFrame:
    """``doc_id, text_hash, place, stop, source_doc, source_place``: long spans of words that repeat what stands in a document with a smaller id.

    ``rows``: doc_id, text_hash, _text.
    """
    found = rows.select("doc_id", "_text").mapInArrow(_scan(span, edge), "minimiser bigint, context bigint, doc_id bigint")
    several = found.groupBy("minimiser").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"), F.min("context").alias("_low"), F.max("context").alias("_high"))
    several = written(several.where("_first < _last").select("minimiser", (F.col("_low") != F.col("_high")).alias("branches")), "graph-minimisers")
    n = {r["branches"]: r["n"] for r in several.groupBy("branches").agg(F.count(F.lit(1)).alias("n")).collect()}
    # What passes a filter by chance does so wherever it stands, and is found to be of one document, or is taken window by window.
    repeated = bloom.build(several.select("minimiser"), sum(n.values()))
    branching = bloom.build(several.where("branches").select("minimiser"), n.get(True, 0))

    own = written(rows.select("doc_id", "text_hash", "_text").mapInArrow(_occurrences(span, edge, repeated, branching), OCCURRENCE), "graph-occurrences")
    edges = own.groupBy("minimiser", "label").agg(
        F.min("doc_id").alias("source"), F.max("doc_id").alias("_last"), F.min_by("place", "doc_id").alias("place"), F.max("n").alias("n"), F.max("tail").alias("tail"), F.max("head").alias("head")
    )
    edges = written(edges.where("source < _last").drop("_last"), "graph-edges")
    paths = compacted(edges.select("source", "place", "n", "tail", "head"))
    edges = edges.select("minimiser", "label", "source", F.col("place").alias("source_place")).join(paths.withColumnRenamed("place", "source_place"), ["source", "source_place"], "left")
    edges = written(edges.withColumn("start", F.coalesce("start", "source_place")), "graph-paths")

    # Of each document, path and shift between the two, the stretches without a gap.
    again = own.select("minimiser", "label", "doc_id", "text_hash", "place", (F.col("place") + F.col("n")).alias("next")).join(edges, ["minimiser", "label"]).where("doc_id > source")
    again = again.groupBy("doc_id", "text_hash", "source", "start", (F.col("place") - F.col("source_place")).alias("shift")).agg(F.array_sort(F.collect_set(F.struct("place", "next"))).alias("parts"))
    firsts = F.filter("parts", lambda x, i: F.coalesce(F.get("parts", i - 1)["next"] < x["place"], F.lit(True)))
    lasts = F.filter("parts", lambda x, i: F.coalesce(F.get("parts", i + 1)["place"] > x["next"], F.lit(True)))
    spans = again.select("doc_id", "text_hash", "source", "shift", F.inline(F.arrays_zip(F.transform(firsts, lambda x: x["place"]).alias("place"), F.transform(lasts, lambda x: x["next"]).alias("next"))))
    return spans.select("doc_id", "text_hash", "place", (F.col("next") - 1 + span).alias("stop"), F.col("source").alias("source_doc"), (F.col("place") - F.col("shift")).alias("source_place"))


def _rows(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    rows = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("_text"))
    return rows.withColumn("text_hash", F.xxhash64("_text"))


def repeated_spans(docs: DataFrame, span_words: int = SPAN_WORDS, edge_words: int = EDGE_WORDS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, place, stop, source_doc, source_place``: words [place, stop) of a document repeat those from source_place on of one with a smaller id.

    Of several sources of a window the smallest id is told.  See ``remove_repeats`` for words, and
    for odd rows; spans of a document may overlap.
    """
    bounded_batches(docs.sparkSession)
    return _repeats(_rows(docs, text, id_col), span_words, edge_words).drop("text_hash")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, spans = batch.column(0), batch.column(1), batch.column(2)
        low = 0
        while low < len(batch):  # the results of at most some MB of text at once
            n_words, n_removed, kept, size = [], [], [], 0
            first = low
            while low < len(batch) and size < 1 << 23:
                words = (texts[low].as_py() or "").encode().split()
                size += 8 * len(words)
                take, done = [], 0
                # Spans as two arrays, in order of place.
                own = spans[low].values
                if own is not None:
                    place, stop = (own.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    order = np.argsort(place, kind="stable")
                    for a, b in zip(place[order].tolist(), stop[order].tolist(), strict=True):
                        take += words[done : max(done, a)]
                        done = max(done, b)
                take += words[done:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(take))
                kept.append(b" ".join(take).decode())
                low += 1
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, low - first), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )


def remove_repeats(docs: DataFrame, span_words: int = SPAN_WORDS, edge_words: int = EDGE_WORDS, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_text``.

    Words are runs of bytes other than space and 0x09 to 0x0D, unchanged.  A word
    goes when a window of ``span_words`` consecutive words covers it whose word
    sequence also starts in a document with a smaller id.  ``kept_text`` is the
    other words joined by one space.  A null or empty text has no words; rows that
    repeat an id are never repeats of each other; a null id is no source, and the
    text of such a row stays whole.  Other columns are not read; an empty table
    gives no rows.  Memory: about 60 bytes for each byte of the longest text.
    """
    bounded_batches(docs.sparkSession)
    rows = _rows(docs, text, id_col)
    spans = _repeats(rows, span_words, edge_words)
    spans = written(spans.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("place", "stop")).alias("spans")), "graph-spans")

    # Only documents that lose words meet their spans; the others pass straight through.
    key = F.xxhash64("doc_id", "text_hash")
    losing = bloom.build(spans.select(key), spans.count())
    keyed = rows.withColumn("_maybe", losing.maybe(key))
    shape = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"
    whole = keyed.where(~F.col("_maybe")).select("doc_id", "_text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    cut = keyed.where("_maybe").join(spans.hint("shuffle_hash"), ["doc_id", "text_hash"], "left").select("doc_id", "_text", "spans")
    return whole.unionByName(cut).mapInArrow(_removed, shape)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM t),
s AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i + 1, i + 50), ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS i FROM t WHERE len(ws) >= 50)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS src FROM s) WHERE src < doc_id),
m AS (SELECT w.doc_id, w.i, w.word, max(f.i) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM w LEFT JOIN f ON f.doc_id = w.doc_id AND f.i = w.i),
k AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n, 0) AS n_words, coalesce(k.r, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""
