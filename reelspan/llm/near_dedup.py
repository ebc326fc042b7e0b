"""MinHash near-dedup by a multi-index Hamming join.

A text's signature is ``SLOTS`` min-hash slots of 8 bits.  It is cut into 14
chunks of 8 slots, and of each chunk one wrong slot is allowed: a key is a chunk
with one slot left out, so a text has 112 keys.  By pigeonhole, two signatures
that differ in at most 27 slots agree on some key.  At a Jaccard similarity of
0.8 a chunk agrees but for one slot with probability 0.503, so a pair is missed
with probability 0.497**14 = 6e-5, less above it.

Texts with the same set are one node from the start.  Nodes that share a key and
whose signatures differ in at most ``MOST_WRONG`` slots (six deviations beyond what
0.8 gives) are linked into superclusters; of a key that very many share, every
node is linked with the first.  Superclusters only limit where links can be; inside
them every pair is decided on the full sets, by intersection counts over an
inverted list.  A supercluster whose sets are large is cut into blocks of bounded
size by hash.  Each block is decided by itself, with a few hubs that all blocks
share; what the largest part so far does not have is then held against every block.
So a large group of copies costs work in proportion to its size, no group grows
with the corpus, and no link is lost.  Tasks return spanning forests, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm import bloom
from reelspan.llm.bloom import mix
from reelspan.llm.components import components
from reelspan.llm.names import quoted
from reelspan.llm.scratch import bounded_batches, written
from reelspan.llm.spans import LOWER, Words, text_chunks

CHUNKS, CHUNK_SLOTS = 14, 8
SLOTS = CHUNKS * CHUNK_SLOTS
#: Slots in which the signatures of linked texts may differ: at 0.8 about 22 do, with a deviation of 4.
MOST_WRONG = 50
#: Nodes of one key that are compared with each other; of a key that more share, each is linked with the first.
COMPARED = 64
#: Set elements in a block: 8 MB of hashes.
BLOCK_ELEMENTS = 1_000_000
#: Nodes of which one task makes all keys, in at most so many tasks.
PART_NODES, MOST_PARTS = 4096, 20_000

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, (SLOTS, 256), dtype=np.uint64)  # of a slot's value, in keys


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the ``size``-word shingles of each text, and the offsets of texts in them.

    A text of fewer words, but at least one, has its whole sequence as one shingle.
    """
    h, first = words.hash, words.first
    n = np.diff(first)
    all_of = mix(h) if size == 1 else np.zeros(max(len(h) - size + 1, 0), np.uint64)
    if size > 1:
        for k in range(size):
            all_of = mix(all_of + h[k : k + len(all_of)] * np.uint64(2 * k + 3))
    parts, counts = [], np.zeros(len(n), np.int64)
    for i in np.flatnonzero(n):
        if n[i] >= size:
            own = np.sort(all_of[first[i] : first[i + 1] - size + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        else:
            own = mix(np.array([hash_of_few(h[first[i] : first[i + 1]])], np.uint64))
        parts.append(own)
        counts[i] = len(own)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), offsets


def hash_of_few(h: np.ndarray) -> int:
    out = 0x5851F42D4C957F2D
    for x in h.tolist():
        out = (out * 0x5DEECE66D + x) % (1 << 64)
    return out


def set_names(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set; 0 for the empty set."""
    full = np.diff(offsets) > 0
    names = []
    for salt in (0x1F3D5B79, 0x2468ACE1):
        out = np.zeros(len(offsets) - 1, np.uint64)
        if len(values):
            out[full] = mix(np.add.reduceat(mix(values ^ np.uint64(salt)), offsets[:-1][full]))
        names.append(out.view(np.int64))
    return names[0], names[1]


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SLOTS bytes for each set, zeros for the empty set."""
    full = np.diff(offsets) > 0
    out = np.zeros((len(offsets) - 1, SLOTS), np.uint8)
    if len(values):
        at = offsets[:-1][full]
        for k in range(SLOTS):
            least = np.minimum.reduceat((values * _FACTORS[k] + _TERMS[k]) >> np.uint64(24), at)
            out[full, k] = (mix(least) & np.uint64(255)).astype(np.uint8)
    return out


def _fixed_binary(rows: np.ndarray) -> pa.Array:
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
    return flat.cast(pa.binary())


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for rows, data, offsets in text_chunks(texts):
                values, cuts = shingles(Words(data, offsets, LOWER), size)
                a, b = set_names(values, cuts)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(rows.start, rows.stop - rows.start), pa.array(np.diff(cuts)), pa.array(a), pa.array(b), _fixed_binary(signatures(values, cuts))],
                    names=["doc_id", "n_shingles", "node", "node2", "signature"],
                )

    return run


def _keys_of(keep: bloom.Filter | None, without: bloom.Filter | None = None, signed: bool = False):
    """Keys of each node, of those that may be in ``keep`` and are not in ``without``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            for low in range(0, len(nodes), 4096):
                own = nodes[low : low + 4096]
                raw = batch.column(1).slice(low, len(own)).to_pylist()
                signature = np.frombuffer(b"".join(raw), np.uint8).reshape(len(own), SLOTS)
                placed = np.stack([_PLACE[k][signature[:, k]] for k in range(SLOTS)], axis=1)
                sums = placed.reshape(len(own), CHUNKS, CHUNK_SLOTS).sum(axis=2, dtype=np.uint64)
                for c in range(CHUNKS):
                    for s in range(CHUNK_SLOTS):
                        k = c * CHUNK_SLOTS + s
                        key = mix(sums[:, c] - placed[:, k] + np.uint64(0x632BE59BD9B4E019 * (k + 1) % (1 << 64))).view(np.int64)
                        hit = keep.hits(key) if keep else np.ones(len(key), bool)
                        if without:
                            hit &= ~without.hits(key)
                        at = np.flatnonzero(hit)
                        if len(at):
                            columns = [pa.array(key[at]), pa.array(own[at]), *([_fixed_binary(signature[at])] if signed else [])]
                            yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "signature"][: len(columns)])

    return run


class Forest:
    """Union-find over nodes as they come: tells whether a link joins two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = parent.setdefault(x, x)
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[a] = b
        return a != b


def _alike_in_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, signature) sorted by key: a spanning forest of the alike pairs of this task's keys."""
    forest = Forest()
    left: tuple | None = None
    for batch in batches:
        for low in range(0, len(batch), 16_384):
            part = batch.slice(low, 16_384)
            keys, nodes = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            signature = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(keys), SLOTS)
            if left is not None:
                keys, nodes, signature = (np.concatenate(x) for x in zip(left, (keys, nodes, signature), strict=True))
            a, b = [], []
            for step in range(1, COMPARED):
                at = np.flatnonzero(keys[step:] == keys[:-step])
                if not len(at):
                    break
                at = at[(signature[at] != signature[at + step]).sum(axis=1) <= MOST_WRONG]
                a.append(nodes[at])
                b.append(nodes[at + step])
            links = [(x, y) for x, y in zip(np.concatenate(a or [nodes[:0]]).tolist(), np.concatenate(b or [nodes[:0]]).tolist(), strict=True) if forest.joins(x, y)]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])
            last = np.flatnonzero(keys == keys[-1])  # this key may go on
            left = keys[last], nodes[last], signature[last]


def _sets_of(size: int, wanted: bloom.Filter):
    """Full sets of the documents that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.hits(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            ids, texts = batch.column(0), batch.column(1)
            for rows, data, offsets in text_chunks(texts):
                values, cuts = shingles(Words(data, offsets, LOWER), size)
                node, node2 = set_names(values, cuts)
                raw, at = values.astype("<u8").tobytes(), cuts * 8
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(rows.start, rows.stop - rows.start), pa.array(node), pa.array(node2), pa.array([raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())],
                    names=["doc_id", "node", "node2", "elements"],
                )

    return run


def confirmed_forest(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of all links of 100 * intersection >= percent * union among the sets.

    Exact: from each set in turn, all sets that are not yet in its tree are counted
    against it through the inverted list of their elements.
    """
    m = len(nodes)
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(int(nodes[0]), int(nodes[1]))] if 100 * common >= percent * (sizes.sum() - common) else []
    owner = np.repeat(np.arange(m), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    own_code = np.split(code, np.cumsum(sizes)[:-1])
    left = np.ones(m, bool)
    links, stack = [], []

    def lists(alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = alive[owner]
        order = np.argsort(code[keep], kind="stable")
        return owner[keep][order], np.searchsorted(code[keep][order], np.arange(code.max() + 2))

    members, start = lists(left)
    built = m
    while left.any() or stack:
        if not stack:
            root = int(np.flatnonzero(left)[0])
            left[root] = False
            stack.append(root)
        i = stack.pop()
        n_left = int(left.sum())
        if not n_left:
            break
        if n_left < built // 2:
            members, start = lists(left)
            built = n_left
        low, high = start[own_code[i]], start[own_code[i] + 1]
        width = high - low
        if not width.sum():
            continue
        place = np.repeat(low - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(width.sum())
        common = np.bincount(members[place], minlength=m)
        near = np.flatnonzero(left & (100 * common >= percent * (sizes + sizes[i] - common)))
        left[near] = False
        links += [(int(nodes[i]), int(nodes[j])) for j in near]
        stack += near.tolist()
    return links


def _confirm(percent: int):
    """Rows sorted by group (cluster, i, j); each group is decided when its last row has come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, sets, out = None, [], [], []

        def decided() -> None:
            if len(nodes) > 1:
                out.extend(confirmed_forest(np.array(nodes), sets, percent))

        def emitted() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
            out.clear()
            return rows

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            own, elements = batch.column(3).to_pylist(), batch.column(4)
            for k, key in enumerate(keys):
                if key != group:
                    decided()
                    group, nodes, sets = key, [], []
                nodes.append(own[k])
                sets.append(np.frombuffer(elements[k].as_py(), "<u8"))
            if out:
                yield emitted()
        decided()
        yield emitted()

    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of bytes other than space and 0x09 to 0x0D, A to Z in lower
    case.  Documents are linked when 100 * intersection >= percent * union of
    their shingle sets; the component of a document is named by its smallest id.
    A null or empty text has the empty set and is linked with nothing.  Rows that
    repeat an id and text are linked with each other (equal sets).  A null id takes
    part like any other; it is never the name of a component unless all are null.
    Other columns are not read; an empty table gives no rows.  Memory: about 40
    bytes for each byte of the longest text.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.col(quoted(text)).alias("_text"))
    signed = written(rows.mapInArrow(_signed(shingle_words), "doc_id bigint, n_shingles bigint, node bigint, node2 bigint, signature binary"), "near-signed")
    classes = written(
        signed.where("n_shingles > 0").groupBy("node", "node2", "n_shingles").agg(F.min("doc_id").alias("first_doc"), F.first("signature").alias("signature")),
        "near-classes",
    )

    signature_of = classes.select("node", "signature")
    # All keys of all nodes are made and counted here, so the nodes are dealt out evenly first.
    parts = min(MOST_PARTS, classes.count() // PART_NODES + 1)
    shared = written(
        signature_of.repartition(parts).mapInArrow(_keys_of(None), "key bigint, node bigint")
        .groupBy("key")
        .agg(F.min("node").alias("hub"), F.max("node").alias("_last"), F.count(F.lit(1)).alias("_n"))
        .where("hub < _last")
        .select("key", "hub", (F.col("_n") > COMPARED).alias("many")),
        "near-keys",
    )
    n = {r["many"]: r["n"] for r in shared.groupBy("many").agg(F.count(F.lit(1)).alias("n")).collect()}
    hot = bloom.build(shared.where("many").select("key"), n.get(True, 0))
    warm = bloom.build(shared.where("NOT many").select("key"), n.get(False, 0))
    # A key goes one way or the other: no key of many nodes can miss ``hot``; what passes by chance is settled by the join or finds no partner.
    alike = signature_of.mapInArrow(_keys_of(warm, hot, signed=True), "key bigint, node bigint, signature binary").repartition("key").sortWithinPartitions("key")
    few = alike.mapInArrow(_alike_in_keys, "a bigint, b bigint")
    many = signature_of.mapInArrow(_keys_of(hot), "key bigint, node bigint").join(shared.drop("many"), "key").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    clusters = components(few.unionByName(many))

    members = written(clusters.join(classes.drop("signature"), "node").withColumnRenamed("component", "cluster"), "near-members")
    h = F.xxhash64("node")
    sizes = written(
        members.groupBy("cluster").agg(
            F.ceil(F.sum("n_shingles") / F.lit(BLOCK_ELEMENTS)).cast("int").alias("blocks"),
            F.array_distinct(F.array(F.min("node"), F.max("node"), F.min_by("node", h), F.max_by("node", h))).alias("hubs"),
        ),
        "near-sizes",
    )

    def links_in(placed: DataFrame, of: DataFrame) -> DataFrame:
        """Links confirmed in the groups (cluster, i, j) of ``placed``; the nodes are among ``of``."""
        wanted = bloom.build(of.select(F.coalesce("first_doc", F.lit(0))), of.count())
        # Rows that repeat an id and text give the same set twice, which does no harm.
        sets = rows.mapInArrow(_sets_of(shingle_words, wanted), "doc_id bigint, node bigint, node2 bigint, elements binary").withColumnRenamed("doc_id", "first_doc")
        same = [placed[c].eqNullSafe(sets[c]) for c in ("first_doc", "node2")]
        grouped = placed.join(sets, [placed["node"] == sets["node"], *same]).select("cluster", "i", "j", placed["node"], "elements")
        found = grouped.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(_confirm(percent), "a bigint, b bigint")
        return written(found, "near-links")

    # Each block by itself, with its supercluster's hubs.
    own_block = F.pmod(h, F.col("blocks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = members.join(sizes, "cluster")
    first = own.withColumn("i", F.explode(F.when((F.col("blocks") > 1) & F.array_contains("hubs", F.col("node")), everywhere).otherwise(F.array(own_block)))).withColumn("j", F.lit(0))
    links = links_in(first, members)
    linked = components(links)

    # Of a supercluster of several blocks, what its largest part so far does not have is held against all of it.
    large = own.where("blocks > 1").drop("hubs")
    labelled = written(large.join(linked, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component"), "near-parts")
    counts = labelled.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("_n"))
    main = counts.groupBy("cluster").agg(F.max_by("part", F.struct("_n", "part")).alias("main"))
    rest = written(labelled.join(main, "cluster").where("part != main").drop("main", "part"), "near-rest")
    if rest.limit(1).count():
        pieces = rest.groupBy("cluster").agg(F.ceil(F.sum("n_shingles") / F.lit(BLOCK_ELEMENTS)).cast("int").alias("pieces"))
        cut = rest.join(pieces, "cluster").withColumn("j", F.pmod(F.xxhash64("node", F.lit(1)), F.col("pieces")).cast("int")).withColumn("i", F.explode(everywhere))
        whole = labelled.join(pieces, "cluster").withColumn("i", own_block).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        columns = ["cluster", "i", "j", "first_doc", "node", "node2"]
        second = written(cut.select(*columns).unionByName(whole.select(*columns)).distinct(), "near-second")
        linked = components(links.unionByName(links_in(second, labelled.join(pieces.select("cluster"), "cluster", "left_semi"))))

    named = linked.join(classes.select(F.col("node"), "first_doc"), "node")
    least = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    of_node = written(named.join(least, "component").select("node", "component_id"), "near-named")
    own = classes.select("node", "node2", F.col("first_doc").alias("own_id")).join(of_node, "node", "left").select(
        "node", "node2", F.coalesce("component_id", "own_id").alias("component_id")
    )
    own = written(own, "near-components")
    out = signed.drop("signature").join(own, ["node", "node2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=2)


OP8_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, a, coalesce(b, ' ') AS b FROM (
  SELECT doc_id, unnest(list_slice(ws, 1, greatest(len(ws) - 1, 1))) AS a, unnest(CASE WHEN len(ws) > 1 THEN list_slice(ws, 2, len(ws)) ELSE [NULL] END) AS b FROM t WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.a = b.a AND a.b = b.b AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.seen),
g AS (SELECT node, min(seen) AS c FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(g.c, d.doc_id) AS component_id, coalesce(g.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN g ON g.node = d.doc_id
"""
