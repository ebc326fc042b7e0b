"""Scoring texts by a probabilistic suffix tree over words.

The tree's states are contexts of up to ``depth`` words.  A context is a candidate if it
occurs often enough in the training texts, and a state if its next-word distribution
diverges from that of its longest suffix that is a state: leaving out one occurrence
at a time, its own smoothed counts must predict what followed it better, by a
number of nats.  A word is scored from the longest suffix of its context that is a
state; a state's distribution takes a discount from each count and gives it to its
suffix's, down to the smoothed word frequencies at the root, so every state sums to one.

Texts become blocks of about a million words, written once; words are then numbers.
Level by level, each block asks for its distinct pairs of candidate context and next
word, with its own training counts, once each, in rows by ranges of context hash.  A
group of such rows has all followers of its contexts: it sums the counts, runs
the divergence tests, and answers each block.  A context with a thousandth of all words is dealt
out by follower instead, and the sums of its test are added up between groups.
Neither a frequent word nor a long corpus makes a group larger: blocks are of one size, and
the number of groups follows the number of words.

Hashes have 64 bits (followers of one context 40); words or contexts that collide would be counted together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.names import quoted
from reelspan.llm.scratch import bounded_batches, release_shuffles, written

DEPTH, LEAST_COUNT, LEAST_GAIN, DISCOUNT, ADDED = 3, 4, 2.0, 0.75, 0.1
#: Words of a block (more only for a longer text), pairs of a group, about.
BLOCK_TOKENS = 1 << 20
GROUP_PAIRS = 1 << 20
#: Contexts of more than this share of all training words are dealt out by follower: fewer than so many are.
HOT_SHARE = 1000
END = b"\n"  # no word is white space

#: One shape for blocks (level -1), what they ask (level by level) and what they are told.
SHAPE = "block bigint, level int, bucket bigint, hot boolean, a binary, b binary, c binary, d binary, e binary"
_NAMES = [x.split()[0] for x in SHAPE.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 5]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_TYPES)], names=_NAMES)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def small(values: np.ndarray) -> bytes:
    """An array of mostly small numbers, byte by byte of the numbers, in few bytes."""
    kind = values.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(-1, kind).T.tobytes(), 1)


def back(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed(p: np.ndarray) -> np.ndarray:
    """Probabilities as the number of 1/2048 nats under one: what the divergence tests see."""
    return np.minimum(np.rint(-np.log(p) * 2048), 65535).astype(np.uint16)


def unpacked(steps: np.ndarray) -> np.ndarray:
    """Their logarithms."""
    return steps.astype(np.float64) / -2048


class _Numbers(dict):
    """Numbers of words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _block(block: int, ids: list, held: list, lengths: list, tokens: list[np.ndarray], numbers: _Numbers) -> tuple:
    words = np.concatenate(tokens)
    counts = np.bincount(words, minlength=len(numbers))
    order = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which pack well
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    every = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), np.uint64, len(numbers))[order]
    own = np.array([[i is None, h] for i, h in zip(ids, held, strict=True)], np.uint8)
    return (block, -1, 0, False, np.array([i or 0 for i in ids], np.int64).tobytes(), own.tobytes(), np.array(lengths, np.int64).tobytes(), every.tobytes(), small(rank[words].astype(np.uint32)))


def _to_blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id, held_out and text (bytes) to blocks."""
    block = TaskContext.get().partitionId() << 32
    ids, held, lengths, tokens, numbers, size = [], [], [], [], _Numbers(), 0
    numbers[END] = 0
    for batch in batches:
        own_ids, own_held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for k, text in enumerate(batch.column(2)):
            words = text.as_py().lower().split()  # bytes: letters A-Z and ASCII white space only
            ids.append(own_ids[k])
            held.append(own_held[k])
            tokens.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            tokens.append(np.zeros(1, np.int64))
            lengths.append(len(words) + 1)
            size += lengths[-1]
            if size >= block_tokens:
                yield _rows([_block(block, ids, held, lengths, tokens, numbers)])
                block += 1
                ids, held, lengths, tokens, numbers, size = [], [], [], [], _Numbers(), 0
                numbers[END] = 0
    if ids:
        yield _rows([_block(block, ids, held, lengths, tokens, numbers)])


class Model:
    """What all levels share: a few numbers, and the sums of hot contexts' tests (fewer than ``HOT_SHARE`` a level)."""

    def __init__(self, depth: int, least_count: int, least_gain: float, discount: float, added: float, bits: int, hot_share: int):
        self.depth, self.least_count, self.least_gain, self.discount, self.added, self.bits, self.hot_share = depth, least_count, least_gain, discount, added, bits, hot_share
        self.train_tokens = self.distinct = 0
        self.hot: dict[int, dict[int, int]] = {}

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + self.added) / (self.train_tokens + self.added * (self.distinct + 1))

    def hot_from(self) -> int:
        return max(self.least_count, self.train_tokens // self.hot_share + 1)

    def parts_of_gain(self, n: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each follower, counted n times: what is summed up over a context for its test."""
        several = n >= 2
        left = np.where(several, np.log(np.maximum(n - 1 - self.discount, 1e-300)) - log_p, 0.0)
        return n, n > 0, n == 1, np.where(several, n, 0), n * left

    def states(self, total, followers, single, repeated, fit) -> np.ndarray:
        """Is a context a state?  The gain is that of each occurrence when it is left out of the counts, without what a repeated follower gets from the suffix."""
        total = total.astype(np.float64)
        rest = np.maximum(total - 1, 1)
        gain = fit - repeated * np.log(rest) + single * np.log(np.maximum(self.discount * (followers - 1) / rest, 1e-300))
        return (total >= self.least_count) & (gain > self.least_gain)

    def smoothed(self, n, total, followers, suffix_p) -> np.ndarray:
        return (np.maximum(n - self.discount, 0) + self.discount * followers * suffix_p) / total


class Block:
    """A block's words, and what is known of them after each level."""

    def __init__(self, row: dict, model: Model):
        self.model = model
        self.block = row["block"]
        self.ids = np.frombuffer(row["a"], np.int64)
        self.missing, self.held = np.frombuffer(row["b"], np.uint8).reshape(-1, 2).T.astype(bool)
        self.lengths = np.frombuffer(row["c"], np.int64)
        self.hashes = np.frombuffer(row["d"], np.uint64)
        self.words = back(row["e"], np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~self.held, self.lengths)
        self.place = np.arange(len(self.words)) - np.repeat(self.starts, self.lengths)
        self.order = np.argsort(self.hashes)

    def ask_words(self) -> Iterator[tuple]:
        """Training counts of the distinct words, by ranges of their hash."""
        counts = np.bincount(self.words[self.train], minlength=len(self.hashes))
        sorted_hashes = self.hashes[self.order]
        for bucket, low, high in _ranges(sorted_hashes, self.model.bits):
            yield self.block, 0, bucket, False, sorted_hashes[low:high].tobytes(), None, None, small(counts[self.order[low:high]]), None

    def hear_words(self, answers: list[dict]) -> None:
        self.counts = np.empty(len(self.hashes), np.int64)
        self.counts[self.order] = np.concatenate([back(r["a"], np.int64) for r in answers])
        self.p = self.base = self.model.root(self.counts)[self.words]
        #: Of each word's place: how often the pair of its context and itself occurs, that pair's number, its state's length.
        self.n, self.number, self.length = self.counts[self.words], self.words, np.zeros(len(self.words), np.int8)
        self.number_hash = self.hashes

    def pairs(self, level: int) -> None:
        """Distinct pairs of this level: those of contexts that occur ``least_count`` times.

        A context is the pair one place before, whose number is known from the level below (for one word, the word's own).
        """
        before, number = np.zeros_like(self.n), np.zeros_like(self.number)
        before[1:], number[1:] = self.n[:-1], self.number[:-1]
        self.at = np.flatnonzero((self.place >= level) & (before >= self.model.least_count))
        number = number[self.at]
        known = np.zeros(len(self.number_hash), bool)
        known[number] = True
        some = np.flatnonzero(known)
        hashes = mixed(self.number_hash[some] + np.uint64(level))
        order = np.argsort(hashes)
        self.contexts = hashes[order]
        rank = np.empty(len(self.number_hash), np.int64)
        rank[some[order]] = np.arange(len(some))
        which = rank[number]
        key, self.pair = np.unique(which * len(self.hashes) + self.words[self.at], return_inverse=True)
        one = np.empty(len(key), np.int64)  # a place of each pair: what is known of it is the same at all of them
        one[self.pair] = np.arange(len(self.at))
        self.pair_context, word = np.divmod(key, max(len(self.hashes), 1))
        self.pair_word = self.hashes[word] >> np.uint64(24)
        self.pair_p = self.p[self.at][one]
        self.pair_hash = mixed(self.contexts[self.pair_context] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[word])
        self.context_n = np.empty(len(some), np.int64)
        self.context_n[which] = before[self.at]
        self.context_hot = self.context_n >= self.model.hot_from()
        hot = self.context_hot[self.pair_context]
        whole = np.flatnonzero(~hot)
        apart = np.flatnonzero(hot)
        dealt = mixed(self.contexts[self.pair_context[apart]] ^ self.pair_word[apart])
        apart = apart[np.argsort(dealt, kind="stable")]
        #: Places of pairs in the order in which they are asked for, and the hash that deals each out.
        self.asked = {False: (whole, self.contexts[self.pair_context[whole]]), True: (apart, np.sort(dealt))}

    def ask(self, level: int) -> Iterator[tuple]:
        self.pairs(level)
        counts = np.bincount(self.pair, weights=self.train[self.at], minlength=len(self.pair_p)).astype(np.uint32)
        for hot, (pairs, dealt) in self.asked.items():
            for bucket, low, high in _ranges(dealt, self.model.bits):
                own = pairs[low:high]
                if hot:
                    contexts, sizes = self.contexts[self.pair_context[own]], np.ones(len(own), np.uint32)
                else:
                    some, sizes = np.unique(self.pair_context[own], return_counts=True)
                    contexts = self.contexts[some]
                words = self.pair_word[own].view(np.uint8).reshape(-1, 8)[:, :5]
                # Contexts come in ascending order (hot ones almost): their differences are smaller.
                steps = np.diff(contexts, prepend=np.uint64(0))
                yield self.block, level, bucket, hot, small(steps), small(sizes.astype(np.uint32)), words.tobytes(), small(counts[own]), small(packed(self.pair_p[own]))

    def hear(self, level: int, answers: list[dict]) -> None:
        self.pairs(level)
        n = np.zeros(len(self.pair_p), np.int64)
        followers = np.zeros(len(self.contexts), np.int64)  # of states; 0 of other contexts
        for hot, (pairs, _) in self.asked.items():
            told = [r for r in answers if r["hot"] == hot]
            if told:
                n[pairs] = np.concatenate([back(r["a"], np.int64) for r in told])
            if told and not hot:
                followers[~self.context_hot] = np.concatenate([back(r["b"], np.int64) for r in told])
        known = self.model.hot.get(level, {})
        for k in np.flatnonzero(self.context_hot).tolist():
            followers[k] = known[int(self.contexts[k])]
        c = self.pair_context
        state = followers[c] > 0
        p = np.where(state, self.model.smoothed(n, self.context_n[c], followers[c], self.pair_p), self.pair_p)
        self.p = self.p.copy()
        self.p[self.at] = p[self.pair]
        self.length[self.at[state[self.pair]]] = level
        self.n, self.number = np.zeros_like(self.n), np.zeros_like(self.number)
        self.n[self.at], self.number[self.at] = n[self.pair], self.pair
        self.number_hash = self.pair_hash

    def scores(self) -> pa.RecordBatch:
        per = lambda x: np.add.reduceat(x, self.starts)  # noqa: E731  a text has a word at least: its end
        known = per((self.counts[self.words] > 0).astype(np.int64))
        values = [
            pa.array(self.ids, pa.int64(), mask=self.missing), pa.array(self.held, pa.bool_()), pa.array(self.lengths, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(self.ids), self.model.train_tokens), pa.int64()),
            pa.array(per(np.log10(self.base))), pa.array(per(np.log10(self.p))), pa.array(per(self.length.astype(np.float64)) / self.lengths),
        ]
        return pa.RecordBatch.from_arrays(values, names=[x.split()[0] for x in SCORES.split(", ")])


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, mean_length double"


def _ranges(sorted_hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Non-empty stretches of ascending hashes that share their first ``bits``."""
    bucket = (sorted_hashes >> np.uint64(63 - bits)) >> np.uint64(1)
    cut = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])) if len(bucket) else np.zeros(1, np.int64)
    for low, high in zip(cut.tolist(), cut[1:].tolist(), strict=False):
        yield int(bucket[low]), low, high


def _known(table: pa.Table, model: Model, levels: int) -> Block:
    """A block with the answers of the levels before ``levels``."""
    rows = table.to_pylist()
    block = Block(next(r for r in rows if r["level"] == -1), model)
    for level in range(levels):
        answers = sorted((r for r in rows if r["level"] == level), key=lambda r: (r["hot"], r["bucket"]))
        block.hear(level, answers) if level else block.hear_words(answers)
    return block


def _count_words(table: pa.Table) -> pa.Table:
    """Answers to blocks on words of one range of hashes, and for block -1 how many words and tokens the range has."""
    rows = table.to_pylist()
    keys = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows])
    _, which = np.unique(keys, return_inverse=True)
    totals = np.zeros(int(which.max()) + 1, np.int64)
    np.add.at(totals, which, np.concatenate([back(r["d"], np.int64) for r in rows]))
    out, at = [(-1, 0, rows[0]["bucket"], False, np.array([np.count_nonzero(totals), totals.sum()], np.int64).tobytes(), None, None, None, None)], 0
    for r in rows:
        n = len(r["a"]) // 8
        out.append((r["block"], 0, r["bucket"], False, small(totals[which[at : at + n]]), None, None, None, None))
        at += n
    return pa.Table.from_batches([_rows(out)])


def _count_pairs(table: pa.Table, model: Model) -> pa.Table:
    """Answers to blocks on pairs: counts of each pair, and of each context its number of followers if it is a state, else 0.

    Of hot contexts only a part of the followers is here: sums for their tests go to block -1.
    """
    rows = table.to_pylist()
    level, bucket, hot = rows[0]["level"], rows[0]["bucket"], rows[0]["hot"]
    own = [np.cumsum(back(r["a"], np.uint64), dtype=np.uint64) for r in rows]
    sizes = [back(r["b"], np.uint32).astype(np.int64) for r in rows]
    every, which = np.unique(np.concatenate(own), return_inverse=True)
    contexts = np.repeat(which, np.concatenate(sizes))  # numbers of contexts, in order of their hash
    short = np.frombuffer(b"".join(r["c"] for r in rows), np.uint8).reshape(-1, 5)
    words = np.zeros((len(short), 8), np.uint8)
    words[:, :5] = short
    words = words.view(np.uint64).ravel()
    counts, p = (np.concatenate([back(r[c], kind) for r in rows]) for c, kind in (("d", np.uint32), ("e", np.uint16)))
    # A follower has 40 bits; contexts of one group are far fewer than 2^24, else they are sorted by both.
    order = np.argsort(contexts.astype(np.uint64) << np.uint64(40) | words) if len(every) < 1 << 24 else np.lexsort((words, contexts))
    contexts, words = contexts[order], words[order]
    new_context = np.concatenate(([True], contexts[1:] != contexts[:-1]))
    new_pair = new_context | np.concatenate(([True], words[1:] != words[:-1]))
    first = np.flatnonzero(new_pair)
    n = np.add.reduceat(counts[order].astype(np.int64), first)
    found = np.empty(len(order), np.int64)
    found[order] = n[np.cumsum(new_pair) - 1]
    starts = np.flatnonzero(new_context[first])
    sums = [np.add.reduceat(x.astype(np.float64) if k == 4 else x.astype(np.int64), starts) for k, x in enumerate(model.parts_of_gain(n, unpacked(p[order][first])))]
    state = np.zeros(len(every), bool) if hot else model.states(*sums)
    out, at, seen = [], 0, 0
    if hot:
        out.append((-1, level, bucket, True, every.tobytes(), *[x.tobytes() for x in (np.stack(sums[:4]), sums[4])], None, None))
    for r, some, n_each in zip(rows, own, sizes, strict=True):
        k = int(n_each.sum())
        about = None
        if not hot:
            where = which[seen : seen + len(some)]
            seen += len(some)
            about = small(np.where(state[where], sums[1][where], 0))  # only states use their number of followers
        out.append((r["block"], level, bucket, hot, small(found[at : at + k]), about, None, None, None))
        at += k
    return pa.Table.from_batches([_rows(out)])


def _hot_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            sums = np.frombuffer(r["b"], np.int64).reshape(4, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["a"], np.int64)), *map(pa.array, sums), pa.array(np.frombuffer(r["c"], np.float64))], names=["context", "total", "followers", "single", "repeated", "fit"])


def _asking(blocks: DataFrame, told: list[DataFrame], model: Model, level: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        block = _known(table, model, level)
        rows = list(block.ask(level) if level else block.ask_words())
        return pa.Table.from_batches([_rows(rows)])

    return _of_blocks(blocks, told).applyInArrow(run, SHAPE)


def _of_blocks(blocks: DataFrame, told: list[DataFrame]):
    out = blocks
    for answers in told:
        out = out.unionByName(answers.where("block >= 0"))
    return out.groupBy("block")


def score_texts(docs: DataFrame, held_out: Column, text: str = "text", id_col: str = "doc_id", depth: int = DEPTH, least_count: int = LEAST_COUNT, least_gain: float = LEAST_GAIN, discount: float = DISCOUNT, added: float = ADDED, block_tokens: int = BLOCK_TOKENS, group_pairs: int = GROUP_PAIRS, hot_share: int = HOT_SHARE) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mean_length``.

    Words are stretches without ASCII white space, A-Z in lower case; an end follows the last one and counts as a word.  The
    tree is learned from the documents of which ``held_out`` is not true, all of them.  ``base_score`` is the log10
    probability of the text by smoothed word frequencies (``added`` to each count, all unknown words being one more),
    ``score`` by the tree; ``mean_length`` is the mean length of the states that its words were scored from.

    A null or empty text is an end alone.  Ids only pass through: they may be null or repeat.  Without
    training documents both scores are 0 for every word.  An empty table gives no rows; other columns are not read.
    A text takes some 60 bytes for each of its words in the tasks that have it; contexts do not
    reach across texts.  ``depth`` 0 scores from the root alone.  ``block_tokens``, ``group_pairs`` and
    ``hot_share`` set how the work is dealt out, not what comes of it.
    """
    if depth < 0 or least_count < 2 or not 0 < discount < 1 or added <= 0:
        raise ValueError("depth 0 or more, least_count 2 or more, discount between 0 and 1, added above 0")
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks, told, model = _learned(docs, held_out, text, id_col, Model(depth, least_count, least_gain, discount, added, 0, hot_share), block_tokens, group_pairs)

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_known(table, model, depth + 1).scores()])

    return _of_blocks(blocks, told).applyInArrow(run, SCORES)


def _learned(docs: DataFrame, held_out: Column, text: str, id_col: str, model: Model, block_tokens: int, group_pairs: int) -> tuple[DataFrame, list[DataFrame], Model]:
    """The blocks, the answers to them level by level, and the model's own few numbers."""
    rows = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(quoted(text)), F.lit("")).cast("binary").alias("text"))
    blocks = written(rows.mapInArrow(lambda batches: _to_blocks(batches, block_tokens), SHAPE), "suffix-blocks")
    # A word takes some 1.5 bytes: only the number of groups hangs on it.
    size = blocks.agg(F.sum(F.length("e"))).first()[0] or 0
    model.bits = max(0, math.ceil(math.log2(max(1, size / 1.5 / group_pairs))))

    answers = written(_asking(blocks, [], model, 0).groupBy("bucket").applyInArrow(_count_words, SHAPE), "suffix-words")
    told = [answers]
    about = answers.where("block = -1").mapInArrow(_pairs_of_numbers, "distinct bigint, tokens bigint").agg(F.sum("distinct"), F.sum("tokens")).first()
    model.distinct, model.train_tokens = about[0] or 0, about[1] or 0
    release_shuffles(docs.sparkSession)
    for level in range(1, model.depth + 1):
        asked = _asking(blocks, told, model, level)
        answers = written(asked.groupBy("bucket", "hot").applyInArrow(lambda table: _count_pairs(table, model), SHAPE), "suffix-pairs")
        sums = answers.where("block = -1").select("a", "b", "c").mapInArrow(_hot_sums, "context bigint, total bigint, followers bigint, single bigint, repeated bigint, fit double")
        found = sums.groupBy("context").agg(*[F.sum(c).alias(c) for c in ("total", "followers", "single", "repeated", "fit")]).collect()  # fewer than HOT_SHARE
        model.hot[level] = {r.context & (1 << 64) - 1: r.followers if model.states(*(np.array([x]) for x in r[1:]))[0] else 0 for r in found}
        told.append(answers)
        del asked
        release_shuffles(docs.sparkSession)
    return blocks, told, model


def _pairs_of_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([np.frombuffer(a, np.int64) for a in batch.column("a").to_pylist()], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["distinct", "tokens"])


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # A null id counts as empty text.
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    return score_texts(docs, held).drop("mean_length")
