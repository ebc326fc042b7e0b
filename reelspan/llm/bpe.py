"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The pieces of a pre-token are a doubly linked list over its byte positions.  A
merge rank's bucket holds the positions whose pair has that rank; three levels
of 64-bit words mark the ranks with a bucket, so find-first-set gives the lowest
rank in three steps.  A position in a bucket whose pair has changed since is
stale and skipped.  A pre-token of n bytes takes O(n log n) at most (the sort of
a bucket's positions), where scanning for the best pair takes O(n * n).

The rank file is read once by the driver (a vocabulary of fixed size, under 2
MB) and broadcast; its path is a parameter.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.names import quoted
from reelspan.llm.scratch import bounded_batches

#: Distinct pre-tokens in a generation of what a Python worker remembers (two generations are kept, about 190 MB).
REMEMBERED = 450_000
#: Bytes of text whose ids are returned at once.
EMIT_BYTES = 1 << 22


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Buckets of positions by rank under three levels of 64-bit words; empty between pre-tokens."""

    def __init__(self, ranks: int):
        words = (ranks >> 6) + 1
        self.low = [0] * words
        self.mid = [0] * ((words >> 6) + 1)
        self.buckets: dict[int, list[int]] = {}


class Encoder:
    """Ids of pre-tokens, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values(), default=0))
        self.split = regex.compile(pattern).findall
        self.packed = Remembered(self)
        self.vocabulary = {rank: token for token, rank in ranks.items()}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token.  Pushes and pops are written out: calls would cost more than they do."""
        rank_of = self.ranks.get
        whole = rank_of(piece)
        if whole is not None:
            return [whole]
        low, mid, buckets, top = self.queue.low, self.queue.mid, self.queue.buckets, 0
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))  # start of the part to the left
        pair = [-1] * n  # rank of the part that starts here with the next
        for i in range(n - 1):
            new = rank_of(piece[i : i + 2])
            if new is not None:
                pair[i] = new
                if new in buckets:
                    buckets[new].append(i)  # ascending, so a heap
                else:
                    buckets[new] = [i]
                    a, b = new >> 6, new >> 12
                    low[a] |= 1 << (new & 63)
                    mid[b] |= 1 << (a & 63)
                    top |= 1 << b
        while top:
            # Find first set, level by level.
            b = (top & -top).bit_length() - 1
            x = mid[b]
            a = (b << 6) | ((x & -x).bit_length() - 1)
            x = low[a]
            rank = (a << 6) | ((x & -x).bit_length() - 1)
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                low[a] = x = x & (x - 1)
                if not x:
                    x = mid[b]
                    mid[b] = x = x & (x - 1)
                    if not x:
                        top &= top - 1
            if pair[i] != rank:
                continue  # stale: this pair is gone
            j = end[i]
            end[i] = stop = end[j]
            pair[j] = -1
            if stop < n:
                before[stop] = i
                right = rank_of(piece[i : end[stop]])
            else:
                right = None
            pair[i] = -1  # set again below if the new pair has a rank
            k = before[i]
            left = rank_of(piece[k:stop]) if k >= 0 else None
            if k >= 0 and left is None:
                pair[k] = -1
            for at, new in ((i, right), (k, left)):
                if new is not None and pair[at] != new:
                    pair[at] = new
                    if new in buckets:
                        heappush(buckets[new], at)
                    else:
                        buckets[new] = [at]
                        a, b = new >> 6, new >> 12
                        low[a] |= 1 << (new & 63)
                        mid[b] |= 1 << (a & 63)
                        top |= 1 << b
        out, i, ranks = [], 0, self.ranks
        while i < n:
            j = end[i]
            out.append(ranks[piece[i:j]])
            i = j
        return out

    def encode(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        return b"".join(map(self.packed.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, memoryview(packed).cast("I")))


class Remembered(dict):
    """Packed ids by pre-token, worked out when first asked for; the last two generations are kept."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = b"".join([i.to_bytes(4, "little") for i in self.encoder.merge(piece.encode())])
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


_encoders: dict[tuple, Encoder] = {}


def _encoder(shared, pattern: str) -> Encoder:
    """One encoder in each Python worker, so that tasks share what it remembers."""
    key = (hash(tuple(itertools.islice(shared.value.items(), 1000))), len(shared.value), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value, pattern)
    return _encoders[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids, decoded``.

    ``ids`` (binary) are the ids of the whole text as little-endian unsigned 32-bit
    integers: each match of ``pattern`` is encoded by itself, without special
    tokens.  ``decoded`` (binary) is what those ids stand for.  A null or empty
    text has no ids; a very long one, or a very long pre-token, takes time in proportion
    (times a logarithm).  Order, repeated rows and other columns do not matter; an
    empty table gives no rows.  No shuffle.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, pattern)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            low = 0
            while low < len(batch):
                first, packed, decoded, size = low, [], [], 0
                while low < len(batch) and size < EMIT_BYTES:
                    own = encoder.encode(texts[low].as_py() or "")
                    packed.append(own)
                    decoded.append(encoder.decode(own))
                    size += len(own) + len(decoded[-1])
                    low += 1
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, low - first), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    rows = docs.select(F.col(quoted(id_col)).cast("bigint").alias("doc_id"), F.col(quoted(text)).alias("_text"))
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
