"""Fill-in-middle documents, cut through a sparse exception index.

Cuts are given in code points, texts are UTF-8 bytes.  Of a batch's bytes only the
characters of several bytes are recorded: where each starts and how many bytes it has
beyond one.  Their running sum turns a byte position into a code point by one
subtraction, and ``searchsorted`` over the recorded characters turns a code point into a
byte position; the ASCII between them is arithmetic and is never walked or decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm.names import quoted
from reelspan.llm.scratch import bounded_batches

#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20
SHAPE = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, prefix_bytes bigint, middle_bytes bigint, output string"

#: Bytes beyond one of a character, by its first byte.
_EXCESS = np.zeros(256, np.int64)
_EXCESS[0xC0:0xE0], _EXCESS[0xE0:0xF0], _EXCESS[0xF0:] = 1, 2, 3


class ExceptionIndex:
    """Characters of several bytes in UTF-8 ``data``: ``bytes_at``, the places of their first bytes; ``chars_at``, the same in code points; ``before``, the excess bytes before each, and all at the end."""

    def __init__(self, data: np.ndarray):
        self.bytes_at = np.flatnonzero(data >= 0xC0)
        self.before = np.concatenate(([0], np.cumsum(_EXCESS[data[self.bytes_at]])))
        self.chars_at = self.bytes_at - self.before[:-1]

    def chars(self, at: np.ndarray) -> np.ndarray:
        """Code points before each byte position (the start of a character, or the end)."""
        return at - self.before[np.searchsorted(self.bytes_at, at)]

    def bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before each code point."""
        return at + self.before[np.searchsorted(self.chars_at, at)]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of texts without nulls, and where each text starts and the last one ends."""
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _cut(batches: Iterator[pa.RecordBatch], sentinels: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_id, _text, _form, _a, _b`` to the operator's rows; all of a batch's cuts are found at once."""
    p, s, m = (x.encode() for x in sentinels)
    for batch in batches:
        data, starts = _buffers(batch.column(1))
        first, last = int(starts[0]), int(starts[-1])
        own = data[first:last]
        index, starts = ExceptionIndex(own), starts - first
        chars = index.chars(starts)
        n = np.diff(chars)
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) % (n + 1) for k in (3, 4))
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        cut = np.stack([index.bytes(chars[:-1] + lo), index.bytes(chars[:-1] + hi)], 1).tolist()
        whole, ends, forms, out = own.tobytes(), starts.tolist(), batch.column(2).to_pylist(), []
        for k, form in enumerate(forms):
            x, (i, j), y = ends[k], cut[k], ends[k + 1]
            prefix, middle, suffix = whole[x:i], whole[i:j], whole[j:y]
            out.append(whole[x:y] if form == "plain" else p + prefix + s + suffix + m + middle if form == "psm" else s + suffix + p + prefix + m + middle)
        plain = pa.array([f == "plain" for f in forms], pa.bool_())
        at = np.array(cut, np.int64).reshape(-1, 2)
        given = lambda values: pa.array(values, pa.int64(), mask=plain.to_numpy(zero_copy_only=False))
        made = pa.array(out, pa.large_binary()).cast(pa.binary()) if sum(map(len, out)) < 1 << 31 else pa.array(out, pa.large_binary())
        kind = pa.string() if made.type == pa.binary() else pa.large_string()
        # The bytes are the input's own between sentinels: they are not decoded to be checked.
        texts = pa.Array.from_buffers(kind, len(made), made.buffers())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), batch.column(2), given(lo), given(hi - lo), given(at[:, 0] - starts[:-1]), given(at[:, 1] - at[:, 0]), texts],
            names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output"],
        )


def _holds(text: Column, sentinels: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for x in sentinels:
        found = found | F.contains(text, F.lit(x))
    return found


def fill_in_middle(docs: DataFrame, text: str = "text", id_col: str = "doc_id", seed: str = "1", sentinels: tuple[str, str, str] = SENTINELS, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output``.

    The first four groups of eight digits of the hex SHA-256 of ``seed:id`` decide: the first two,
    modulo n + 1 (``n``: code points), are the cuts; a third that is ``plain_from`` or more modulo 100 leaves the
    text as it is (form plain), as do an empty text and one that holds a sentinel; a fourth below
    ``spm_below`` modulo 100 puts the suffix first (spm), else the prefix comes first (psm).  The middle is always last.
    Lengths are null if plain.

    A null text counts as empty; a null id is hashed as nothing.  Rows that share an id are cut by the
    same numbers, each by its own length.  An empty table gives no rows; other columns are not read.
    No shuffle; a text takes some ten times its bytes in the task that has it, whatever its length.
    ``restored`` gives the texts back.
    """
    if any(not a or (j != k and a in b) or any(a.endswith(b[:n]) for n in range(1, len(b))) for j, a in enumerate(sentinels) for k, b in enumerate(sentinels)):
        raise ValueError("sentinels must differ, and none may hold another one or begin as one ends")
    bounded_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    part = lambda k: F.conv(F.substring("_hash", 8 * k + 1, 8), 16, 10).cast("bigint")
    rows = docs.select(F.col(quoted(id_col)).cast("bigint").alias("_id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("_text")).withColumn("_hash", digest)
    plain = (F.col("_text") == "") | (part(2) % 100 >= plain_from) | _holds(F.col("_text"), sentinels)
    asked = rows.select("_id", "_text", F.when(plain, "plain").when(part(3) % 100 < spm_below, "spm").otherwise("psm").alias("_form"), part(0).alias("_a"), part(1).alias("_b"))
    return asked.mapInArrow(lambda batches: _cut(batches, sentinels), SHAPE)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of ``fill_in_middle`` was made of: no part of it holds a sentinel, so it falls apart at them."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)))
    of = lambda *order: F.concat(*[F.element_at(parts, k) for k in order])
    return F.when(form == "psm", of(2, 4, 3)).when(form == "spm", of(3, 4, 2)).otherwise(output)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS x FROM documents),
g AS (SELECT *, [cast('0x' || x[8 * k + 1:8 * k + 8] AS BIGINT) FOR k IN [0, 1, 2, 3]] AS v FROM h),
c AS (SELECT *, least(v[1] % (n + 1), v[2] % (n + 1)) AS a, greatest(v[1] % (n + 1), v[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR v[3] % 100 >= 90 THEN 'plain' WHEN v[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
s AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM s
"""
