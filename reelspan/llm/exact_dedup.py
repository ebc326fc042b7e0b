"""Exact dedup by two passes over a Bloom filter.

Pass one puts a 64-bit hash of every text into a filter that remembers which
positions were set more than once.  In pass two a row whose hash was certainly
seen once passes straight through; only the others are shuffled, and only by
digest and id, never with their text.

A filter has a fixed size, and full it would let nothing pass.  So the hashes are cut into as
many ranges as their number asks for, and the two passes are made for one range after the other, over
digests that were written in the order of their hashes within each task: a round reads its own stretch of each file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm import bloom
from reelspan.llm.hot import looked_up
from reelspan.llm.names import quoted
from reelspan.llm.scratch import written


def rounds_for(rows: int, max_bits: int) -> int:
    """Filters of ``max_bits`` that so many rows ask for."""
    return max(1, -(-bloom.BITS_PER_KEY * rows // max_bits))


def marked(digests: DataFrame, rows: int, max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """``digests`` with ``_maybe``: false if its hash ``_h`` certainly has one row."""
    n = rounds_for(rows, max_bits)
    if n == 1:
        seen_again = bloom.build(digests.select("_h"), rows, repeated=True, max_bits=max_bits)
        return written(digests.withColumn("_maybe", seen_again.maybe("_h")), "exact-marked")
    width, least, out = (1 << 64) // n + 1, -(1 << 63), None
    for k in range(n):
        low, high = least + k * width, min(least + (k + 1) * width, 1 << 63) - 1
        part = digests.where(F.col("_h").between(F.lit(low).cast("bigint"), F.lit(high).cast("bigint")))
        seen_again = bloom.build(part.select("_h"), rows // n, repeated=True, max_bits=max_bits)
        found = written(part.withColumn("_maybe", seen_again.maybe("_h")), "exact-marked")
        seen_again.shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def exact_duplicates(docs: DataFrame, text: str | Column = "text", id_col: str = "doc_id", max_bits: int = bloom.MAX_BITS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical (null counts as empty).  Of equal
    texts the row with the largest id stays; null ids are smaller than all
    others.  Of several rows with the winning id and text exactly one is kept.  Every row
    stays a row of its own throughout: a text that very many rows share, with or without an id, is looked up by broadcast where
    its rows are.  Very long texts are hashed whole; only digests move.  An empty table gives no rows; other columns of
    ``docs`` are not read.  ``max_bits``: of a filter; more rows than it serves take several rounds.
    """
    value = F.coalesce(F.col(quoted(text)) if isinstance(text, str) else text, F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), value.alias("_text"))
    n = docs.count()
    digests = rows.select("doc_id", F.sha2("_text", 256).alias("text_sha256"), F.xxhash64("_text").alias("_h"), F.monotonically_increasing_id().alias("_row"))
    # In order of hash only where rounds will read ranges of it.
    digests = written(digests.sortWithinPartitions("_h") if rounds_for(n, max_bits) > 1 else digests, "exact-digests")
    known = marked(digests, n, max_bits).drop("_h")
    single = known.where(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    some = known.where("_maybe").drop("_maybe")
    # The winner is one row: of those with the largest id the first that was written.
    top = F.max(F.struct("doc_id", (-F.col("_row")).alias("row"))).alias("_top")
    groups = written(some.groupBy("text_sha256").agg(top, F.count(F.lit(1)).alias("group_size")), "exact-groups")
    found = looked_up(some, groups.withColumn("_n", F.col("group_size")), ["text_sha256"], "_n", n)
    return single.unionByName(found.select("doc_id", F.col("_top.doc_id").alias("keep_id"), "group_size", (F.col("_top.row") == -F.col("_row")).alias("kept"), "text_sha256"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
