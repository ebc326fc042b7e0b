"""A corpus pipeline: language ID, line dedup, near-dedup, source mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and
returns what it keeps, with the same columns but for the last one.  Texts may be null, empty or
very long, rows may repeat, ids may be null, tables may be empty; further columns pass through,
whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.llm import bloom, bpe, language_id, line_dedup, near_dedup, source_mix
from reelspan.llm.names import columns, fresh
from reelspan.llm.scratch import outlived, remove, written

#: The largest id.
MOST = (1 << 63) - 1


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the table has labels of, go (see ``language_id.keep_known``)."""
    return language_id.keep_known(docs)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines stay where they first stand; the documents stay, null texts null (see ``line_dedup.dedup_lines``)."""
    return line_dedup.dedup_lines(docs, names=tuple(fresh(docs, "n_lines", "n_removed"))).select(*columns(docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest id stays.

    Rows that share an id are decided together; those that share the text too become one.
    A row without an id is decided by a key from its text, greater than any id: it goes only
    if its group has another row, and of rows without an id that share the text one stays.
    Only where ids come so near to the largest BIGINT that keys collide, copies may stay.
    """
    top = min(max(docs.agg(F.max(F.col("doc_id").cast("bigint"))).first()[0] or 0, 0), MOST - 1)
    own_key = F.lit(top + 1) + F.pmod(F.xxhash64("text"), F.lit(MOST - top))
    key, kept, maybe = fresh(docs, "key", "kept", "maybe")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("bigint"), own_key))
    found = written(near_dedup.near_duplicates(keyed, id_col=key), "stage-near").withColumnRenamed("doc_id", key)
    by_id = found.groupBy(key).agg(F.max("kept").alias(kept), F.count(F.lit(1)).alias("n"))
    unsure = written(by_id.where(~F.col(kept) | (F.col("n") > 1)).select(key, kept), "stage-near-unsure")
    # Only rows that may go are shuffled; the others pass straight through.
    seen = bloom.build(unsure.select(F.xxhash64(key)), unsure.count())
    rows = keyed.withColumn(maybe, seen.maybe(F.xxhash64(key)))
    moved = rows.where(F.col(maybe)).drop(maybe).join(unsure, key, "left").where(F.coalesce(kept, F.lit(True)))
    own = columns(docs.columns)
    return rows.where(~F.col(maybe)).select(*own).unionByName(moved.dropDuplicates([key, "text"]).select(*own))


def in_training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights, a row each time a document is trained on, in order (see ``source_mix.sequence``)."""
    return source_mix.sequence(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` of every row; a null or empty text has no ids (see ``bpe.encode_documents``)."""
    encoded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", clean_lines),
    ("minhash_near_dedup", one_of_each),
    ("source_mix", in_training_order),
    ("byte_bpe", tokens),
]

#: Language ID and the mix's order of training are learned and hashed; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage wrote for itself, and what the stage before it left, goes when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = outlived(spark, lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")  # noqa: B023
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
