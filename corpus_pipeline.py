"""A corpus from raw documents to packed sequences: toxicity, exact copies, near copies, personal data, packing.

Each stage takes all that the one before kept, as a Parquet table. Labels of toxicity are learnt from rows whose
crc32(doc_id as text) mod 3 is not 1. Near copies go by five-word shingles and a similarity of 0.8.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import common, exact_dedup, near_dedup, packing, pii, toxicity
from textquarry.llm.common import crc_mod, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    return toxicity.keep_clean(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"pipeline_digests_{uuid.uuid4().hex}")
    try:
        return exact_dedup.keep_first(docs, index)  # which has read the index by then
    finally:
        index.drop()


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact_documents(docs, pii.fit(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies), ("pii", redact_personal_data), ("packing", pack_sequences)]

#: SQL can't express the stages that learn; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's tables go when its output is written, and the output when the next stage's is; the last one stays."""
    docs, before = table(spark, sf_dir, "documents"), common.mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.release(spark, before, common.newest())
    return docs
