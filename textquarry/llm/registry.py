"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textquarry.llm import byte_bpe, exact_dedup, fingerprints, language_model, near_dedup, packing, pii, token_counts, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_pii": pii.op2_pii,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_language_model": language_model.op5_language_model,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_byte_bpe": byte_bpe.op7_byte_bpe,
        "op8_warc": warc.op8_warc,
        "op9_fingerprints": fingerprints.op9_fingerprints,
        "op10_token_counts": token_counts.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.ORACLE_SQL, "op8_warc": warc.ORACLE_SQL}
