"""The cleaning flow: tables, lexicon by target, redaction, record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions import redact
from textquarry.operators import lexicon, tables


def clean(docs: DataFrame, id_col: str = "doc_id", column: str = "text", normalize: bool = False, mapping: dict[str, str] | None = None, target: str = "input") -> DataFrame:
    """id, redacted, normalized (null unless asked for). Tables are found in the text as it is; the mapping goes to the input, the normalized text or both; personal data is redacted in both last."""
    out = docs.select(F.col(id_col).alias("id"), F.col(column).alias("redacted"))
    if normalize:
        out = tables.with_normalized(out, "id", "redacted")
    else:
        out = out.withColumn("normalized", F.lit(None).cast("string"))
    if mapping:
        if target in ("input", "both"):
            out = out.withColumn("redacted", lexicon.inject(F.col("redacted"), mapping))
        if target in ("normalized", "both"):
            out = out.withColumn("normalized", lexicon.inject(F.col("normalized"), mapping))
    return out.withColumns({"redacted": redact.redact_pii(F.col("redacted")), "normalized": redact.redact_pii(F.col("normalized"))})


def shown(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("id", F.coalesce("normalized", "redacted").alias("text"))
