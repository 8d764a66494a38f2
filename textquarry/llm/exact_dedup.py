"""Exact deduplication with a persistent digest index, in DataFrame operations only.

The index is a table bucketed and sorted by digest with one row per distinct text. A batch is reduced to
one row per digest (partial aggregation first, so a hot digest costs one row a task), what the index
already has goes by a sort-merge anti-join on the bucketing (the index side moves nothing), and the rest
is appended.

Defined cases: a null text is the empty text; a text of white space equals the empty one; of equal texts
the row with the most code points in the original stays, then the smallest doc_id (a null doc_id after
all others); rows that repeat both stay or go by the one that was numbered first; an empty table
gives an empty result; other columns, of any name and type, are ignored, and kept by keep_first().
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import table, without, written

#: Deleted before texts are compared.
WHITE = " \t\n\x0b\x0c\r"
BUCKETS = 64


def normal_digest(text: Column) -> Column:
    return F.sha2(F.translate(text, WHITE, "").cast("binary"), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars of the original, digest and row (a number of the row), one per input row."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.char_length(text).alias("n_chars"), normal_digest(text).alias("digest"), F.monotonically_increasing_id().alias("row"))


class DigestIndex:
    """A persistent index under a table name: digest -> keep_id, keep_row, group_size, and the batch that brought it."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = spark, name, buckets

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name)

    def add(self, groups: DataFrame, batch: str) -> DataFrame:
        """Appends the digests that the index lacks (a sort-merge anti-join on the index's own buckets), marked with the batch; returns the index's rows for all of the batch's digests, written.

        A batch that was cut off can be added again under its own name: what it had appended counts as its own.
        """
        groups = groups.withColumn("batch", F.lit(batch))
        if not self.exists():
            self.append(groups.limit(0))
        self.append(groups.join(self.entries().select("digest").hint("merge"), "digest", "left_anti"))
        return written(self.entries().join(groups.select("digest").hint("merge"), "digest", "left_semi"), "known")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def groups(batch: DataFrame) -> DataFrame:
    """One row per digest; first by code points, then doc_id, then row."""
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    return batch.groupBy("digest").agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "group_size")


def indexed(docs: DataFrame, index: DigestIndex, batch: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The digests of docs, and the index's rows for them, after those that it lacked were added."""
    rows = written(digests(docs, id_col, text_col), "digests")
    return rows, index.add(written(groups(rows), "groups"), batch)


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; a text that the index had before is not kept and names the indexed row.

    The last join has both sides shuffled by digest and nothing above that needs them together, so adaptive execution can split a hot digest.
    """
    batch = batch or uuid.uuid4().hex
    rows, known = indexed(docs, index, batch, id_col, text_col)
    found = rows.join(known, "digest")
    kept = (F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))
    return found.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The documents that stay, with all their columns. A doc_id may name several rows: its rows are told apart by digest, and of rows equal in both the one with the most code points stays, then the first.

    Rows meet what stays by their numbers, and keys by id and digest, so a hot digest is never one task's.
    """
    batch = batch or uuid.uuid4().hex
    rows, known = indexed(docs, index, batch)
    stays = known.filter(F.col("batch") == batch)
    gone = rows.join(stays.select(F.col("keep_row").alias("row")), "row", "left_anti").select(F.col("doc_id").alias("id"), "digest").distinct()
    kept = stays.select(F.col("keep_id").alias("of"), F.col("digest").alias("mark"), F.lit(True).alias("some"))
    met = gone.join(kept, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("mark")), "left")
    doubtful = written(met.select("id", "digest", F.coalesce("some", F.lit(False)).alias("some")), "doubtful")
    return without(docs, doubtful, lambda rows: rows.select("row", "id", normal_digest(F.col("text")).alias("digest"), F.char_length("text").alias("n")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    try:
        return written(deduplicate(table(spark, sf_dir, "documents"), index), "op4")
    finally:
        index.drop()


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), k AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS r, count(*) OVER (PARTITION BY h) AS group_size FROM d
)
SELECT k.doc_id, f.doc_id AS keep_id, k.group_size, k.r = 1 AS kept, k.h AS text_sha256 FROM k JOIN k AS f ON f.h = k.h AND f.r = 1
"""
