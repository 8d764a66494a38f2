"""Embedded tables as lines of key=value pairs: pipe tables, then tab-separated, then comma-separated ones.

Lines are parted by the line feed alone. Each pass finds islands of table lines with windows over a document and
hands the lines that are left to the next. A document is a row, whatever its id: rows are numbered before their lines are parted, so
repeated and null ids don't mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.text import plain_lines, strip

MIN_COLUMNS = MIN_ROWS = 2
RULE = r"^[-:]+$"


def _cells(line: Column, by: str) -> Column:
    return F.transform(F.split(line, by, -1), strip)


def render(header: Column, cells: Column, row: Column) -> Column:
    name = lambda i: F.concat(F.lit("Col"), (i + 1).cast("string"))
    pairs = F.transform(cells, lambda c, i: F.concat(F.coalesce(F.nullif(F.get(header, i), F.lit("")), name(i)), F.lit("="), c))
    return F.concat(F.lit("Row "), row.cast("string"), F.lit(": "), F.array_join(pairs, ", "))


def numbered(docs: DataFrame, id_col: str, column: str) -> DataFrame:
    """key (a number of the row), id, digest (of the text), n, line."""
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(column).alias("_text"))
    return rows.select("key", "id", F.md5("_text").alias("digest"), F.posexplode(plain_lines(F.col("_text"))).alias("n", "line"))


def _islands(rows: DataFrame, member: str) -> DataFrame:
    """island: a number that grows at every change of member in a document."""
    w = Window.partitionBy("key").orderBy("n")
    change = F.when(F.col(member) == F.lag(member, 1).over(w), 0).otherwise(1)
    return rows.withColumn("_change", change).withColumn("island", F.sum("_change").over(w)).drop("_change")


def _keep(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("line").isNotNull()).select("key", "id", "digest", "n", "line")


def pipe_pass(rows: DataFrame) -> DataFrame:
    """A block is a run of pipe rows, a blank line between two of them included; it is a table if it has two rows that are no rules. Rules and blanks of a table go."""
    w = Window.partitionBy("key").orderBy("n")
    s, parts = F.col("_s"), F.col("_parts")
    rows = rows.withColumn("_s", strip(F.col("line"))).withColumn("_parts", _cells(F.col("_s"), r"\|"))
    empty_at = F.array_position(parts, "") - 1
    filled = F.filter(parts, lambda p: p != "")
    cells = F.when((empty_at < 0) | empty_at.isin(0) | (empty_at == F.size(parts) - 1), filled).otherwise(parts)
    content = F.filter(cells, lambda p: (p != "") & ~p.rlike(RULE))
    all_rules = F.forall(filled, lambda p: p.rlike(RULE))
    has = F.contains(s, F.lit("|"))
    rows = rows.withColumns({"_pipe": has & ((F.size(content) >= MIN_COLUMNS) | ((F.size(cells) >= MIN_COLUMNS) & all_rules)), "_rule": has & all_rules & (F.size(filled) >= MIN_COLUMNS), "_blank": s == ""})
    between = F.col("_blank") & F.coalesce(F.lag("_pipe", 1).over(w), F.lit(False)) & F.coalesce(F.lead("_pipe", 1).over(w), F.lit(False))
    rows = _islands(rows.withColumn("_in", F.col("_pipe") | between), "_in")
    raw = F.split(s, r"\|", -1)
    raw = F.when((F.size(raw) > 1) & (strip(raw[0]) == ""), F.slice(raw, F.lit(2), F.size(raw) - 1)).otherwise(raw)
    rows = rows.withColumn("_raw", raw)
    r = F.col("_raw")
    trimmed = F.when((F.size(r) > 1) & (strip(F.element_at(r, -1)) == ""), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r)
    rows = rows.withColumn("_cells", F.transform(trimmed, strip)).withColumn("_row", F.col("_in") & F.col("_pipe") & ~F.col("_rule") & (F.size("_cells") >= MIN_COLUMNS))
    block = Window.partitionBy("key", "island")
    order = block.orderBy("n")
    rows = rows.withColumns({"_rows": F.count_if("_row").over(block), "_k": F.count_if("_row").over(order), "_header": F.first(F.when(F.col("_row"), F.col("_cells")), ignorenulls=True).over(order)})
    table = F.col("_in") & (F.col("_rows") >= MIN_ROWS)
    line = F.when(~table, F.col("line")).when(F.col("_row") & (F.col("_k") > 1), render(F.col("_header"), F.col("_cells"), F.col("_k") - 1))
    return _keep(rows.withColumn("line", line))


def delimited_pass(rows: DataFrame, by: str) -> DataFrame:
    """An island of delimited lines falls into runs of equal column count; the first run of two is the table, lines before it stay and lines after it are dropped; without one, all stay."""
    rows = rows.withColumn("_s", strip(F.col("line"))).withColumn("_cells", _cells(F.col("_s"), by))
    member = F.contains(F.col("_s"), F.lit(by)) & (F.size(F.filter("_cells", lambda c: c != "")) >= MIN_COLUMNS)
    if by == ",":  # what an earlier pass made is no table
        member = member & ~F.col("_s").rlike(r"(?U)^Row \d+:") & ~F.col("_s").rlike(r"(?U)\w+=\S+,\s*\w+=")
    rows = _islands(rows.withColumn("_in", member), "_in")
    island = Window.partitionBy("key", "island")
    order = island.orderBy("n")
    change = F.when(F.size("_cells") == F.lag(F.size("_cells"), 1).over(order), 0).otherwise(1)
    rows = rows.withColumn("_change", change).withColumn("_run", F.sum("_change").over(order))
    run = Window.partitionBy("key", "island", "_run")
    rows = rows.withColumns({"_length": F.count(F.lit(1)).over(run), "_k": F.row_number().over(run.orderBy("n")), "_header": F.first("_cells").over(run.orderBy("n"))})
    rows = rows.withColumn("_table", F.min(F.when(F.col("_in") & (F.col("_length") >= MIN_ROWS), F.col("_run"))).over(island))
    stays = ~F.col("_in") | F.col("_table").isNull() | (F.col("_run") < F.col("_table"))
    line = F.when(stays, F.col("line")).when((F.col("_run") == F.col("_table")) & (F.col("_k") > 1), render(F.col("_header"), F.col("_cells"), F.col("_k") - 1))
    return _keep(rows.withColumn("line", line))


def joined(rows: DataFrame) -> DataFrame:
    """id, digest, normalized: the lines of each document put together again."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return rows.groupBy("key").agg(F.first("id").alias("id"), F.first("digest").alias("digest"), F.array_join(lines, "\n").alias("normalized")).drop("key")


def tables_in(docs: DataFrame, id_col: str, column: str) -> DataFrame:
    """id, digest, normalized of documents with a |, tab or comma."""
    return joined(delimited_pass(delimited_pass(pipe_pass(numbered(docs.filter(F.col(column).rlike(r"[|\t,]")), id_col, column)), "\t"), ","))


def normalize(docs: DataFrame, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """id, normalized of every document with a text, a row each. Documents without any |, tab or comma pass by the windows."""
    plain = docs.filter(~F.col(column).rlike(r"[|\t,]")).select(F.col(id_col).alias("id"), F.col(column).alias("normalized"))
    return tables_in(docs, id_col, column).drop("digest").unionByName(plain)


def with_normalized(docs: DataFrame, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """docs and normalized, also where ids repeat or are null: rows of equal id and text have equal tables, and are told apart from others by a digest of the text."""
    found = tables_in(docs, id_col, column).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("normalized").alias("_normalized")).dropDuplicates(["_id", "_digest"])
    both = docs.join(found, F.col(id_col).eqNullSafe(F.col("_id")) & (F.md5(F.col(column)) == F.col("_digest")), "left")
    return both.withColumn("normalized", F.when(F.col("_digest").isNotNull(), F.col("_normalized")).otherwise(F.col(column))).drop("_id", "_digest", "_normalized")
