"""Evidence tables: manifests, checksum joins, orphans, drift, links, lints of records and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import iso_seconds, sort_time, truncated


def manifest(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, sha256, bytes of each distinct path, by path; of rows of one path the one with the smallest hash."""
    rows = files.select(F.col(path).alias("path"), F.struct(F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.octet_length(content).alias("bytes")).alias("f"))
    return rows.groupBy("path").agg(F.min("f").alias("f")).select("path", "f.sha256", "f.bytes").orderBy("path")


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def parse_sidecar(text: Column) -> Column:
    """A checksum file's line, "<64 hex>  <path>": struct<sha256,path>, null if it is none."""
    line = F.split(text, "\n", 2)[0]
    parts = F.split(line, "  ", 2)
    return F.when(line.rlike("^[0-9a-f]{64}  ."), F.struct(parts[0].alias("sha256"), F.trim(F.get(parts, F.lit(1))).alias("path")))


def integrity(items: DataFrame, sidecars: DataFrame) -> DataFrame:
    """items: path, sha256. sidecars: target (path of the item it stands for), sha256, stored_path. One row per item with a status: ok, missing, mismatch, wrong_path."""
    s = sidecars.select(F.col("target").alias("path"), F.col("sha256").alias("stored"), "stored_path")
    base = F.regexp_extract("path", "[^/]+$", 0)
    status = F.when(F.col("stored").isNull(), "missing").when(F.col("stored") != F.col("sha256"), "mismatch").when(~F.col("stored_path").isin("") & (F.col("stored_path") != F.col("path")) & (F.col("stored_path") != base), "wrong_path").otherwise("ok")
    return items.join(s, "path", "left").select("path", "sha256", status.alias("status"))


def orphans(items: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Keys of items that nothing refers to."""
    return items.select(key).distinct().join(references.select(key).distinct(), key, "left_anti")


def dangling(references: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """References whose item isn't there."""
    return references.join(items.select(key).distinct(), key, "left_anti")


def missing_targets(sidecars: DataFrame, items: DataFrame) -> DataFrame:
    """sidecars: sidecar_path, target (as its line names it). items: path. Checksums whose target is neither there nor, by its last part, in the sidecar's own folder."""
    known = items.select(F.col("path").alias("target")).distinct()
    beside = F.concat(F.regexp_extract("sidecar_path", "^(.*/)?", 0), F.regexp_extract("target", "[^/]*$", 0))
    rest = sidecars.join(known, "target", "left_anti").withColumn("_beside", beside)
    return rest.join(known.withColumnRenamed("target", "_beside"), "_beside", "left_anti").drop("_beside")


#: The columns of a log of validated claims.
LOG_COLUMNS = ["Date (UTC)", "Claim", "Status", "Confidence", "Source", "Receipt"]


def log_header(title: str = "Validation Log", about: str = "This log tracks validated claims with immutable evidence receipts.", columns: list[str] = LOG_COLUMNS) -> str:
    """The beginning of a log: a heading, a sentence, and a table without rows."""
    return f"# {title}\n\n{about}\n\n| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"


def _is_rule(line: Column) -> Column:
    return F.startswith(F.trim(line), F.lit("|")) & F.contains(line, F.lit("---"))


def _parsed(lines: DataFrame, columns: int) -> DataFrame:
    """lines: id, line, text."""
    rows = lines.filter(F.startswith(F.trim("text"), F.lit("|")) & ~_is_rule(F.col("text")))
    cells = F.transform(F.split(F.regexp_replace(F.trim("text"), r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c))
    rows = rows.withColumn("cells", cells).filter(F.size("cells") == columns)
    kind = F.when(F.col("cells")[0].rlike(r"^VL-\d{8}-\d+"), "legacy").when(F.col("cells")[0].rlike(r"^\d{4}-\d{2}-\d{2}"), "standard")
    receipt = F.when(F.col("kind") == "standard", F.nullif(F.regexp_extract(F.element_at("cells", -1), r"`([^`]+)`", 1), F.lit("")))
    return rows.withColumn("kind", kind).filter("kind IS NOT NULL").select("id", "line", "kind", receipt.alias("receipt"))


def log_rows(docs: DataFrame, id_col: str = "doc_id", column: str = "text", columns: int = len(LOG_COLUMNS)) -> DataFrame:
    """id, line (from 1), kind, receipt of the rows of log tables: legacy by a first cell like VL-20240131-1, standard by a date; other rows, and those before the first rule of dashes, are none. receipt: the path in back quotes of a standard row's last cell, null if it has none."""
    lines = F.split(F.col(column), "\n", -1)
    begins = F.array_position(F.transform(lines, _is_rule), F.lit(True)).cast("int")
    # The rule is found once a text, inside the generator: as a column beside it, Spark would copy the text to each of its lines and split it there again.
    after = F.slice(F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text"))), begins + 1, F.size(lines))
    return _parsed(docs.select(F.col(id_col).alias("id"), F.inline(F.when(begins > 0, after))), columns)


def log_line_rows(lines: DataFrame, id_col: str = "doc_id", line: str = "line", column: str = "text", columns: int = len(LOG_COLUMNS)) -> DataFrame:
    """As log_rows(), of logs that are there by lines (numbered from 1 in each log), so that a log may be larger than a task's memory. Lines without an id are one log."""
    lines = lines.select(F.col(id_col).alias("id"), F.col(line).alias("line"), F.col(column).alias("text"))
    begins = lines.filter(_is_rule(F.col("text"))).groupBy("id").agg(F.min("line").alias("rule"))
    return _parsed(lines, columns).alias("l").join(begins.alias("b"), F.col("l.id").eqNullSafe(F.col("b.id")) & (F.col("line") > F.col("rule"))).select("l.id", "line", "kind", "receipt")


def with_receipt_errors(rows: DataFrame, receipts: DataFrame, prefix: str, suffix: str = ".canonical.json") -> DataFrame:
    """rows as log_rows() gives them, and error, null for other rows than standard ones and where nothing is wrong. receipts: path. Errors: no receipt, another folder or ending than the two, or a receipt that isn't there; the first that holds."""
    known = receipts.select(F.col("path").alias("_key"), F.lit(True).alias("_there")).distinct()
    error = F.when(F.col("receipt").isNull(), "no receipt").when(~F.startswith("receipt", F.lit(prefix)), "another folder").when(~F.endswith("receipt", F.lit(suffix)), "another ending")
    # Rows that aren't looked up get keys of their own: by a null they would all meet in one task.
    asked = rows.withColumn("error", F.when(F.col("kind") == "standard", F.coalesce(error, F.lit("not found"))))
    asked = asked.withColumn("_key", F.when(F.col("error") == "not found", F.col("receipt")).otherwise(F.concat_ws(":", F.col("id").cast("string"), F.col("line").cast("string"))))
    return asked.join(known, "_key", "left").withColumn("error", F.when((F.col("error") != "not found") | F.col("_there").isNull(), F.col("error"))).select("id", "line", "kind", "receipt", "error")


def receipt_errors(rows: DataFrame, receipts: DataFrame, prefix: str, suffix: str = ".canonical.json") -> DataFrame:
    """id, line, error of the rows where with_receipt_errors() finds something wrong."""
    return with_receipt_errors(rows, receipts, prefix, suffix).filter("error IS NOT NULL").select("id", "line", "error")


def newest_decisions(docs: DataFrame, n: int = 10, path: str = "path", column: str = "text") -> DataFrame:
    """path, title, status, receipt of the n decision records that are last by path; null where a record has none."""
    found = lambda p: F.nullif(F.regexp_extract(column, p, 1), F.lit(""))
    records = docs.filter(F.regexp_extract(path, "[^/]*$", 0).rlike(r"^ADR-.*\.md$"))
    return records.orderBy(F.desc(path)).limit(n).select(F.col(path).alias("path"), found(r"(?m)^# .+?: (.+)$").alias("title"), found(r"\*\*Status\*\*:\s*(\w+)").alias("status"), found(r"`([^`]+\.canonical\.json)`").alias("receipt"))


def drift(left: DataFrame, right: DataFrame, key: str = "path", content: str = "sha256") -> DataFrame:
    """key, status of what differs: only_left, only_right, changed."""
    a, b = left.select(key, F.col(content).alias("a"), F.lit(True).alias("in_a")), right.select(key, F.col(content).alias("b"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "only_left").when(F.col("in_a").isNull(), "only_right").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).filter("status IS NOT NULL")


def kind_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/decisions/")), "decision").when(F.contains(path, F.lit("/prs/")), "pr").when(F.contains(path, F.lit("/validation/")), "validation").otherwise("unknown")


def item_id(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "[^/]+$", 0), r"\.canonical\.json$", "")


def index(items: DataFrame) -> DataFrame:
    """items: canonical_path, sha256, sha256_path, timestamp_utc, source_ref. Rows of an evidence index by kind, id and path, with the time that they sort by."""
    out = items.select("canonical_path", item_id(F.col("canonical_path")).alias("id"), kind_of(F.col("canonical_path")).alias("kind"), "sha256", "sha256_path", sort_time(F.col("timestamp_utc")).alias("sort_timestamp_utc"), iso_seconds(F.col("timestamp_utc")).alias("timestamp_utc"), F.nullif(F.coalesce("source_ref", F.lit("")), F.lit("")).alias("source_ref"))
    return out.orderBy("kind", "id", "canonical_path")


def counts_by_kind(indexed: DataFrame) -> DataFrame:
    return indexed.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy("kind")


def reference_count(docs: DataFrame, pattern: str, column: str = "text") -> DataFrame:
    """docs and references, and status: one, missing or multiple."""
    n = F.regexp_count(column, F.lit(pattern))
    return docs.withColumn("references", n).withColumn("status", F.when(F.col("references") == 0, "missing").when(F.col("references") > 1, "multiple").otherwise("one"))


def pipe_rows(docs: DataFrame, columns: int, id_col: str = "doc_id", column: str = "text") -> DataFrame:
    """Rows of Markdown tables with so many cells, rules left out: id, n, cells."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(column), "\n", -1)).alias("n", "line")).filter(F.trim("line").rlike(r"^\|.*\|$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|", -1), lambda c: F.trim(c))
    return lines.select("id", "n", cells.alias("cells")).filter((F.size("cells") == columns) & ~F.forall("cells", lambda c: c.rlike("^:?-+:?$")))


def newest(rows: DataFrame, by: str, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc(by)).limit(n)


def last_rows(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The last n rows, in their own order."""
    return rows.orderBy(F.desc(by)).limit(n).orderBy(by)


def log_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[truncated(F.regexp_replace(c, r"[\n|]", " ")) for c in cells]), F.lit(" |"))


def append_new(log: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """log and those rows whose key it lacks; one row of each new key."""
    return log.unionByName(rows.join(log.select(key), key, "left_anti").dropDuplicates([key]))


def errors(checks: list[tuple[Column, str]]) -> Column:
    """Messages of the conditions that hold."""
    return F.filter(F.array(*[F.when(bad, F.lit(message)) for bad, message in checks]), lambda m: m.isNotNull())


def front_matter_errors(text: Column) -> Column:
    """A text has to begin with a front matter that is closed and has a name and a description."""
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    opened = F.startswith(text, F.lit("---"))
    return errors([(~opened, "no front matter"), (opened & (head == ""), "front matter isn't closed"), (opened & (head != "") & ~head.rlike(r"(?m)^name:\s*\S"), "no name"), (opened & (head != "") & ~head.rlike(r"(?m)^description:\s*\S"), "no description")])


def section_errors(text: Column, headings: list[str]) -> Column:
    return errors([(~text.rlike(r"(?m)^#+\s+\Q" + h + r"\E\s*$"), f"no section {h}") for h in headings])


def json_valid(text: Column) -> Column:
    """Whether a text is one JSON value. The parser stops after a first value, so the text is tried inside an array and inside an object: what follows a value breaks one of them."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull() & (F.trim(text) != "")


def record_errors(text: Column) -> Column:
    """Lints of a cleaned record (schema version 1) as a JSON line."""
    g = lambda p: F.get_json_object(text, p)
    return errors([(~json_valid(text), "no JSON"), (g("$.meta") .isNull(), "no meta"), (~g("$.meta.schema_version").eqNullSafe(F.lit("1")), "schema_version isn't 1"), (~F.coalesce(g("$.meta.input_type"), F.lit("")).isin("text", "pdf"), "unknown input_type"), (g("$.redacted").isNull(), "no redacted text")])


# Markdown that isn't allowed, assignments that look like secrets, words of placeholders.
DISALLOWED = [("private key begin", r"(?i)-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----"), ("private key end", r"(?i)-----END\s+(RSA\s+)?PRIVATE\s+KEY-----"), ("aws secret", "(?i)AWS_SECRET_ACCESS_KEY"), ("password", r"(?i)password\s*="), ("password (upper)", r"(?i)PASSWORD\s*=")]
SECRETS = [("API_KEY", r"""(?i)API_KEY\s*=\s*["'][^"']+["']"""), ("SECRET", r"""(?i)SECRET\s*=\s*["'][^"']+["']"""), ("PASSWORD", r"""(?i)PASSWORD\s*=\s*["'][^"']+["']"""), ("TOKEN", r"""(?i)TOKEN\s*=\s*["'][^"']+["']"""), ("PRIVATE_KEY", r"(?i)-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----")]
PLACEHOLDERS = r"example|placeholder|your_|xxx|todo|<"
# End of fixed values.


def disallowed(docs: DataFrame, column: str = "text") -> DataFrame:
    """A row per document and disallowed pattern that it has: rule."""
    rules = F.filter(F.array(*[F.when(F.col(column).rlike(p), F.lit(n)) for n, p in DISALLOWED]), lambda r: r.isNotNull())
    return docs.withColumn("rule", F.explode(rules)).drop(column)


def secret_assignments(docs: DataFrame, column: str = "text") -> DataFrame:
    """A row per match of a secret rule, matches with a placeholder's word left out: rule, hit."""
    found = [_hits(column, n, p) for n, p in SECRETS]
    return docs.withColumn("_x", F.explode(F.concat(*found))).filter(~F.lower("_x.hit").rlike(PLACEHOLDERS)).withColumns({"rule": F.col("_x.rule"), "hit": F.col("_x.hit")}).drop("_x", column)


def _hits(column: str, name: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), lambda h: F.struct(F.lit(name).alias("rule"), h.alias("hit")))
