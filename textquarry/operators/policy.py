"""Policy scan: rules over the lines of texts, findings with samples, thresholds and result reports."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import redact, spans, text

# Severities from the gravest, their report levels, and the built-in pack.
SEVERITIES = ("critical", "high", "medium", "low", "info")
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
LEVEL_ORDER = ("error", "warning", "note")


class Policy(NamedTuple):
    id: str
    title: str
    severity: str
    type: str
    pattern: str
    description: str
    sample_limit: int = 3


PII_PACK = [
    Policy("PII001", "Email Address Pattern", "medium", "regex", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "Detect potential PII email addresses.", 3),
    Policy("PII002", "US Phone Number Pattern", "medium", "regex", r"\b(?:\+1[-.]?)?\(?[0-9]{3}\)?[-.]?[0-9]{3}[-.]?[0-9]{4}\b", "Detect US phone number patterns (with or without country code).", 3),
    Policy("PII003", "US Social Security Number", "high", "regex", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "Detect US Social Security Number patterns (XXX-XX-XXXX format).", 2),
    Policy("PII004", "Credit Card Number Pattern", "high", "regex", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13})\b", "Detect credit card number patterns (Visa, Mastercard, Amex).", 2),
]
# End of fixed values.

#: Our own pack of secret rules.
SECRETS_PACK = [
    Policy("SEC001", "AWS Access Key", "critical", "regex", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "Detect AWS access key identifiers.", 3),
    Policy("SEC002", "Private Key Marker", "critical", "contains", "PRIVATE KEY-----", "Detect private key blocks.", 2),
    Policy("SEC003", "JSON Web Token", "high", "regex", r"\beyJ[A-Za-z0-9_-]{3,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}", "Detect JSON web tokens.", 3),
    Policy("SEC004", "Bearer Token", "high", "regex", r"\bBearer [A-Za-z0-9._-]{16,}", "Detect bearer tokens.", 3),
]
PACKS = {"pii.v1": PII_PACK, "secrets.v1": SECRETS_PACK}


def rank(severity: Column) -> Column:
    """0 for the gravest; 999 for what is no severity."""
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
    return F.when(at > 0, at - 1).otherwise(999).cast("int")


def meets(severity: Column, threshold: str) -> Column:
    limit = SEVERITIES.index(threshold) if threshold in SEVERITIES else 999
    return rank(severity) <= limit


def lines(docs: DataFrame, file: str = "doc_id", column: str = "text") -> DataFrame:
    """file, line (from 1), content."""
    return docs.select(F.col(file).alias("file"), F.posexplode(text.universal_lines(F.col(column))).alias("line", "content")).withColumn("line", F.col("line") + 1)


def hits(line_rows: DataFrame, policies: list[Policy]) -> DataFrame:
    """policy_id, file, line, col_start, col_end, content: every span of every policy. Policies are literals of one projection, so no pattern is compiled twice and lines never meet policies in a join."""
    line_rows = line_rows.filter(_any_hit(F.col("content"), policies))
    found = [F.struct(F.lit(p.id).alias("policy_id"), (spans.spans if p.type == "regex" else spans.overlapping)(F.col("content"), p.pattern).alias("spans")) for p in policies]
    rows = line_rows.select("file", "line", "content", F.explode(F.array(*found)).alias("x")).filter(F.size("x.spans") > 0)
    return rows.select("x.policy_id", "file", "line", "content", F.explode("x.spans").alias("s")).select("policy_id", "file", "line", "s.col_start", "s.col_end", "content")


def _any_hit(content: Column, policies: list[Policy]) -> Column:
    tests = [content.rlike(p.pattern) if p.type == "regex" else F.contains(content, F.lit(p.pattern)) for p in policies]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def counts(line_rows: DataFrame, policies: list[Policy], overlapping: bool = True) -> DataFrame:
    """policy_id, match_count, files. overlapping: literals as often as they begin (a scan of many files); else without overlap (of one file)."""
    found = []
    for p in policies:
        n = F.regexp_count("content", F.lit(p.pattern)) if p.type == "regex" else F.size(spans.overlapping(F.col("content"), p.pattern)) if overlapping else spans.count_literal(F.col("content"), p.pattern)
        found.append(F.struct(F.lit(p.id).alias("policy_id"), n.alias("n")))
    rows = line_rows.filter(_any_hit(F.col("content"), policies)).select("file", F.explode(F.array(*found)).alias("x")).filter("x.n > 0")
    return rows.groupBy("x.policy_id").agg(F.sum("x.n").alias("match_count"), F.count_distinct("file").alias("files"))


def samples(hit_rows: DataFrame, policies: list[Policy], redacted: bool = True) -> DataFrame:
    """The first sample_limit hits of each policy by file, line and column, with excerpts. Ranks are limited within tasks before anything moves."""
    limits = F.create_map(*[F.lit(x) for p in policies for x in (p.id, p.sample_limit)])
    most = max(p.sample_limit for p in policies)
    order = Window.partitionBy("policy_id").orderBy("file", "line", "col_start")
    top = hit_rows.withColumn("sample", F.row_number().over(order)).filter(F.col("sample") <= most).filter(F.col("sample") <= limits[F.col("policy_id")])
    cut = spans.excerpt(F.col("content"), F.col("col_start"), F.col("col_end"))
    return top.withColumn("excerpt", redact.redact_policy(cut) if redacted else cut).drop("content")


def table_of(spark, policies: list[Policy]) -> DataFrame:
    return spark.createDataFrame([(p.id, p.title, p.severity, p.description) for p in policies], "policy_id string, title string, severity string, description string")


def findings(docs: DataFrame, policies: list[Policy], overlapping: bool = True, redacted: bool = True, max_findings: int | None = None) -> DataFrame:
    """One row per policy that hit, by severity and id: policy_id, title, severity, severity_rank, description, match_count, files, samples."""
    rows = lines(docs)
    shown = samples(hits(rows, policies), policies, redacted)
    shown = shown.groupBy("policy_id").agg(F.array_sort(F.collect_list(F.struct("file", "line", "col_start", "col_end", "excerpt"))).alias("samples"))
    known = F.broadcast(table_of(docs.sparkSession, policies))  # as many rows as policies
    out = counts(rows, policies, overlapping).join(shown, "policy_id").join(known, "policy_id").withColumn("severity_rank", rank(F.col("severity")))
    out = out.select("policy_id", "title", "severity", "severity_rank", "description", "match_count", "files", "samples").orderBy("severity_rank", "policy_id", F.get("samples", F.lit(0))["file"])
    return out if max_findings is None else out.limit(max_findings)


def severity_counts(found: DataFrame) -> DataFrame:
    """One row: a count for each severity, zeros included."""
    return found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def violations(found: DataFrame, threshold: str) -> DataFrame:
    """One row: how many findings reach the threshold, and their ids in order."""
    hit = F.when(meets(F.col("severity"), threshold), F.struct("severity_rank", "policy_id"))
    return found.agg(F.count(hit).alias("violations"), F.transform(F.array_sort(F.collect_list(hit)), lambda s: s["policy_id"]).alias("policy_ids"))


# Exit codes.
EXIT_OK, EXIT_ERROR, EXIT_USAGE, EXIT_VIOLATION = 0, 1, 2, 3


def exit_code(count: int, exit_zero: bool = False) -> int:
    return EXIT_VIOLATION if count and not exit_zero else EXIT_OK


def report_results(found: DataFrame) -> DataFrame:
    """Findings as results of a static-analysis report: rule_id, level, message, locations (by file, line, column), severity, description, match_count, excerpt_redacted; by level, rule and first location."""
    levels = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    order = F.create_map(*[F.lit(x) for k, v in enumerate(LEVEL_ORDER) for x in (v, k)])
    locations = F.transform(F.array_sort("samples"), lambda s: F.struct(s["file"].alias("file"), s["line"].alias("line"), s["col_start"].alias("col_start"), s["col_end"].alias("col_end")))
    redacted = F.exists("samples", lambda s: F.contains(s["excerpt"], F.lit("[REDACTED")))
    out = found.select(F.col("policy_id").alias("rule_id"), F.coalesce(levels[F.col("severity")], F.lit("note")).alias("level"), F.col("title").alias("message"), locations.alias("locations"), "severity", "description", "match_count", redacted.alias("excerpt_redacted"))
    return out.orderBy(order[F.col("level")], "rule_id", F.get("locations", F.lit(0)))


def validate(policies: list[dict]) -> list[str]:
    """Errors of policies as they stand in a file; empty if they can be used."""
    import re

    errors, seen = [], set()
    for k, p in enumerate(policies):
        missing = [f for f in ("id", "title", "severity", "type", "description") if not isinstance(p.get(f), str) or not p[f]]
        errors += [f"policy {k}: {f} is missing or empty" for f in missing]
        if p.get("severity") not in SEVERITIES:
            errors.append(f"policy {k}: severity {p.get('severity')!r} is none of {', '.join(SEVERITIES)}")
        if p.get("type") == "regex":
            try:
                if re.compile(p["pattern"]).match("") and re.compile(p["pattern"]).fullmatch(""):
                    errors.append(f"policy {k}: pattern matches the empty text")
            except (KeyError, TypeError, re.error) as e:
                errors.append(f"policy {k}: pattern: {e}")
        elif p.get("type") == "contains":
            if not p.get("needle"):
                errors.append(f"policy {k}: needle is missing or empty")
        else:
            errors.append(f"policy {k}: type {p.get('type')!r} is neither regex nor contains")
        limit = p.get("sample_limit", 3)
        if not isinstance(limit, int) or isinstance(limit, bool) or limit < 1:
            errors.append(f"policy {k}: sample_limit is no whole number above 0")
        if p.get("id") in seen:
            errors.append(f"policy {k}: id {p['id']} occurs twice")
        seen.add(p.get("id"))
    return errors


def skip_summary(skipped: DataFrame) -> DataFrame:
    """skipped: path, reason. Reasons up to their colon, counted, most first."""
    return skipped.groupBy(F.regexp_extract("reason", "^[^:]+", 0).alias("reason")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "reason")
