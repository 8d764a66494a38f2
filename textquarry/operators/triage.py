"""Rule-based triage of incidents, and signals of free texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import redact
from textquarry.operators.logs import contains_any

SCHEMA = "id string, title string, description string, summary string, severity string, category string, type string, timestamp string, source string, affected_services array<string>, users_affected long, reporter string, tags array<string>"

# Severities, keywords in the order in which they are tried, flags, actions, fields, patterns.
EXPLICIT_SEVERITIES = ["critical", "high", "medium", "low"]
SEVERITY_KEYWORDS = {
    "critical": ["breach", "data leak", "unauthorized access", "ransomware", "down", "outage", "complete failure"],
    "high": ["degraded", "partial outage", "security vulnerability", "data loss", "timeout", "unresponsive"],
    "low": ["warning", "minor", "cosmetic", "informational"],
}
CATEGORY_KEYWORDS = {
    "security": ["breach", "unauthorized", "vulnerability", "exploit", "attack", "intrusion", "malware", "phishing"],
    "availability": ["down", "outage", "unavailable", "unreachable", "crash", "failure", "offline"],
    "performance": ["slow", "latency", "timeout", "degraded", "high cpu", "memory", "disk full"],
    "data_integrity": ["corrupt", "data loss", "inconsistent", "replication", "backup"],
    "configuration": ["misconfigur", "config", "setting", "permission", "access denied"],
}
CATEGORY_ACTIONS = {
    "security": [("Isolate affected systems", "Prevent further unauthorized access"), ("Preserve logs and evidence", "Enable forensic investigation"), ("Notify security team", "Activate incident response protocol")],
    "availability": [("Check service health dashboards", "Confirm scope of outage"), ("Review recent deployments", "Identify potential cause"), ("Initiate failover if available", "Restore service availability")],
    "performance": [("Check resource utilization", "Identify bottleneck"), ("Review recent traffic patterns", "Detect anomalies"), ("Scale resources if needed", "Address capacity issues")],
    "data_integrity": [("Stop affected write operations", "Prevent further corruption"), ("Verify backup integrity", "Ensure recovery option"), ("Identify affected data scope", "Assess impact")],
    "configuration": [("Review recent configuration changes", "Identify root cause"), ("Compare with known-good configuration", "Find discrepancies"), ("Prepare rollback plan", "Enable quick remediation")],
}
COMMUNICATION = ("Establish communication channel", "Coordinate response team")
DOCUMENTATION = ("Document timeline and actions taken", "Support post-incident review")
EXPECTED_FIELDS = ["id", "title", "description", "severity", "category", "type", "timestamp", "source", "affected_services", "users_affected", "reporter", "tags"]
KEPT_FIELDS = ["id", "title", "severity", "category", "timestamp", "source"]
TIMESTAMPS = [r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}", r"\b\d{10,13}\b"]
ERROR_KEYWORDS = ["error", "exception", "failed", "failure", "fatal", "critical", "panic", "crash", "timeout", "refused", "denied", "unauthorized", "forbidden", "not found", "null", "undefined", "segfault", "oom", "killed"]
STACKTRACES = [(r"(?d)at .+\(.+:\d+\)", r"at .+\(.+:\d+\)..."), (r'(?d)File ".+", line \d+', r'File ".+", line \d+...'), (r"\w+\.go:\d+", r"\w+\.go:\d+..."), (r"Traceback \(most recent call", "Traceback \\(most rec..."), (r"(?dm)^\s+at\s+", r"^\s+at\s+...")]
# End of fixed values.


def _text(*names: str) -> Column:
    parts = [F.coalesce(F.col(n), F.lit("")) for n in names]
    return F.lower(F.concat_ws(" ", *parts))


def _users() -> Column:
    return F.coalesce("users_affected", F.lit(0))


def _services() -> Column:
    return F.when(F.col("affected_services").isNull(), 0).otherwise(F.size("affected_services"))


def severity() -> Column:
    """A valid severity of the incident's own, else keywords of title, description and summary, else its impact."""
    own, text = F.lower(F.coalesce("severity", F.lit(""))), _text("title", "description", "summary")
    out = F.when(own.isin(EXPLICIT_SEVERITIES), own)
    for level, words in SEVERITY_KEYWORDS.items():
        out = out.when(contains_any(text, words), level)
    return out.when((_users() > 1000) | (_services() >= 3), "critical").when((_users() > 100) | (_services() >= 2), "high").otherwise("medium")


def category() -> Column:
    own, text = F.lower(F.coalesce("category", F.lit(""))), _text("title", "description", "type")
    out = F.when(own.isin(list(CATEGORY_KEYWORDS)), own)
    for name, words in CATEGORY_KEYWORDS.items():
        out = out.when(contains_any(text, words), name)
    return out.otherwise("unknown")


def risk_flags(level: Column, kind: Column) -> Column:
    def flag(test: Column, name: str, reason: Column | str, action: str) -> Column:
        return F.when(test, F.struct(F.lit(name).alias("flag"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"), F.lit(action).alias("action")))

    services = F.coalesce(F.array_join(F.slice("affected_services", 1, 5), ", "), F.lit(""))
    flags = [
        flag(kind == "security", "SECURITY_INCIDENT", "Incident classified as security-related", "Engage security team immediately"),
        flag(level == "critical", "CRITICAL_SEVERITY", "Incident severity is critical", "Escalate to on-call leadership"),
        flag(kind == "data_integrity", "DATA_AT_RISK", "Potential data integrity issue", "Verify backup status and data recovery options"),
        flag(_users() > 500, "HIGH_USER_IMPACT", F.concat(F.lit("Affects "), _users().cast("string"), F.lit(" users")), "Prepare customer communication"),
        flag(_services() >= 2, "MULTI_SERVICE_IMPACT", F.concat(F.lit("Affects "), _services().cast("string"), F.lit(" services: "), services), "Coordinate cross-team response"),
    ]
    return F.filter(F.array(*flags), lambda f: f.isNotNull())


def actions(level: Column, kind: Column) -> Column:
    """Actions of the category, a channel for grave incidents, documentation; numbered from 1."""
    one = lambda pair: F.struct(F.lit(pair[0]).alias("action"), F.lit(pair[1]).alias("rationale"))
    none = F.array().cast("array<struct<action:string,rationale:string>>")
    own = None
    for name, pairs in CATEGORY_ACTIONS.items():
        listed = F.array(*map(one, pairs))
        own = F.when(kind == name, listed) if own is None else own.when(kind == name, listed)
    every = F.concat(own.otherwise(none), F.when(level.isin("critical", "high"), F.array(one(COMMUNICATION))).otherwise(none), F.array(one(DOCUMENTATION)))
    return F.transform(every, lambda a, i: F.struct((i + 1).alias("priority"), a["action"].alias("action"), a["rationale"].alias("rationale")))


def _present(field: str) -> Column:
    c = F.col(field)
    if field in ("affected_services", "tags"):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull() & ((c != 0) if field == "users_affected" else (c != ""))


def evidence() -> Column:
    """Fields with and without a value (0, empty texts and lists have none), and the values that are kept."""
    names = lambda keep: F.filter(F.array(*[F.when(_present(f) if keep else ~_present(f), F.lit(f)) for f in EXPECTED_FIELDS]), lambda f: f.isNotNull())
    data = F.struct(*[F.when(_present(f), F.col(f)).alias(f) for f in KEPT_FIELDS], F.col("affected_services"), F.col("users_affected"))
    return F.struct(names(True).alias("source_fields_present"), names(False).alias("source_fields_missing"), data.alias("extracted_data"))


def incidents(rows: DataFrame) -> DataFrame:
    """rows: columns of SCHEMA. id, severity, category, risk_flags, recommended_actions, evidence."""
    named = rows.withColumns({"_level": severity(), "_kind": category()})
    level, kind = F.col("_level"), F.col("_kind")
    return named.select("id", level.alias("triaged_severity"), kind.alias("triaged_category"), risk_flags(level, kind).alias("risk_flags"), actions(level, kind).alias("recommended_actions"), evidence().alias("evidence"))


def timestamps(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in TIMESTAMPS])))


def error_keywords(text: Column) -> Column:
    low = F.lower(text)
    return F.array_sort(F.filter(F.array(*map(F.lit, ERROR_KEYWORDS)), lambda w: F.contains(low, w)))


def stacktraces(text: Column) -> Column:
    return F.array_sort(F.filter(F.array(*[F.when(text.rlike(p), F.lit(label)) for p, label in STACKTRACES]), lambda x: x.isNotNull()))


def line_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("\n")) + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)


def summary(lines: Column, errors: Column, stamps: Column, traces: Column) -> Column:
    part = lambda n, what: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {what}")))
    parts = F.concat_ws(", ", part(errors, "error keyword(s)"), part(stamps, "timestamp(s)"), part(traces, "stacktrace marker(s)"))
    head = F.concat(F.lit("Analyzed "), lines.cast("string"), F.lit(" lines"))
    return F.when(parts == "", F.concat(head, F.lit(", no notable signals detected."))).otherwise(F.concat(head, F.lit(": "), parts, F.lit(".")))


def text_signals(docs: DataFrame, column: str = "text", redacted: bool = True) -> DataFrame:
    """docs and line_count, char_count, timestamps, error_keywords, stacktrace_markers, summary of their (redacted) texts."""
    out = docs.withColumn("_t", redact.redact_ops(F.col(column)) if redacted else F.col(column))
    t = F.col("_t")
    out = out.withColumns({"line_count": line_count(t), "char_count": F.char_length(t), "timestamps": timestamps(t), "error_keywords": error_keywords(t), "stacktrace_markers": stacktraces(t)})
    return out.withColumn("summary", summary(F.col("line_count"), F.size("error_keywords"), F.size("timestamps"), F.size("stacktrace_markers"))).drop("_t")
