"""Reports as plain dictionaries: what is left of a query is a few rows, which the driver renders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions import redact
from textquarry.operators import evidence, lexicon, logs, policy, triage

PROTOCOL = "0.1"


def policy_json(value) -> str:
    """One line, sorted keys, a blank after each colon only."""
    return json.dumps(value, sort_keys=True, separators=(",", ": "), ensure_ascii=False)


def rows_of(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def check(docs: DataFrame, policies: list[policy.Policy], policy_path: str, inputs: list[str], now: str, single: bool = False, redacted: bool = True, skipped: DataFrame | None = None) -> dict:
    """docs: doc_id (a path), text. The report of a scan; single: of one file, which counts literals without overlap and gives no statistics of the scan."""
    found = rows_of(policy.findings(docs, policies, overlapping=not single, redacted=redacted))
    severities = {s: sum(f["severity"] == s for f in found) for s in policy.SEVERITIES}
    out = {"format": "policy-check.v1", "generated_at_utc": now, "policy_path": policy_path, "redaction_applied": redacted, "summary": {"policy_count": len(policies), "finding_count": len(found), "severity_counts": severities}}
    out["findings"] = [{"id": f["policy_id"], "title": f["title"], "severity": f["severity"], "description": f["description"], "match_count": f["match_count"], "samples": [s if not single else {k: v for k, v in s.items() if k != "file"} for s in f["samples"]]} for f in found]
    if single:
        return out | {"input_path": inputs[0]}
    with_hits = policy.hits(policy.lines(docs), policies).agg(F.count_distinct("file")).first()[0]
    stats = {"files_scanned": docs.count(), "files_with_findings": with_hits}
    if skipped is not None and (reasons := rows_of(policy.skip_summary(skipped))):
        stats["files_skipped"] = reasons
    return out | {"inputs": sorted(inputs), "scan_stats": stats}


def violations(report: dict, threshold: str) -> list[str]:
    limit = policy.SEVERITIES.index(threshold)
    return [f["id"] for f in report["findings"] if f["severity"] in policy.SEVERITIES[: limit + 1]]


def render_results(report: dict, threshold: str, max_findings: int = 0, exit_zero: bool = False) -> dict:
    """A check report as results by level, rule and first location. Violations are counted before findings are cut to max_findings (0: all)."""
    count = len(violations(report, threshold))
    shown = report["findings"][:max_findings] if max_findings else report["findings"]
    path, results = report.get("input_path", ""), []
    for f in shown:
        places = sorted(({"file": s.get("file", path), **{k: s[k] for k in ("line", "col_start", "col_end")}} for s in f["samples"]), key=lambda x: (str(x["file"]), x["line"], x["col_start"]))
        more = {"severity": f["severity"], "description": f["description"], "match_count": f["match_count"], "excerpt_redacted": any("[REDACTED" in s["excerpt"] for s in f["samples"])}
        results.append({"ruleId": f["id"], "level": policy.LEVELS.get(f["severity"], "note"), "message": f["title"], "locations": places, "properties": more})
    results.sort(key=lambda r: (policy.LEVEL_ORDER.index(r["level"]), r["ruleId"], *[(str(p["file"]), p["line"]) for p in r["locations"][:1]]))
    run = {"input_path": path or ",".join(report.get("inputs", [])), "policy_path": report["policy_path"], "generated_at_utc": report["generated_at_utc"], "redaction_applied": report["redaction_applied"], "results": results}
    summary = report["summary"] | {"exit_code_expected": policy.exit_code(count, exit_zero), "truncated": len(shown) < len(report["findings"]), "max_findings": max_findings or None}
    del summary["policy_count"]
    return {"format": "policy-results.v1", "version": "1", "tool": {"name": "textquarry", "rule_count": report["summary"]["policy_count"]}, "runs": [run], "threshold": {"fail_on": threshold, "violations": count}, "summary": summary}


def diagnosis(rows: DataFrame, kind: str, input_path: str, now: str, limit: int = 50, redacted: bool = True) -> dict:
    d = rows_of(logs.diagnose(rows, kind, limit, redacted))[0]
    names = ["severity_counts", "keyword_hits", "unique_sources", "top_sources"] + ["status_counts", "top_paths"] * (kind != "syslog")
    return {"events": d["events"], "format": kind, "generated_at_utc": now, "input_path": input_path, "line_count": d["line_count"], "event_count": d["event_count"], "limit": limit, "redaction_applied": redacted, "redaction_summary": d["redaction_summary"], "schema_version": "1.0.0", "signals": {k: d[k] for k in names}}


def text_triage(docs: DataFrame, now: str, redacted: bool = True) -> list[dict]:
    """docs: path, text."""
    out = []
    for r in rows_of(triage.text_signals(docs, redacted=redacted).orderBy("path")):
        signals = {k: r[k] for k in ("timestamps", "error_keywords", "stacktrace_markers")}
        out.append({"schema_version": "1.0.0", "generated_at_utc": now, "input_path": r["path"], "redaction_applied": redacted, "signals": signals, "line_count": r["line_count"], "char_count": r["char_count"], "summary": r["summary"]})
    return out


def incident_triage(rows: DataFrame) -> list[dict]:
    out = []
    for r in rows_of(triage.incidents(rows).join(rows.select("id", "title", "timestamp", "source"), "id").orderBy("id")):
        out.append({"protocol_version": PROTOCOL, "incident": {k: r[k] for k in ("id", "title", "timestamp", "source")}, "classification": {"severity": r["triaged_severity"], "category": r["triaged_category"]}, "recommended_actions": r["recommended_actions"], "risk_flags": r["risk_flags"], "evidence": r["evidence"]})
    return out


def lexicon_map(spark: SparkSession, text: str, pack: dict, entries: list[dict], now: str, limit: int = 10, apply: bool = False) -> dict:
    docs, terms = spark.createDataFrame([(0, text)], "doc_id long, text string"), [e["term"] for e in entries]
    found = rows_of(lexicon.count_terms(docs, terms).orderBy("term"))
    shown = rows_of(lexicon.previews(docs, terms, pack["pack_id"], limit).orderBy("order"))
    out = {"schema_version": "1.0.0", "generated_at_utc": now, "pack_id": pack["pack_id"], "pack_entries_sha256": lexicon.entries_sha256(entries), "match_strategy": "casefolded_exact", "matches": [{"term": f["term"], "count": f["occurrences"]} for f in found]}
    out["summary"] = {"total_entries": len(entries), "matched_terms": len(found), "total_occurrences": sum(f["occurrences"] for f in found)}
    out["redaction_preview"] = [{k: s[k] for k in ("original", "redacted", "context")} for s in shown]
    if apply:
        out["redacted_text"] = docs.select(lexicon.redact(F.col("text"), terms, pack["pack_id"])).first()[0]
    return out


def evidence_index(items: DataFrame) -> dict:
    """Counts by kind and items without their empty fields; no time of making, so equal input gives equal bytes."""
    indexed = evidence.index(items)
    return {"counts": {r["kind"]: r["n"] for r in rows_of(evidence.counts_by_kind(indexed))}, "items": [{k: v for k, v in r.items() if v is not None} for r in rows_of(indexed)]}


def preview_text(spark: SparkSession, text: str) -> dict:
    r = rows_of(redact.preview(spark.createDataFrame([(text,)], "content string"), "content"))[0]
    return {k: r[k] for k in ("original_length", "redacted_length", "redactions_applied", "redaction_types", "content")}
