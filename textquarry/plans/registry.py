"""All registered queries of the library proper and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textquarry.functions import redact
from textquarry.plans import oracles
from textquarry.plans import queries as q

#: Redactions that are one column each, over documents with planted secrets.
CHAINS = {
    "redact_policy": redact.redact_policy,
    "redact_net": redact.redact_net,
    "redact_ops": redact.redact_ops,
    "redact_ops_tokens": redact.redact_tokens,
    "redact_ops_ips": redact.redact_ips,
    "redact_ops_uuids": redact.redact_uuids,
    "redact_preview": redact.redact_preview,
    "redact_email": redact.redact_emails,
}

PLAIN = [
    q.policy_scan_pii, q.policy_samples, q.policy_literals, q.policy_threshold, q.policy_report, q.spans_email, q.search_lines, q.skip_reasons, q.path_policy,
    q.redact_counts_net, q.redact_counts_ops, q.redact_preview_summary, q.phone_redact,
    q.syslog_events, q.syslog_signals, q.syslog_redaction, q.nginx_events, q.nginx_status, q.nginx_top_paths, q.nginx_top_sources, q.haproxy_events, q.diagnose_nginx,
    q.incident_triage, q.incident_flags, q.incident_evidence, q.text_signals,
    q.table_normalize, q.table_csv, q.lexicon_counts, q.lexicon_totals, q.lexicon_redact, q.lexicon_inject, q.lexicon_preview, q.lexicon_hash,
    q.row_manifest, q.duplicate_texts, q.label_orphans, q.label_dangling, q.drift_diff, q.integrity_check, q.evidence_index, q.evidence_counts, q.license_references, q.checksum_targets, q.log_receipts, q.decision_records,
    q.newest_orders, q.last_events, q.text_functions, q.extract_normalize, q.first_difference, q.document_lints, q.secret_scan, q.disallowed_scan, q.jsonl_records, q.json_check,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.chain_query(f) for name, f in CHAINS.items()} | {f.__name__: f for f in PLAIN}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.policy_scan_pii(spark, sf_dir)
