"""Command line: clean, lexicon-map, check, diagnose, triage, incident-triage, pack, evidence-index, list, read, search, preview.

    python -m textquarry.cli check --input logs --pack pii.v1 --fail-on high

Exit codes: 0 fine, 1 failure, 2 usage, 3 findings at or above the threshold.
"""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textquarry.functions.text import universal_lines
from textquarry.operators import clean, lexicon, policy, reports
from textquarry.sources import files, trees


def session() -> SparkSession:
    return SparkSession.builder.appName("textquarry").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def text_of(spark: SparkSession, path: str, kind: str | None = None) -> str:
    """The text of a file or of the input; a PDF's by its ending, unless kind says otherwise."""
    if path == "-":
        return sys.stdin.read()
    if kind == "pdf" or kind is None and path.lower().endswith(".pdf"):
        return files.pdf_texts(spark, path).first()["text"]
    data = Path(path).read_bytes()
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def run_clean(spark, a) -> tuple[str, int]:
    mapping = files.load_mapping(a.lexicon) if a.lexicon else None
    kind = a.input_type if a.input_type != "auto" else "pdf" if a.input.lower().endswith(".pdf") else "text"
    if kind == "pdf" and a.input == "-":
        raise ValueError("--input-type pdf needs --input")
    docs = spark.createDataFrame([(0, text_of(spark, a.input, kind))], "doc_id long, text string")
    out = clean.clean(docs, normalize=a.normalize_tables, mapping=mapping, target=a.lexicon_target)
    if a.output_format == "text":
        return clean.shown(out).first()["text"], 0
    meta = {"schema_version": "1", "source": "stdin" if a.input == "-" else "pdf" if kind == "pdf" else "file", "input_type": kind, "normalize_tables": a.normalize_tables}
    if mapping:
        meta["lexicon"] = lexicon.meta(a.lexicon, mapping, a.lexicon_target)
    row = out.first()
    return json.dumps({"meta": meta, "normalized": row["normalized"], "redacted": row["redacted"]}, ensure_ascii=False, separators=(",", ":")) + "\n", 0


def run_lexicon_map(spark, a) -> tuple[str, int]:
    pack, entries, errors = files.load_pack(a.pack)
    if errors:
        raise ValueError("; ".join(errors))
    return lexicon.pretty_json(reports.lexicon_map(spark, text_of(spark, a.input), pack, entries, a.fixed_time, a.limit, a.apply)), 0


def run_check(spark, a) -> tuple[str, int]:
    if a.list_packs:
        return "\n".join(files.policy_packs(a.pack_folder)) + "\n", 0
    policies = sorted(files.policy_pack(a.pack, a.pack_folder)) if a.pack else files.load_policies(a.policy)
    targets, skipped = trees.collect_targets(a.input, a.include_ext, a.follow_symlinks, a.max_files)
    single = len(a.input) == 1 and Path(a.input[0]).is_file()
    if not targets:
        raise ValueError("no file to scan")
    rows = spark.read.format("binaryFile").load(targets).select(F.regexp_replace("path", "^file:/*", "/").alias("doc_id"), files.decoded(F.expr(f"substring(content, 1, {a.max_bytes_per_file})")).alias("text"))
    left = spark.createDataFrame(skipped, "path string, reason string")
    report = reports.check(rows, policies, a.policy or f"pack:{a.pack}", a.input, a.fixed_time, single, not a.no_redact, left)
    code = policy.exit_code(len(reports.violations(report, a.fail_on)), a.exit_zero)
    if a.format == "results":
        return reports.policy_json(reports.render_results(report, a.fail_on, a.max_findings, a.exit_zero)) + "\n", code
    if a.max_findings:
        report["findings"] = report["findings"][: a.max_findings]
    return reports.policy_json(report) + "\n", code


def run_diagnose(spark, a) -> tuple[str, int]:
    whole = spark.createDataFrame([(Path(a.input).read_text(encoding="utf-8", errors="replace"),)], "text string")
    rows = whole.select(F.posexplode(universal_lines(F.col("text"))).alias("line_no", "line"))
    return lexicon.pretty_json(reports.diagnosis(rows, a.format, str(Path(a.input).resolve()), a.fixed_time, a.limit, not a.no_redact)), 0


def run_triage(spark, a) -> tuple[str, int]:
    docs = spark.createDataFrame([(a.input, text_of(spark, a.input))], "path string, text string")
    return lexicon.pretty_json(reports.text_triage(docs, a.fixed_time, not a.no_redact)[0]), 0


def run_incident_triage(spark, a) -> tuple[str, int]:
    found = reports.incident_triage(trees.read_incidents(spark, a.input))
    return lexicon.pretty_json(found[0] if len(found) == 1 else found), 0


def run_pack(spark, a) -> tuple[str, int]:
    if a.action == "validate":
        _, _, errors = files.load_pack(a.pack)
        return "".join(f"{e}\n" for e in errors), 2 * bool(errors)
    if a.action == "show":
        pack, entries, errors = files.load_pack(a.pack)
        return lexicon.pretty_json(pack | {"entry_count": len(entries), "entries": entries[: a.limit]}), 2 * bool(errors)
    if a.action == "lock":
        return (f"{files.write_lock(a.pack, a.fixed_time)}\n" if a.write else lexicon.pretty_json(files.make_lock(a.pack, a.fixed_time))), 0
    if a.action == "verify":
        errors = files.verify_lock(a.pack)
        return "".join(f"{e}\n" for e in errors), 2 * bool(errors)
    if a.action == "discover":
        return lexicon.pretty_json(files.discover(a.pack)), 0
    checked = files.verify_all(a.pack, a.fail_fast)
    return lexicon.pretty_json([{"path": n, "errors": e} for n, e in checked]), 2 * any(e for _, e in checked)


def run_evidence_index(spark, a) -> tuple[str, int]:
    good, bad = trees.evidence_items(trees.evidence_files(spark, a.input))
    index, errors = reports.evidence_index(good), [f"{r.canonical_path}: {r.error}\n" for r in bad.orderBy("canonical_path").collect()]
    if a.write:
        trees.write_index(index, a.input)
        return "".join(errors), int(bool(errors))
    if a.print_canonical:
        return trees.index_artifacts(index)["INDEX.canonical.json"], int(bool(errors))
    if a.check:
        drifted = trees.index_drift(index, a.input)
        return "".join(errors) + "".join(f"{n} differs\n" for n in drifted), int(bool(errors or drifted))
    return trees.index_artifacts(index)["INDEX.json"], int(bool(errors))


def run_list(spark, a) -> tuple[str, int]:
    entries, more = files.list_dir(a.input, a.allowed, a.limit or files.MAX_RESULTS)
    return lexicon.pretty_json({"entries": entries, "truncated": more}), 0


def run_read(spark, a) -> tuple[str, int]:
    return lexicon.pretty_json(files.read_range(a.input, a.allowed, a.offset, a.limit)), 0


def run_search(spark, a) -> tuple[str, int]:
    texts = files.files(spark, a.input, max_files=None)
    allowed = texts.filter(files.blocked(F.col("file")).isNull() & ~F.col("truncated"))
    return lexicon.pretty_json(reports.rows_of(files.search(allowed, a.pattern, a.limit))), 0


def run_preview(spark, a) -> tuple[str, int]:
    return lexicon.pretty_json(reports.preview_text(spark, text_of(spark, a.input))), 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textquarry", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, many: bool = False):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        c.add_argument("--input", **({"action": "append", "default": []} if many else {"default": "-"}))
        c.add_argument("--fixed-time", default=datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))
        return c

    c = command("clean", run_clean)
    c.add_argument("--normalize-tables", action="store_true")
    c.add_argument("--output-format", choices=["text", "jsonl"], default="text")
    c.add_argument("--input-type", choices=["auto", "text", "pdf"], default="auto")
    c.add_argument("--pdf-mode", choices=["text-only"], default="text-only")
    c.add_argument("--lexicon")
    c.add_argument("--lexicon-mode", choices=["replace"], default="replace")
    c.add_argument("--lexicon-target", choices=["input", "normalized", "both"], default="input")
    c = command("lexicon-map", run_lexicon_map)
    c.add_argument("--pack", required=True)
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--apply", action="store_true")
    c = command("check", run_check, many=True)
    which = c.add_mutually_exclusive_group(required=True)
    which.add_argument("--policy")
    which.add_argument("--pack")
    which.add_argument("--list-packs", action="store_true")
    c.add_argument("--pack-folder")
    c.add_argument("--no-redact", action="store_true")
    c.add_argument("--fail-on", choices=policy.SEVERITIES, default="high")
    c.add_argument("--format", choices=["check", "results"], default="check")
    c.add_argument("--max-findings", type=int, default=0)
    c.add_argument("--exit-zero", action="store_true")
    c.add_argument("--max-files", type=int, default=files.MAX_FILES)
    c.add_argument("--max-bytes-per-file", type=int, default=files.MAX_SCAN_BYTES)
    c.add_argument("--include-ext", type=lambda s: [x.strip() for x in s.split(",") if x.strip()])
    c.add_argument("--follow-symlinks", action="store_true")
    c = command("diagnose", run_diagnose)
    c.add_argument("--format", choices=["syslog", "nginx", "haproxy"], required=True)
    c.add_argument("--limit", type=int, default=50)
    c.add_argument("--no-redact", action="store_true")
    c = command("triage", run_triage)
    c.add_argument("--output-file")
    c.add_argument("--no-redact", action="store_true")
    command("incident-triage", run_incident_triage)
    c = command("pack", run_pack)
    c.add_argument("action", choices=["validate", "show", "lock", "verify", "discover", "verify-all"])
    c.add_argument("--pack", "--root", dest="pack", required=True)
    c.add_argument("--limit", type=int, default=5)
    c.add_argument("--write", action="store_true")
    c.add_argument("--fail-fast", action="store_true")
    c = command("evidence-index", run_evidence_index)
    c.add_argument("--write", action="store_true")
    c.add_argument("--check", action="store_true")
    c.add_argument("--print-canonical", action="store_true")
    for name, run in (("list", run_list), ("read", run_read)):
        c = command(name, run)
        c.add_argument("--allowed", action="append", required=True, help="a root that may be shown")
        c.add_argument("--limit", type=int)
        c.add_argument("--offset", type=int, default=0)
    c = command("search", run_search)
    c.add_argument("--pattern", required=True)
    c.add_argument("--limit", type=int, default=files.MAX_RESULTS)
    command("preview", run_preview)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        text, code = a.run(spark or session(), a)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return policy.EXIT_ERROR
    if getattr(a, "output_file", None):
        Path(a.output_file).write_text(text, encoding="utf-8")
    else:
        sys.stdout.write(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
