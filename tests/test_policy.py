import re

from pyspark.sql import functions as F

from textquarry.functions import spans
from textquarry.operators import policy


def docs(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def test_spans_are_those_of_finditer(spark):
    texts = ["a😀12b345", "", "no", "1 22 333", "é1é22"]
    got = docs(spark, texts).select(spans.spans(F.col("text"), "[0-9]+")).collect()
    assert [[tuple(s) for s in r[0]] for r in got] == [[(*m.span(), m.group()) for m in re.finditer("[0-9]+", t)] for t in texts]


def test_overlapping_and_plain_literals(spark):
    df = docs(spark, ["aaaa", "xaax", "", "b"])
    got = df.select(F.size(spans.overlapping(F.col("text"), "aa")), spans.count_literal(F.col("text"), "aa")).collect()
    assert [tuple(r) for r in got] == [(3, 2), (1, 1), (0, 0), (0, 0)]


def test_lines_by_every_line_end(spark):
    t = "a\r\nb\rc\nd\x0be\x85f g\n"
    got = policy.lines(docs(spark, [t, "", None])).collect()
    assert [(r.file, r.line, r.content) for r in got] == [(0, k + 1, x) for k, x in enumerate(t.splitlines())]


def excerpt(line, a, b, n=120):
    pad = (n - (b - a)) // 2
    left, right = max(0, a - pad), min(len(line), b + pad)
    right = min(right, left + n)
    return ("..." if left > 0 else "") + line[left:right] + ("..." if right < len(line) else "")


def test_excerpts(spark):
    rows = [("x" * 300, 100, 110), ("y" * 50, 10, 20), ("z" * 300, 50, 250), ("w" * 130, 0, 5), ("v" * 100, 90, 95)]
    df = spark.createDataFrame(rows, "line string, a int, b int")
    got = [r[0] for r in df.select(spans.excerpt(F.col("line"), F.col("a"), F.col("b"))).collect()]
    assert got[:2] + got[3:] == [excerpt(*r) for r in rows[:2] + rows[3:]]
    assert len(got[2]) <= 126


def test_findings_thresholds_and_report(spark):
    pack = [policy.Policy("P2", "Second", "low", "contains", "b", "d", 1), policy.Policy("P1", "First", "critical", "contains", "a", "d", 2), policy.Policy("P3", "Third", "high", "regex", "c+", "d", 5), policy.Policy("P4", "None", "high", "regex", "q", "d", 5)]
    found = policy.findings(docs(spark, ["a b c", "aa\nccc bb"]), pack).cache()
    assert [(r.policy_id, r.match_count, r.files, len(r.samples)) for r in found.collect()] == [("P1", 3, 2, 2), ("P3", 2, 2, 2), ("P2", 3, 2, 1)]
    assert policy.severity_counts(found).first().asDict() == {"critical": 1, "high": 1, "medium": 0, "low": 1, "info": 0}
    assert tuple(policy.violations(found, "high").first()) == (2, ["P1", "P3"])
    report = policy.report_results(found).collect()
    assert [(r.rule_id, r.level) for r in report] == [("P1", "error"), ("P3", "error"), ("P2", "note")]
    assert policy.exit_code(2) == 3 and policy.exit_code(2, True) == 0


def test_no_policy_hits(spark):
    assert policy.findings(docs(spark, ["x", None, ""]), policy.PII_PACK).count() == 0


def test_validation():
    good = {"id": "A", "title": "t", "severity": "low", "type": "regex", "pattern": "a+", "description": "d"}
    assert policy.validate([good]) == []
    bad = policy.validate([good, good | {"severity": "x"}, good | {"id": "B", "pattern": "("}, good | {"id": "C", "sample_limit": 0}])
    assert len(bad) == 4 and "twice" in "".join(bad)


def test_overlapping_literals(spark):
    from pyspark.sql import functions as F

    from textquarry.functions import spans

    texts = ["ththth", "x thth thth", "é.*é.*é", "none", "", "th", "athtthth", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for needle in ("thth", "é.*é", "t"):
        got = [r[0] and [(s.col_start, s.col_end, s.hit) for s in r[0]] or [] for r in df.select(spans.overlapping(F.col("t"), needle)).collect()]
        assert got == [[(k, k + len(needle), needle) for k in range(len(t or "")) if t.startswith(needle, k)] if t else [] for t in texts]
