from textquarry.operators import logs, triage


def rows(spark, lines):
    return spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "line_no long, line string")


def test_syslog(spark):
    lines = ["Dec 23 14:30:45 web sshd[12]: Connection refused by 10.0.0.1", "dec  3 01:02:03 db app: all ok", "nonsense", "", "  Jan  1 00:00:00 h p: kernel panic error "]
    got = logs.syslog(rows(spark, lines)).orderBy("line_no").collect()
    assert [(r.line_no, r.ts, r.source, r.program, r.pid, r.severity) for r in got] == [(0, "Dec 23 14:30:45", "web", "sshd", "12", "error"), (1, "dec 3 01:02:03", "db", "app", None, "info"), (4, "Jan 1 00:00:00", "h", "p", None, "critical")]


def test_nginx(spark):
    lines = ['1.2.3.4 - bob [t] "GET /a HTTP/1.1" 200 12 "-" "ua"', '1.2.3.4 - - [t] "/b" 404 -', '1.2.3.4 - - [t] "" 500 7 "ref" "-"', "junk"]
    got = logs.nginx(rows(spark, lines)).orderBy("line_no").collect()
    assert [(r.method, r.path, r.status, r.bytes, r.referer, r.user_agent, r.severity, r.message) for r in got] == [("GET", "/a", 200, 12, None, "ua", "info", "GET /a -> 200"), (None, "/b", 404, 0, None, None, "warning", "? /b -> 404"), (None, None, 500, 7, "ref", None, "error", "? ? -> 500")]


def test_haproxy(spark):
    tail = '[d] fe be/s1 0/0/1/2/3 {} 10 - - {} 1/1/1/1/0 0/0 "GET /x HTTP/1.1"'
    lines = ["Dec 1 01:01:01 h haproxy[1]: 1.1.1.1:80 " + tail.format(200, "CD--"), "1.1.1.1:80 " + tail.format(200, "sH--"), "1.1.1.1:80 " + tail.format(404, "----").rsplit(' "', 1)[0]]
    got = logs.haproxy(rows(spark, lines)).orderBy("line_no").collect()
    assert [(r.severity, r.message) for r in got] == [("warning", "GET /x fe->be/s1 200"), ("error", "GET /x fe->be/s1 200"), ("warning", "fe->be/s1 404")]


def test_top_breaks_ties_by_first_line(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, None), (6, "")], "line_no long, path string")
    assert [r.path for r in logs.top(df, "path", 2).collect()] == ["b", "a"]


def test_diagnose_counts_sources_after_redaction(spark):
    lines = [f'10.0.0.{k} - - [t] "GET /a HTTP/1.1" 200 1' for k in range(3)]
    row = logs.diagnose(rows(spark, [*lines, "x"]), "nginx", limit=2).first()
    assert (row.line_count, row.event_count, len(row.events), row.unique_sources, row.redaction_summary.ips) == (4, 3, 2, 1, 6)
    assert row.status_counts == {"200": 3} and row.severity_counts == {"info": 3}
    assert logs.diagnose(rows(spark, lines), "nginx", redact_events=False).first().unique_sources == 3


def incident(spark, **fields):
    base = dict.fromkeys([f.split()[0] for f in triage.SCHEMA.split(", ")]) | {"id": "1"} | fields
    return triage.incidents(spark.createDataFrame([base], triage.SCHEMA)).first()


def test_incident_severity_and_category(spark):
    assert incident(spark, title="Service degraded", description="latency up", affected_services=["a"], users_affected=250).triaged_severity == "high"
    assert incident(spark, severity="CRITICAL", category="Security").triaged_category == "security"
    assert incident(spark, users_affected=1001).triaged_severity == "critical"
    assert incident(spark, title="x").triaged_severity == "medium"
    row = incident(spark, severity="critical", category="security", affected_services=["a", "b", "c"], users_affected=15000)
    assert [f.flag for f in row.risk_flags] == ["SECURITY_INCIDENT", "CRITICAL_SEVERITY", "HIGH_USER_IMPACT", "MULTI_SERVICE_IMPACT"]
    assert [a.priority for a in row.recommended_actions] == [1, 2, 3, 4, 5]
    assert "title" in row.evidence.source_fields_missing and "severity" in row.evidence.source_fields_present


def test_text_signals(spark):
    t = 'at com.a.B(C.java:12)\nERROR 2024-01-02T03:04:05 killed\nFile "x.py", line 3\n'
    row = triage.text_signals(spark.createDataFrame([(t,), ("",)], "text string"), redacted=False).collect()
    assert row[0].line_count == 3 and row[0].timestamps == ["2024-01-02T03:04:05"] and row[0].error_keywords == ["error", "killed"]
    assert row[0].stacktrace_markers == [r'File ".+", line \d+...', r"at .+\(.+:\d+\)..."]
    assert row[0].summary == "Analyzed 3 lines: 2 error keyword(s), 1 timestamp(s), 2 stacktrace marker(s)."
    assert row[1].summary == "Analyzed 0 lines, no notable signals detected."
