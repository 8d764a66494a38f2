"""DuckDB twins of the registered queries. Redaction chains are written out from the catalogs in RE2's dialect; everything else is plain SQL."""

from __future__ import annotations

import re
from collections.abc import Iterable

from textquarry.functions import catalogs
from textquarry.functions.catalogs import Rule
from textquarry.operators import evidence, lexicon, logs, policy, triage
from textquarry.plans import queries as q
from textquarry.sources import files


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    keep = "".join(f for f in (flags[1] if flags else "") if f in "ims")
    return (f"(?{keep})" if keep else "") + (pattern[flags.end() :] if flags else pattern)


def chain(expr: str, rules: Iterable[Rule]) -> str:
    for r in rules:
        pattern, replacement = re2(r.pattern), r.replacement.replace("$", "\\")
        if pattern.endswith(r"(?=\s|$|['\"])"):  # what follows is put back
            pattern, replacement = pattern.replace(r"(?=\s|$|['\"])", r"(\s|$|['\"])"), replacement + "\\1"
        expr = f"regexp_replace({expr}, {lit(pattern)}, {lit(replacement)}, 'g')"
    return expr


def count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {lit(re2(pattern))}))"


M = "md5(doc_id::VARCHAR)"
SECRETS = f"""(SELECT doc_id, text || chr(10) || 'key AKIA' || upper(substr({M}, 1, 16)) || ' Bearer tok.' || doc_id || ' api_key="' || {M} || '" host 10.1.' || (doc_id % 256) || '.7 mail u' || doc_id
 || '@ex.org ssn 123-45-' || (6000 + doc_id % 1000) || ' v6 fe80:0:0:0:0:0:0:' || (doc_id % 9) || ' gh ghp_' || {M} || substr({M}, 1, 8) || ' xoxb-' || {M}
 || ' postgres://u:pw' || doc_id || '@db/x password=pw' || {M} || chr(10) || 'at com.a.B(C.java:12)' || chr(10) || 'error: timeout at 2024-05-06T07:08:09 ' AS text FROM documents)"""


def redaction(rules: Iterable[Rule]) -> str:
    return f"SELECT doc_id, {chain('text', rules)} AS redacted FROM {SECRETS}"


def staged(rules: list[Rule], source: str = SECRETS) -> str:
    """A CTE per rule: the text so far, and the hits of each rule in what the rules before left."""
    parts = [f"s0 AS (SELECT doc_id, length(text) AS n0, text FROM {source})"]
    for k, r in enumerate(rules):
        parts.append(f"s{k + 1} AS (SELECT * EXCLUDE (text), {chain('text', [r])} AS text, {count('text', r.pattern)} AS hits_{r.name} FROM s{k})")
    return "WITH " + ",\n".join(parts)


def net_counts() -> str:
    of = lambda c: " + ".join(f"hits_{r.name}" for r in catalogs.NET if catalogs.NET_COUNTER[r.name] == c)  # noqa: E731
    return f"{staged(catalogs.NET)} SELECT " + ", ".join(f"sum({of(c)})::BIGINT AS {c}" for c in ("emails", "hex_strings", "ips", "keys", "tokens")) + f" FROM s{len(catalogs.NET)}"


def preview_summary() -> str:
    total = " + ".join(f"hits_{r.name}" for r in catalogs.PREVIEW)
    types = "concat_ws(','" + "".join(f", CASE WHEN hits_{r.name} > 0 THEN '{r.name}' END" for r in catalogs.PREVIEW) + ")"
    return f"{staged(catalogs.PREVIEW)} SELECT doc_id, n0 AS original_length, length(text) AS redacted_length, {total} AS redactions_applied, {types} AS redaction_types FROM s{len(catalogs.PREVIEW)}"


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"
PII = "p(policy_id, title, severity, severity_rank, pattern, sample_limit) AS (VALUES " + ", ".join(f"({lit(p.id)}, {lit(p.title)}, {lit(p.severity)}, {policy.SEVERITIES.index(p.severity)}, {lit(p.pattern)}, {p.sample_limit})" for p in policy.PII_PACK) + ")"


def scan() -> str:
    """hits: policy_id, doc_id, line, col_start, col_end, content."""
    per = " UNION ALL ".join(f"SELECT {lit(p.id)} AS policy_id, doc_id, line, content, string_split_regex(content, {lit(p.pattern)}) AS g, regexp_extract_all(content, {lit(p.pattern)}) AS m FROM lines WHERE regexp_matches(content, {lit(p.pattern)})" for p in policy.PII_PACK)
    return f"""{LINES}, {PII}, found AS ({per}),
hits AS (SELECT policy_id, doc_id, line, content, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS col_start, length(m[i])::INT AS w
 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found))"""


EXCERPT = "(CASE WHEN greatest(0, col_start - pad) > 0 THEN '...' ELSE '' END || substr(content, greatest(0, col_start - pad) + 1, least(length(content), col_start + w + pad) - greatest(0, col_start - pad)) || CASE WHEN least(length(content), col_start + w + pad) < length(content) THEN '...' ELSE '' END)"
STATUS = "CASE WHEN event_type = 'error' THEN 500 + event_id % 4 WHEN event_type = 'click' AND event_id % 5 = 0 THEN 404 ELSE 200 END"
SYSLOG_MESSAGE = "CASE event_type WHEN 'error' THEN 'connection refused: timeout' WHEN 'signup' THEN 'accepted new user' WHEN 'click' THEN 'slow click' ELSE 'seen' END || ' from 10.2.3.' || (user_id % 250)"
SYSLOG = f"(SELECT event_id AS line_no, strftime(ts, '%b %d %H:%M:%S') AS ts, 'host' || (user_id % 7) AS source, 'app' AS program, CASE WHEN event_id % 3 <> 0 THEN event_id::VARCHAR END AS pid, {SYSLOG_MESSAGE} AS message FROM events WHERE event_id % 50 <> 0)"
#: connection refused: timeout has refused (error); accepted has accepted (info) and no graver word; slow is a warning.
SYSLOG_SEVERITY = "CASE WHEN message LIKE '%refused%' THEN 'error' WHEN message LIKE '%slow%' THEN 'warning' WHEN message LIKE '%accepted%' THEN 'info' END"
NGINX = f"(SELECT event_id AS line_no, '10.0.' || (user_id % 200) || '.' || (user_id % 250) AS source, strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000' AS ts, 'GET' AS method, '/' || event_type || '/' || (user_id % 20) AS path, {STATUS} AS status, CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id % 5000 END AS bytes, NULL::VARCHAR AS referer, CASE WHEN event_id % 4 <> 0 THEN 'agent/1' END AS user_agent FROM events)"
BY_STATUS = "CASE WHEN status >= 500 THEN 'error' WHEN status >= 400 THEN 'warning' ELSE 'info' END"
HAPROXY = f"(SELECT event_id AS line_no, '10.0.0.' || (user_id % 250) AS source, 'web' AS frontend, 'app' AS backend, 's' || (user_id % 5) AS server, '0/0/1/2/3' AS timings, {STATUS} AS status, event_id % 5000 AS bytes, CASE WHEN event_id % 11 = 0 THEN 'CD--' WHEN event_id % 13 = 0 THEN 'sH--' ELSE '----' END AS termination_state, CASE WHEN event_id % 6 <> 0 THEN 'GET' END AS method, CASE WHEN event_id % 6 <> 0 THEN '/' || event_type END AS path FROM events)"

INCIDENTS = """(SELECT o_orderkey::VARCHAR AS id, ['Breach of login','API down','Degraded search','Disk full on db','Corrupt backup','Misconfigured proxy','Minor glitch'][o_orderkey % 7 + 1] AS title,
 ['slow responses','users see errors','unauthorized calls seen','nothing else','timeout of jobs'][o_orderkey % 5 + 1] AS description,
 CASE WHEN o_orderkey % 10 = 3 THEN 'LOW' WHEN o_orderkey % 10 = 4 THEN 'bogus' END AS severity, CASE WHEN o_orderkey % 9 = 2 THEN 'performance' END AS category, o_orderpriority AS type,
 CASE WHEN o_orderkey % 2 = 0 THEN 'pager' ELSE '' END AS source, ['api','db','web','auth','mail','ci','dns'][1:o_orderkey % 8] AS services, floor(o_totalprice / 300)::BIGINT AS users FROM orders)"""


def any_of(expr: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(w)})" for w in words) + ")"


def triaged() -> str:
    sev = "CASE WHEN lower(coalesce(severity, '')) IN ('critical','high','medium','low') THEN lower(severity) " + " ".join(f"WHEN {any_of('st', w)} THEN '{k}'" for k, w in triage.SEVERITY_KEYWORDS.items()) + " WHEN users > 1000 OR len(services) >= 3 THEN 'critical' WHEN users > 100 OR len(services) >= 2 THEN 'high' ELSE 'medium' END"
    cat = f"CASE WHEN lower(coalesce(category, '')) IN ({', '.join(map(lit, triage.CATEGORY_KEYWORDS))}) THEN lower(category) " + " ".join(f"WHEN {any_of('ct', w)} THEN '{k}'" for k, w in triage.CATEGORY_KEYWORDS.items()) + " ELSE 'unknown' END"
    return f"i AS (SELECT *, lower(title || ' ' || description || ' ') AS st, lower(title || ' ' || description || ' ' || type) AS ct FROM {INCIDENTS}), t AS (SELECT *, {sev} AS lv, {cat} AS kd FROM i)"


FLAGS = {
    "SECURITY_INCIDENT": ("kd = 'security'", "'Incident classified as security-related'", "Engage security team immediately"),
    "CRITICAL_SEVERITY": ("lv = 'critical'", "'Incident severity is critical'", "Escalate to on-call leadership"),
    "DATA_AT_RISK": ("kd = 'data_integrity'", "'Potential data integrity issue'", "Verify backup status and data recovery options"),
    "HIGH_USER_IMPACT": ("users > 500", "'Affects ' || users || ' users'", "Prepare customer communication"),
    "MULTI_SERVICE_IMPACT": ("len(services) >= 2", "'Affects ' || len(services) || ' services: ' || array_to_string(services[1:5], ', ')", "Coordinate cross-team response"),
}


def triage_sql() -> str:
    flags = "concat_ws(','" + "".join(f", CASE WHEN {test} THEN '{n}' END" for n, (test, _, _) in FLAGS.items()) + ")"
    first = "CASE kd " + " ".join(f"WHEN '{k}' THEN {lit(a[0][0])}" for k, a in triage.CATEGORY_ACTIONS.items()) + f" ELSE CASE WHEN lv IN ('critical', 'high') THEN {lit(triage.COMMUNICATION[0])} ELSE {lit(triage.DOCUMENTATION[0])} END END"
    return f"WITH {triaged()} SELECT id, lv AS triaged_severity, kd AS triaged_category, {flags} AS flags, (CASE WHEN kd = 'unknown' THEN 0 ELSE 3 END + CASE WHEN lv IN ('critical', 'high') THEN 1 ELSE 0 END + 1)::BIGINT AS n_actions, {first} AS first_action FROM t"


def flags_sql() -> str:
    return f"WITH {triaged()} " + " UNION ALL ".join(f"SELECT id, '{n}' AS flag, {reason} AS reason, {lit(action)} AS action FROM t WHERE {test}" for n, (test, reason, action) in FLAGS.items())


def evidence_sql() -> str:
    has = {"id": "true", "title": "true", "description": "true", "severity": "severity IS NOT NULL", "category": "category IS NOT NULL", "type": "type <> ''", "timestamp": "true", "source": "source <> ''", "affected_services": "len(services) > 0", "users_affected": "users <> 0", "reporter": "false", "tags": "false"}
    part = lambda sign: "concat_ws(','" + "".join(f", CASE WHEN {'' if sign else 'NOT '}({t}) THEN '{f}' END" for f, t in has.items()) + ")"  # noqa: E731
    return f"SELECT id, {part(True)} AS present, {part(False)} AS missing FROM {INCIDENTS}"


def signals_sql() -> str:
    redacted = chain("text", catalogs.OPS)
    stamps = "list_sort(list_distinct(" + " || ".join(f"regexp_extract_all(t, {lit(p)})" for p in triage.TIMESTAMPS) + "))"
    words = "concat_ws(','" + "".join(f", CASE WHEN contains(lower(t), {lit(w)}) THEN {lit(w)} END" for w in sorted(triage.ERROR_KEYWORDS)) + ")"
    traces = "concat_ws(','" + "".join(f", CASE WHEN regexp_matches(t, {lit(re2(p))}) THEN {lit(label)} END" for p, label in sorted(triage.STACKTRACES, key=lambda x: x[1])) + ")"
    listed = lambda c: f"CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ',')) END"  # noqa: E731
    return f"""WITH r AS (SELECT doc_id, {redacted} AS t FROM {SECRETS}), s AS (SELECT doc_id, len(string_split(t, chr(10))) AS line_count, length(t) AS char_count, array_to_string({stamps}, ',') AS timestamps, {words} AS error_keywords, {traces} AS stacktrace_markers FROM r),
n AS (SELECT *, {listed('error_keywords')} AS a, {listed('timestamps')} AS b, {listed('stacktrace_markers')} AS c FROM s)
SELECT doc_id, line_count, char_count, timestamps, error_keywords, stacktrace_markers, CASE WHEN a + b + c = 0 THEN 'Analyzed ' || line_count || ' lines, no notable signals detected.' ELSE 'Analyzed ' || line_count || ' lines: ' || concat_ws(', ', CASE WHEN a > 0 THEN a || ' error keyword(s)' END, CASE WHEN b > 0 THEN b || ' timestamp(s)' END, CASE WHEN c > 0 THEN c || ' stacktrace marker(s)' END) || '.' END AS summary FROM n"""


def csv_sql() -> str:
    return r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
c AS (SELECT *, list_transform(string_split(trim(line), ','), lambda x: trim(x)) AS cells FROM l),
m AS (SELECT *, contains(line, ',') AND NOT regexp_matches(trim(line), '^Row \d+:') AND NOT regexp_matches(trim(line), '\w+=\S+,\s*\w+=') AND len(list_filter(cells, lambda x: x <> '')) >= 2 AS is_csv FROM c),
i AS (SELECT *, sum(CASE WHEN is_csv = p THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM (SELECT *, lag(is_csv) OVER (PARTITION BY doc_id ORDER BY n) AS p FROM m)),
r AS (SELECT *, sum(CASE WHEN len(cells) = q THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, island ORDER BY n) AS run FROM (SELECT *, lag(len(cells)) OVER (PARTITION BY doc_id, island ORDER BY n) AS q FROM i)),
s AS (SELECT *, count(*) OVER (PARTITION BY doc_id, island, run) AS size, row_number() OVER (PARTITION BY doc_id, island, run ORDER BY n) AS k, first_value(cells) OVER (PARTITION BY doc_id, island, run ORDER BY n) AS header FROM r),
t AS (SELECT *, min(CASE WHEN is_csv AND size >= 2 THEN run END) OVER (PARTITION BY doc_id, island) AS tab FROM s),
o AS (SELECT doc_id, n, CASE WHEN NOT is_csv OR tab IS NULL OR run < tab THEN line WHEN run = tab AND k > 1 THEN 'Row ' || (k - 1) || ': ' || array_to_string(list_transform(cells, lambda x, j: coalesce(nullif(header[j], ''), 'Col' || j) || '=' || x), ', ') END AS line FROM t)
SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS normalized FROM o WHERE line IS NOT NULL GROUP BY doc_id"""


def term(t: str) -> str:
    return lit(r"(?i)\b" + re.sub(r"([^\w\s])", r"\\\1", t) + r"\b")


def lexicon_counts_sql() -> str:
    per = " UNION ALL ".join(f"SELECT {lit(original)} AS term, len(regexp_extract_all(text, {term(t)})) AS n FROM documents" for t, original in lexicon.match_set(q.TERMS).items())
    return f"SELECT term, sum(n)::BIGINT AS occurrences, count(*) AS documents FROM ({per}) WHERE n > 0 GROUP BY term"


def inject_sql() -> str:
    e = "text"
    for k in lexicon.key_order(q.MAPPING):
        e = f"replace({e}, {lit(k)}, {lit(q.MAPPING[k])})"
    return f"SELECT doc_id, {e} AS injected FROM documents"


def lexicon_redact_sql() -> str:
    e = "text"
    for t in lexicon.key_order(lexicon.match_set(["License", "GNU General Public License", "the"])):
        e = f"regexp_replace({e}, {term(t)}, '[[LEXICON:terms]]', 'g')"
    return f"SELECT doc_id, {e} AS redacted FROM documents"


def literals_sql() -> str:
    per = []
    for p in q.NEEDLES:
        n = len(p.pattern)
        per.append(f"SELECT {lit(p.id)} AS policy_id, sum(o)::BIGINT AS overlapping, count(DISTINCT doc_id) AS files, sum(pl)::BIGINT AS plain FROM (SELECT doc_id, len(list_filter(range(1, length(content) + 1), lambda i: substr(content, i, {n}) = {lit(p.pattern)})) AS o, ((length(content) - length(replace(content, {lit(p.pattern)}, ''))) / {n})::BIGINT AS pl FROM lines WHERE contains(content, {lit(p.pattern)}))")
    return f"WITH {LINES} " + " UNION ALL ".join(per)


POLICY_COUNTS = f"WITH {scan()}, c AS (SELECT policy_id, count(*) AS match_count, count(DISTINCT doc_id) AS files FROM hits GROUP BY 1)"
KIND = "['decisions','prs','validation','misc'][doc_id % 4 + 1]"
INDEX = f"""SELECT 'ops/' || {KIND} || '/r' || doc_id || '.canonical.json' AS canonical_path, 'r' || doc_id AS id, ['decision','pr','validation','unknown'][doc_id % 4 + 1] AS kind, sha256(text) AS sha256, 'ops/' || {KIND} || '/r' || doc_id || '.canonical.json.sha256' AS sha256_path,
 CASE WHEN doc_id % 3 = 0 THEN '9999-12-31T23:59:59Z' ELSE '2024-01-02T03:04:' || lpad((doc_id % 60)::VARCHAR, 2, '0') || 'Z' END AS sort_timestamp_utc, CASE WHEN doc_id % 3 <> 0 THEN '2024-01-02T03:04:' || lpad((doc_id % 60)::VARCHAR, 2, '0') || 'Z' END AS timestamp_utc, nullif(source, '') AS source_ref FROM documents"""


def field_counts(source: str, fields: Iterable[str], counters: Iterable[str]) -> str:
    """Totals of the net rules' counters over every field of every event, stage by stage."""
    of = lambda c: " + ".join(f"hits_{r.name}" for r in catalogs.NET if catalogs.NET_COUNTER[r.name] == c)  # noqa: E731
    each = f"(SELECT line_no AS doc_id, unnest([{', '.join(f'{f}::VARCHAR' for f in fields)}]) AS text FROM {source})"
    return f"{staged(catalogs.NET, each)} SELECT " + ", ".join(f"coalesce(sum({of(c)}), 0)::BIGINT AS {c}" for c in counters) + f" FROM s{len(catalogs.NET)}"


NGINX_RAW = f"(SELECT *, method || ' ' || path || ' -> ' || status AS message, {BY_STATUS} AS severity, source || ' - - [' || ts || '] \"' || method || ' ' || path || ' HTTP/1.1\" ' || status || ' ' || CASE WHEN line_no % 9 = 0 THEN '-' ELSE bytes::VARCHAR END || CASE WHEN user_agent IS NULL THEN '' ELSE ' \"-\" \"agent/1\"' END AS raw FROM {NGINX})"


def diagnose_sql() -> str:
    source = chain("source", catalogs.NET)
    return f"""SELECT count(*) AS line_count, count(*) AS event_count, least(50, count(*))::INT AS n_events, (SELECT ips FROM ({field_counts(NGINX_RAW, ['source', 'ts', 'method', 'path', 'user_agent', 'message', 'severity', 'raw'], ['ips'])})) AS ips,
 count(DISTINCT {source}) AS unique_sources, least(10, count(DISTINCT {chain('path', catalogs.NET)}))::INT AS n_paths, count(*) FILTER (status >= 500) AS errors, count(*) FILTER (status = 404) AS not_found FROM {NGINX}"""


def blocked_sql(path: str) -> str:
    """Whether a path's last part matches a blocked name, or the path has a blocked part with a slash."""
    base = f"regexp_extract({path}, '[^/]*$')"
    return "(" + " OR ".join([f"regexp_matches({base}, {lit('(?s)' + files.glob_regex(p))})" for p in files.BLOCKED] + [f"contains({path}, {lit(p)})" for p in files.BLOCKED if "/" in p]) + ")"


PAGE_PATH = """replace('/data/site' || regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*', '') || CASE page_id % 6 WHEN 0 THEN '/.env' WHEN 1 THEN '/../x' WHEN 2 THEN '/server.pem' WHEN 3 THEN '/.git/config' ELSE '/index.html' END, CASE WHEN page_id % 6 = 4 THEN '/data/site' ELSE chr(0) END, '/srv')"""


def path_policy_sql() -> str:
    under = "(path = '/data/site' OR starts_with(path, '/data/site/'))"
    reason = f"CASE WHEN regexp_matches(path, '(^|/)\\.\\.(/|$)') THEN 'traversal_detected' WHEN {blocked_sql('path')} THEN 'blocked_pattern' WHEN NOT {under} THEN 'outside_allowed_roots' END"
    return f"SELECT page_id, reason IS NULL AS allowed, reason FROM (SELECT page_id, {reason} AS reason FROM (SELECT page_id, {PAGE_PATH} AS path FROM pages))"


DRIFT = """WITH r AS (SELECT doc_id AS path, sha256(text) AS sha256 FROM documents), a AS (SELECT * FROM r WHERE path % 10 <> 3), b AS (SELECT path, CASE WHEN path % 10 = 5 THEN reverse(sha256) ELSE sha256 END AS sha256 FROM r WHERE path % 10 <> 7)
SELECT path, status FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'only_left' WHEN a.path IS NULL THEN 'only_right' WHEN a.sha256 <> b.sha256 THEN 'changed' END AS status FROM a FULL JOIN b ON a.path = b.path) WHERE status IS NOT NULL"""
INTEGRITY = """WITH r AS (SELECT 'e/' || doc_id || '.json' AS path, doc_id, sha256(text) AS sha256 FROM documents), l AS (SELECT path, CASE WHEN doc_id % 7 = 1 THEN reverse(sha256) ELSE sha256 END || '  ' || CASE WHEN doc_id % 7 = 2 THEN 'other.json' ELSE path END AS line FROM r WHERE doc_id % 7 <> 4),
s AS (SELECT path, substr(line, 1, 64) AS stored, trim(substr(line, 67)) AS stored_path FROM l WHERE regexp_matches(line, '^[0-9a-f]{64}  .'))
SELECT r.path, CASE WHEN s.stored IS NULL THEN 'missing' WHEN s.stored <> r.sha256 THEN 'mismatch' WHEN s.stored_path NOT IN ('', r.path, regexp_extract(r.path, '[^/]+$')) THEN 'wrong_path' ELSE 'ok' END AS status FROM r LEFT JOIN s ON r.path = s.path"""
LINTS = r"""WITH t AS (SELECT doc_id, ['---' || chr(10) || 'name: a' || chr(10) || 'description: b' || chr(10) || '---' || chr(10), '---' || chr(10) || 'name: a' || chr(10) || '---' || chr(10), '---' || chr(10) || 'name: a' || chr(10), '---' || chr(10) || 'description: b' || chr(10) || '---' || chr(10), ''][doc_id % 5 + 1] || text AS text FROM documents),
h AS (SELECT doc_id, starts_with(text, '---') AS opened, regexp_extract(text, '(?s)^---
(.*?)
---', 1) AS head FROM t)
SELECT doc_id, concat_ws('; ', CASE WHEN NOT opened THEN 'no front matter' END, CASE WHEN opened AND head = '' THEN 'front matter isn''t closed' END, CASE WHEN opened AND head <> '' AND NOT regexp_matches(head, '(?m)^name:\s*\S') THEN 'no name' END, CASE WHEN opened AND head <> '' AND NOT regexp_matches(head, '(?m)^description:\s*\S') THEN 'no description' END) AS errors FROM h"""


def per_rule(rules: Iterable[tuple[str, str]], source: str, row: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {lit(n)} AS rule{row.format(p=lit(p))} FROM {source}" for n, p in rules)


def disallowed_sql() -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {lit(n)} AS rule FROM {SECRETS} WHERE regexp_matches(text, {lit(p)})" for n, p in evidence.DISALLOWED)


def secret_sql() -> str:
    source = """(SELECT doc_id, text || ' SECRET = "abc' || doc_id || '" TOKEN="your_token"' AS text FROM documents)"""
    return f"SELECT * FROM ({per_rule(evidence.SECRETS, source, ', unnest(regexp_extract_all(text, {p})) AS hit')}) WHERE NOT regexp_matches(lower(hit), {lit(evidence.PLACEHOLDERS)})"


SEARCH = r"""WITH l AS (SELECT conv_id || '/' || lpad(turn::VARCHAR, 4, '0') AS file, unnest(string_split_regex(text, '
|[

]')) AS content, generate_subscripts(string_split_regex(text, '
|[

]'), 1) AS line FROM conversations),
m AS (SELECT *, string_split_regex(content, '[a-z]tion') AS g FROM l WHERE regexp_matches(content, '[a-z]tion')), x AS (SELECT *, unnest(range(1, len(g))) AS i FROM m)
SELECT file, line::INT AS line, (list_sum(list_transform(g[1:i], lambda x: length(x))) + 5 * (i - 1))::INT AS "begin", (list_sum(list_transform(g[1:i], lambda x: length(x))) + 5 * i)::INT AS "end" FROM x ORDER BY file, line, "begin" LIMIT 100"""


def previews_sql() -> str:
    per = []
    for folded, original in sorted(lexicon.match_set(["License", "version", "under"]).items()):
        p = term(folded)
        per.append(f"SELECT doc_id, {lit(original)} AS term, regexp_extract(text, {p}) AS original, length(string_split_regex(text, {p})[1]) AS b, text FROM documents WHERE regexp_matches(text, {p})")
    cut = r"regexp_replace(regexp_replace(substr(text, greatest(0, b - 20) + 1, least(length(text), b + length(original) + 20) - greatest(0, b - 20)), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
    return f"SELECT doc_id, term, original, CASE WHEN b - 20 > 0 THEN '...' ELSE '' END || {cut} || CASE WHEN b + length(original) + 20 < length(text) THEN '...' ELSE '' END AS context FROM ({' UNION ALL '.join(per)})"


CHECKSUMS = """WITH d AS (SELECT DISTINCT doc_id AS k, 'e/' || doc_id || '.json' AS path FROM documents), s AS (SELECT path || '.sha256' AS sidecar_path, CASE k % 3 WHEN 0 THEN path WHEN 1 THEN k || '.json' ELSE 'e/' || k || 'x.json' END AS target FROM d), i AS (SELECT path FROM d WHERE k % 4 <> 0)
SELECT target, sidecar_path FROM s WHERE target NOT IN (SELECT path FROM i) AND regexp_extract(sidecar_path, '^(.*/)?') || regexp_extract(target, '[^/]*$') NOT IN (SELECT path FROM i)"""
#: A log's table begins in its seventh line, after a line before the heading; its rows go by the customer's number.
LOG_RECEIPTS = r"""WITH c AS (SELECT c_custkey AS k, c_nationkey::BIGINT AS doc_id, 7 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS line FROM customer),
r AS (SELECT doc_id, line, k, CASE WHEN k % 5 = 0 THEN 'legacy' ELSE 'standard' END AS kind, CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN 'ops/other/' || k || '.canonical.json' WHEN k % 7 = 2 THEN 'ops/evidence/validation/' || k || '.json' ELSE 'ops/evidence/validation/' || k || '.canonical.json' END AS receipt FROM c WHERE k % 13 <> 0 AND (k % 5 = 0 OR k % 11 <> 0))
SELECT doc_id, line, kind, receipt, CASE WHEN kind = 'legacy' THEN NULL WHEN receipt IS NULL THEN 'no receipt' WHEN NOT starts_with(receipt, 'ops/evidence/validation/') THEN 'another folder' WHEN NOT ends_with(receipt, '.canonical.json') THEN 'another ending' WHEN receipt NOT IN (SELECT 'ops/evidence/validation/' || c_custkey || '.canonical.json' FROM customer WHERE c_custkey % 2 = 0) THEN 'not found' END AS error FROM r"""
DECISIONS = r"""SELECT path, CASE WHEN k % 4 <> 0 THEN p_name END AS title, CASE WHEN k % 3 <> 0 THEN regexp_extract(p_type, '^\w+') END AS status, CASE WHEN k % 5 <> 0 THEN 'ops/evidence/decisions/' || k || '.canonical.json' END AS receipt
FROM (SELECT *, p_partkey AS k, 'docs/ADR-' || lpad(p_partkey::VARCHAR, 8, '0') || '.md' AS path FROM part) WHERE k % 6 <> 0 ORDER BY path DESC LIMIT 10"""


def oracle_sql() -> dict[str, str]:
    return {
        "checksum_targets": CHECKSUMS,
        "log_receipts": LOG_RECEIPTS,
        "decision_records": DECISIONS,
        "policy_scan_pii": f"{POLICY_COUNTS} SELECT policy_id, title, severity, severity_rank, match_count, files FROM c JOIN p USING (policy_id)",
        "policy_samples": f"WITH {scan()}, r AS (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY doc_id, line, col_start) AS sample, floor((120 - w) / 2)::INT AS pad FROM hits), e AS (SELECT policy_id, sample, doc_id, line::INT AS line, col_start, col_start + w AS col_end, {EXCERPT} AS x FROM r JOIN p USING (policy_id) WHERE sample <= sample_limit) SELECT * EXCLUDE (x), {chain('x', catalogs.POLICY)} AS excerpt FROM e",
        "policy_literals": literals_sql(),
        "policy_threshold": f"{POLICY_COUNTS}, f AS (SELECT * FROM c JOIN p USING (policy_id)) SELECT " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in policy.SEVERITIES) + ", count(*) FILTER (severity_rank <= 1) AS violations, coalesce(string_agg(policy_id, ',' ORDER BY severity_rank, policy_id) FILTER (severity_rank <= 1), '') AS policy_ids FROM f",
        "policy_report": f"{POLICY_COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY doc_id, line, col_start) AS sample, floor((120 - w) / 2)::INT AS pad FROM hits), s AS (SELECT policy_id, min(doc_id) AS first_file, count(*)::INT AS n_locations, bool_or(contains({chain(EXCERPT, catalogs.POLICY)}, '[REDACTED')) AS excerpt_redacted FROM r JOIN p USING (policy_id) WHERE sample <= sample_limit GROUP BY 1) SELECT policy_id AS rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, title AS message, severity, match_count, excerpt_redacted, n_locations, first_file FROM c JOIN p USING (policy_id) JOIN s USING (policy_id)",
        "spans_email": f"WITH f AS (SELECT doc_id, string_split_regex(text, {lit(catalogs.EMAIL)}) AS g, regexp_extract_all(text, {lit(catalogs.EMAIL)}) AS m FROM documents), x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f), y AS (SELECT doc_id, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS col_start, m[i] AS hit FROM x) SELECT doc_id, col_start, (col_start + length(hit))::INT AS col_end, hit FROM y",
        "redact_policy": redaction(catalogs.POLICY),
        "redact_net": redaction(catalogs.NET),
        "redact_ops": redaction(catalogs.OPS),
        "redact_ops_tokens": redaction([r for r in catalogs.OPS if r.name in catalogs.OPS_TOKENS]),
        "redact_ops_ips": redaction([r for r in catalogs.OPS if r.name in catalogs.OPS_IPS]),
        "redact_ops_uuids": redaction([r for r in catalogs.OPS if r.name == "uuid"]),
        "redact_preview": redaction(catalogs.PREVIEW),
        "redact_email": redaction([Rule("email", catalogs.EMAIL, catalogs.EMAIL_MARK)]),
        "redact_counts_net": net_counts(),
        "redact_counts_ops": "SELECT doc_id, (" + " + ".join(f"len(regexp_extract_all(text, {lit(re2(r.pattern).replace(chr(40) + '?=' + chr(92) + 's|$|[' + chr(39) + chr(92) + chr(34) + '])', '(?:' + chr(92) + 's|$|[' + chr(39) + chr(92) + chr(34) + '])'))}))" for r in catalogs.OPS) + f")::BIGINT AS hits FROM {SECRETS}",
        "redact_preview_summary": preview_summary(),
        "skip_reasons": "SELECT reason, count(*) AS count FROM (SELECT CASE WHEN contains(url, '#') THEN 'anchor' WHEN starts_with(url, 'http:') THEN 'not secure' END AS reason FROM pages) WHERE reason IS NOT NULL GROUP BY 1",
        "path_policy": path_policy_sql(),
        "syslog_events": f"SELECT *, {SYSLOG_SEVERITY} AS severity FROM {SYSLOG}",
        "syslog_signals": f"WITH e AS (SELECT *, {SYSLOG_SEVERITY} AS severity FROM {SYSLOG}) SELECT 'severity:' || severity AS name, count(*) AS n FROM e WHERE severity IS NOT NULL GROUP BY 1 " + " ".join(f"UNION ALL SELECT 'keyword:{w}', n FROM (SELECT count(*) AS n FROM e WHERE contains(lower(message), '{w}')) WHERE n > 0" for w in logs.SIGNAL_WORDS) + " UNION ALL SELECT 'sources', count(DISTINCT source) FROM e",
        "syslog_redaction": field_counts(f"(SELECT *, {SYSLOG_SEVERITY} AS severity, ts || ' ' || source || ' ' || program || coalesce('[' || pid || ']', '') || ': ' || message AS raw FROM {SYSLOG})", ["ts", "source", "program", "pid", "message", "severity", "raw"], ["emails", "hex_strings", "ips", "keys", "tokens"]),
        "nginx_events": f"SELECT *, method || ' ' || path || ' -> ' || status AS message, {BY_STATUS} AS severity FROM {NGINX}",
        "nginx_status": f"SELECT status, count(*) AS n FROM {NGINX} GROUP BY 1",
        "nginx_top_paths": f"SELECT path, count(*) AS n, min(line_no) AS first_line FROM {NGINX} GROUP BY 1 ORDER BY n DESC, first_line LIMIT 10",
        "nginx_top_sources": f"SELECT source, count(*) AS n, min(line_no) AS first_line FROM {NGINX} GROUP BY 1 ORDER BY n DESC, first_line LIMIT 10",
        "haproxy_events": f"SELECT *, CASE WHEN method IS NULL THEN '' ELSE method || ' ' || path || ' ' END || frontend || '->' || backend || '/' || server || ' ' || status AS message, CASE WHEN termination_state = 'CD--' THEN 'warning' WHEN termination_state = 'sH--' THEN 'error' ELSE {BY_STATUS} END AS severity FROM {HAPROXY}",
        "diagnose_nginx": diagnose_sql(),
        "incident_triage": triage_sql(),
        "incident_flags": flags_sql(),
        "incident_evidence": evidence_sql(),
        "text_signals": signals_sql(),
        "table_csv": csv_sql(),
        "lexicon_counts": lexicon_counts_sql(),
        "lexicon_totals": f"SELECT {len(q.TERMS)}::INT AS total_entries, count(*) AS matched_terms, coalesce(sum(occurrences), 0)::BIGINT AS total_occurrences FROM ({lexicon_counts_sql()})",
        "lexicon_redact": lexicon_redact_sql(),
        "lexicon_inject": inject_sql(),
        "lexicon_hash": """SELECT sha256('[' || string_agg('{"category":"' || n_regionkey || '","term":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']') AS entries_sha256 FROM nation""",
        "row_manifest": "SELECT 'docs/' || doc_id AS path, min(sha256(text)) AS sha256, arg_min(strlen(text), sha256(text)) AS bytes FROM documents GROUP BY doc_id",
        "duplicate_texts": "SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
        "label_orphans": "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "label_dangling": "SELECT doc_id * 2 AS doc_id FROM labels WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)",
        "drift_diff": DRIFT,
        "integrity_check": INTEGRITY,
        "evidence_index": INDEX,
        "evidence_counts": f"SELECT kind, count(*) AS n FROM ({INDEX}) GROUP BY 1",
        "license_references": "SELECT doc_id, n AS \"references\", CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'multiple' ELSE 'one' END AS status FROM (SELECT doc_id, len(regexp_extract_all(text, '[Ll]icense')) AS n FROM documents)",
        "newest_orders": "SELECT strftime(o_orderdate, '%Y%m%d') || '_' || lpad(o_orderkey::VARCHAR, 8, '0') AS receipt, o_orderkey FROM orders ORDER BY receipt DESC LIMIT 20",
        "last_events": "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20",
        "text_functions": r"""SELECT doc_id, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 50) AS slug, CASE WHEN length(text) > 120 THEN substr(text, 1, 117) || '...' ELSE text END AS short, substr(sha256(text), 1, 16) AS path_hash,
 array_to_string(list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|') AS tags, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS collapsed, CASE WHEN text LIKE '%' || chr(10) THEN len(string_split(text, chr(10))) - 1 ELSE len(string_split(text, chr(10))) END AS n_lines, 4::BIGINT AS n_range FROM documents""",
        "extract_normalize": r"""SELECT doc_id, CASE WHEN t = '' THEN '' ELSE t || chr(10) END AS normalized FROM (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(replace(text, '. ', '. ' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || ' '), chr(13) || chr(10), chr(10)), chr(10)), lambda x: rtrim(x)), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)""",
        "document_lints": LINTS,
        "disallowed_scan": disallowed_sql(),
        "secret_scan": secret_sql(),
        "search_lines": SEARCH,
        "lexicon_preview": previews_sql(),
        "json_check": "SELECT event_id, json_valid(CASE WHEN event_id % 17 = 0 THEN props || '}' ELSE props END) AS valid FROM events",
        "first_difference": "WITH p AS (SELECT doc_id, text AS a, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents) SELECT doc_id, CASE WHEN a = b THEN -1 ELSE coalesce(list_position(list_transform(list_zip(string_split(a, ''), string_split(b, ''), true), lambda x: x[1] = x[2]), false) - 1, least(length(a), length(b))) END::BIGINT AS at FROM p WHERE b IS NOT NULL",
    }
