"""Log lines as typed events, and the signals of a log.

Input: columns line_no and line; unparsed lines are dropped. Severity comes from the line as it is, signals from
events as they are given (redact them first to count what a report would show).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import redact
from textquarry.functions.text import strip

# Line formats (groups by number), severity words from the gravest, and signal words.
SYSLOG = r"(?di)^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\s\[:]+)(?:\[(\d+)\])?:\s*(.*)$"
NGINX_COMMON = r'^(\S+)\s+-\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d+)\s+(\d+|-)'
NGINX_COMBINED = NGINX_COMMON + r'\s+"([^"]*)"\s+"([^"]*)"'
HAPROXY_SIMPLE = r'([^:]+):(\d+)\s+\[([^\]]+)\]\s+(\S+)\s+([^/]+)/(\S+)\s+([\d/\-]+)\s+(\d+)\s+(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+([\d/]+)\s+([\d/]+)\s*(?:"([^"]*)")?'
HAPROXY_SYSLOG = r"(?i)^(?:[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(?:\S+)\s+haproxy\[\d+\]:\s+" + HAPROXY_SIMPLE
HAPROXY_SIMPLE = "^" + HAPROXY_SIMPLE
SEVERITY_WORDS = {
    "critical": ["critical", "fatal", "panic", "emergency"],
    "error": ["error", "fail", "failed", "failure", "refused", "denied", "unable"],
    "warning": ["warn", "warning", "timeout", "retry", "slow"],
    "info": ["info", "accepted", "connected", "started", "success", "ok"],
}
SIGNAL_WORDS = ["error", "fail", "failed", "timeout", "refused", "denied", "warn", "critical"]
# End of fixed values.

TOP = 10


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def group(line: Column, pattern: str, k: int) -> Column:
    """A group of a match, null where it took no part or nothing."""
    return F.nullif(F.regexp_extract(line, pattern, k), F.lit(""))


def word_severity(message: Column) -> Column:
    low, out = F.lower(message), F.lit(None).cast("string")
    for severity, words in reversed(SEVERITY_WORDS.items()):
        out = F.when(contains_any(low, words), severity).otherwise(out)
    return out


def status_severity(status: Column) -> Column:
    return F.when(status >= 500, "error").when(status >= 400, "warning").otherwise("info")


def syslog(rows: DataFrame) -> DataFrame:
    """line_no, ts, source (host), program, pid, message, severity, raw."""
    line = strip(F.col("line"))
    rows = rows.select("line_no", line.alias("raw")).filter(F.col("raw").rlike(SYSLOG))
    g = lambda k: F.regexp_extract("raw", SYSLOG, k)
    out = rows.select("line_no", F.concat_ws(" ", g(1), g(2), g(3)).alias("ts"), g(4).alias("source"), g(5).alias("program"), group(F.col("raw"), SYSLOG, 6).alias("pid"), g(7).alias("message"), "raw")
    return out.withColumn("severity", word_severity(F.col("message")))


def request_parts(request: Column) -> Column:
    return F.filter(F.split(request, r"\s+"), lambda p: p != "")


def nginx(rows: DataFrame) -> DataFrame:
    """line_no, source, ts, method, path, status, bytes, referer, user_agent, message, severity, raw. A common line has neither referer nor user agent; - is null, as bytes 0."""
    rows = rows.select("line_no", strip(F.col("line")).alias("raw")).filter(F.col("raw").rlike(NGINX_COMMON))
    g = lambda k: F.regexp_extract("raw", NGINX_COMMON, k)
    extra = lambda k: F.when(F.col("raw").rlike(NGINX_COMBINED), F.nullif(F.regexp_extract("raw", NGINX_COMBINED, k), F.lit("-")))
    parts = F.col("parts")
    out = rows.select("line_no", g(1).alias("source"), g(3).alias("ts"), request_parts(g(4)).alias("parts"), g(5).try_cast("long").alias("status"), F.when(g(6) == "-", 0).otherwise(g(6).try_cast("long")).alias("bytes"), extra(7).alias("referer"), extra(8).alias("user_agent"), "raw")
    method, path = F.when(F.size(parts) >= 2, parts[0]), F.when(F.size(parts) >= 2, F.get(parts, F.lit(1))).when(F.size(parts) == 1, parts[0])
    out = out.withColumns({"method": method, "path": path}).drop("parts")
    message = F.concat(F.coalesce("method", F.lit("?")), F.lit(" "), F.coalesce("path", F.lit("?")), F.lit(" -> "), F.col("status").cast("string"))
    return out.withColumns({"message": message, "severity": status_severity(F.col("status"))})


def haproxy(rows: DataFrame) -> DataFrame:
    """line_no, source, ts, frontend, backend, server, timings, status, bytes, termination_state, method, path, message, severity, raw."""
    rows = rows.select("line_no", strip(F.col("line")).alias("raw")).withColumn("long", F.col("raw").rlike(HAPROXY_SYSLOG)).filter(F.col("long") | F.col("raw").rlike(HAPROXY_SIMPLE))
    g = lambda k: F.when(F.col("long"), F.regexp_extract("raw", HAPROXY_SYSLOG, k)).otherwise(F.regexp_extract("raw", HAPROXY_SIMPLE, k))
    names = {1: "source", 3: "ts", 4: "frontend", 5: "backend", 6: "server", 7: "timings", 12: "termination_state"}
    out = rows.select("line_no", *[g(k).alias(n) for k, n in names.items()], g(8).try_cast("long").alias("status"), g(9).try_cast("long").alias("bytes"), request_parts(g(15)).alias("parts"), "raw")
    parts, state = F.col("parts"), F.col("termination_state")
    method, path = F.when(F.size(parts) >= 2, parts[0]), F.when(F.size(parts) >= 2, F.get(parts, F.lit(1))).when(F.size(parts) == 1, parts[0])
    ended = F.when((state != "----") & state.rlike("[Cc]"), "warning").when((state != "----") & state.rlike("[Ss]"), "error").otherwise(status_severity(F.col("status")))
    out = out.withColumns({"method": method, "path": path, "severity": ended}).drop("parts")
    route = F.concat("frontend", F.lit("->"), "backend", F.lit("/"), "server", F.lit(" "), F.col("status").cast("string"))
    return out.withColumn("message", F.when(F.col("method").isNotNull() & F.col("path").isNotNull(), F.concat("method", F.lit(" "), "path", F.lit(" "), route)).otherwise(route))


PARSERS = {"syslog": syslog, "nginx": nginx, "haproxy": haproxy}


def parse(rows: DataFrame, kind: str) -> DataFrame:
    return PARSERS[kind](rows)


def redacted(events: DataFrame) -> DataFrame:
    """Every string column redacted, and what that hit per event: ips, tokens, keys, emails, hex_strings."""
    return redact.net_counters(events, sorted(c for c, kind in events.dtypes if kind == "string"))


def redaction_summary(events: DataFrame) -> DataFrame:
    """One row of totals over redacted events."""
    return events.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("emails", "hex_strings", "ips", "keys", "tokens")])


def histogram(events: DataFrame, column: str) -> DataFrame:
    return events.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(column)


def top(events: DataFrame, column: str, k: int = TOP) -> DataFrame:
    """The k most frequent values; of equals, that which came first."""
    counted = events.filter(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))
    return counted.orderBy(F.desc("n"), "first_line").limit(k)


def keyword_hits(events: DataFrame, words: list[str] = SIGNAL_WORDS) -> DataFrame:
    """keyword, n: events whose message has it; words without events are left out."""
    low = F.lower("message")
    wide = events.agg(*[F.count_if(F.contains(low, F.lit(w))).alias(w) for w in words])
    return wide.unpivot([], words, "keyword", "n").filter("n > 0").orderBy("keyword")


def distinct_sources(events: DataFrame) -> DataFrame:
    return events.filter("source <> ''").agg(F.count_distinct("source").alias("unique_sources"))


def diagnose(rows: DataFrame, kind: str, limit: int = 50, redact_events: bool = True) -> DataFrame:
    """One row: line_count, event_count, the first events, redaction totals, and signals as maps.

    One aggregation over grouping sets makes all counts (in all, by severity, by source, by status and path where the kind has them), so lines are parsed and redacted once for these and once for the events that are shown.
    """
    counters = ["emails", "hex_strings", "ips", "keys", "tokens"]
    events = parse(rows, kind)
    if redact_events:
        events = redacted(events)
    else:
        events = events.withColumns({c: F.lit(0).cast("long") for c in counters})
    fields = [c for c in events.columns if c not in counters]
    by = ["severity", "source", *["status", "path"][: 2 * (kind != "syslog")]]
    part, value = F.lit("all"), F.lit(None).cast("string")
    for c in by:
        part, value = F.when(F.grouping(c) == 0, c).otherwise(part), F.when(F.grouping(c) == 0, F.col(c).cast("string")).otherwise(value)
    low = F.lower("message")
    words = [F.count_if(F.contains(low, F.lit(w))).alias(f"word{k}") for k, w in enumerate(SIGNAL_WORDS)]
    sets = events.groupingSets([[F.col(c)] for c in by] + [[]], *[F.col(c) for c in by])
    counted = sets.agg(part.alias("part"), value.alias("value"), F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"), *[F.sum(c).alias(c) for c in counters], *words)

    def of(name: str) -> DataFrame:
        return counted.filter((F.col("part") == name) & F.col("value").isNotNull())

    def as_map(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias(name))

    def first(name: str) -> DataFrame:
        return of(name).filter("value <> ''").orderBy(F.desc("n"), "first_line").limit(TOP)

    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    hits = F.filter(F.array(*[F.struct(F.lit(w).alias("value"), zero(f"word{k}").alias("n")) for k, w in enumerate(SIGNAL_WORDS)]), lambda x: x["n"] > 0)
    totals = counted.filter("part = 'all'").agg(zero("n").alias("event_count"), F.struct(*[zero(c).alias(c) for c in counters]).alias("redaction_summary"), F.map_from_entries(F.array_sort(hits)).alias("keyword_hits"))
    shown = events.orderBy("line_no").limit(limit)
    parts = [
        rows.agg(F.count(F.lit(1)).alias("line_count")),
        totals,
        shown.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("events")),
        as_map(of("severity"), "severity_counts"),
        of("source").filter("value <> ''").agg(F.count(F.lit(1)).alias("unique_sources")),
        as_map(first("source"), "top_sources"),
    ]
    if kind != "syslog":
        parts += [as_map(of("status"), "status_counts"), as_map(first("path"), "top_paths")]
    # Each part is one row: they are put one below the other and drawn together.
    names = [c for p in parts for c in p.columns]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])
