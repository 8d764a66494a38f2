"""Redaction: chains of replacements, counts by stage, phones with a validator, previews."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import catalogs, spans
from textquarry.functions.catalogs import Rule


def chain(text: Column, rules: Iterable[Rule], mark: str | None = None) -> Column:
    """Each rule on what the one before made; mark replaces the rules' own replacements."""
    return reduce(lambda t, r: F.regexp_replace(t, F.lit(r.pattern), F.lit(r.replacement if mark is None else mark)), rules, text)


def named(rules: Iterable[Rule], names: Iterable[str]) -> list[Rule]:
    names = set(names)
    return [r for r in rules if r.name in names]


def redact_policy(text: Column) -> Column:
    return chain(text, catalogs.POLICY)


def redact_net(text: Column) -> Column:
    return chain(text, catalogs.NET)


def redact_ops(text: Column, mark: str | None = None) -> Column:
    return chain(text, catalogs.OPS, mark)


def redact_tokens(text: Column) -> Column:
    return chain(text, named(catalogs.OPS, catalogs.OPS_TOKENS))


def redact_ips(text: Column) -> Column:
    return chain(text, named(catalogs.OPS, catalogs.OPS_IPS))


def redact_uuids(text: Column) -> Column:
    return chain(text, named(catalogs.OPS, ["uuid"]))


def redact_preview(text: Column) -> Column:
    return chain(text, catalogs.PREVIEW)


def redact_emails(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(catalogs.EMAIL), F.lit(catalogs.EMAIL_MARK))


def valid_phone(candidate: Column) -> Column:
    """Ten digits, or seven with a parenthesis, a plus or a separator between digits."""
    digits = F.char_length(F.regexp_replace(candidate, F.lit(r"(?U)[^\d]"), F.lit("")))
    return (digits >= 10) | ((digits >= 7) & candidate.rlike(r"(?U)[(+]|\d[\s.\-]\d"))


def redact_phones(text: Column) -> Column:
    return spans.replace_where(text, catalogs.PHONE_CANDIDATE, catalogs.PHONE_MARK, valid_phone)


def redact_pii(text: Column) -> Column:
    """E-mail addresses, then phone numbers."""
    return redact_phones(redact_emails(text))


def count_ops(text: Column) -> Column:
    """Matches of every ops rule on the text as it is; overlaps count under each rule."""
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(r.pattern)) for r in catalogs.OPS])


def staged(df: DataFrame, column: str, rules: list[Rule]) -> DataFrame:
    """df with column redacted and a column hits_<rule> for each rule: its matches in what the rules before left. A stage is a projection of its own, so nothing is worked out twice: a rule with a plain replacement splits the text once, which gives both; one that repeats groups is run again only where it has matches."""
    for r in rules:
        hits = f"hits_{r.name}"
        if "$" in r.replacement or "\\" in r.replacement:
            df = df.withColumn(hits, F.regexp_count(F.col(column), F.lit(r.pattern)))
            df = df.withColumn(column, F.when(F.col(hits) > 0, F.regexp_replace(column, F.lit(r.pattern), F.lit(r.replacement))).otherwise(F.col(column)))
        else:
            df = df.withColumn("_parts", F.split(column, r.pattern, -1))
            df = df.withColumns({hits: F.when(F.col("_parts").isNotNull(), F.size("_parts") - 1), column: F.array_join("_parts", r.replacement)}).drop("_parts")
    return df


def net_counters(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns redacted by the net rules, and ips, tokens, keys, emails, hex_strings summed over them per row. A rule takes two projections for all columns: one splits, one joins and counts."""
    names, given = ["ips", "tokens", "keys", "emails", "hex_strings"], df.columns
    df = df.select(*[F.col(f"`{c}`") for c in given], *[F.lit(0).cast("long").alias(n) for n in names])
    for r in catalogs.NET:
        parts = {c: f"_parts_{k}" for k, c in enumerate(columns)}
        df = df.select("*", *[F.split(F.col(f"`{c}`"), r.pattern, -1).alias(p) for c, p in parts.items()])
        hits = reduce(lambda x, y: x + y, [F.coalesce(F.when(F.col(p).isNotNull(), F.size(p) - 1), F.lit(0)) for p in parts.values()])
        made = [F.array_join(parts[c], r.replacement).alias(c) if c in parts else F.col(f"`{c}`") for c in given]
        df = df.select(*made, *[(F.col(n) + hits).alias(n) if n == catalogs.NET_COUNTER[r.name] else F.col(n) for n in names])
    return df


def preview(df: DataFrame, column: str) -> DataFrame:
    """df with column redacted, original_length, redacted_length, redactions_applied and redaction_types (catalog order)."""
    rules = catalogs.PREVIEW
    df = staged(df.withColumn("original_length", F.char_length(column)), column, rules)
    hits = [F.col(f"hits_{r.name}") for r in rules]
    types = F.filter(F.array(*[F.when(h > 0, F.lit(r.name)) for r, h in zip(rules, hits, strict=True)]), lambda x: x.isNotNull())
    df = df.withColumns({"redacted_length": F.char_length(column), "redactions_applied": reduce(lambda a, b: a + b, hits), "redaction_types": types})
    return df.drop(*[f"hits_{r.name}" for r in rules])
