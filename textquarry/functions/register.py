"""SQL names for the scalar functions that are one expression: temporary SQL functions, which Catalyst puts into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from textquarry.functions import catalogs
from textquarry.functions.catalogs import Rule


def sql_chain(column: str, rules: list[Rule]) -> str:
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    for r in rules:
        column = f"regexp_replace({column}, {quoted(r.pattern)}, {quoted(r.replacement)})"
    return column


def register(spark: SparkSession) -> list[str]:
    """Makes redact_policy, redact_net, redact_ops, redact_preview and redact_email for SQL; returns their names."""
    made = {f"redact_{name}": rules for name, rules in catalogs.CATALOGS.items()} | {"redact_email": [Rule("email", catalogs.EMAIL, catalogs.EMAIL_MARK)]}
    for name, rules in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS STRING RETURN {sql_chain('t', rules)}")
    return sorted(made)
