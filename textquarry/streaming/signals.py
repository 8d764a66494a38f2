"""Streams of log lines: the stateless operators as they are, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import redact
from textquarry.operators.logs import word_severity


def redacted_stream(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.withColumn(column, redact.redact_net(F.col(column)))


def severity_windows(lines: DataFrame, time: str = "ts", column: str = "line", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Lines by window and severity; lines later than the watermark are dropped, state older than it goes."""
    severity = F.coalesce(word_severity(F.col(column)), F.lit("none"))
    return lines.withWatermark(time, late).groupBy(F.window(time, size), severity.alias("severity")).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "severity", "n")


def sessions(lines: DataFrame, key: str | Column, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of lines of a key without a gap."""
    return lines.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count(F.lit(1)).alias("n"))
