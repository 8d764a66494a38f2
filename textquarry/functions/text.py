"""Small text functions, with Unicode white space and code points where that matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
NO_TIME = "9999-12-31T23:59:59Z"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def universal_lines(text: Column) -> Column:
    """Lines by every line end that Unicode text has; one at the end opens no further line, an empty text has none."""
    parts = F.split(text, LINE_ENDS, -1)
    return F.when(text == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def plain_lines(text: Column) -> Column:
    """Lines by the line feed alone; every line feed parts two lines."""
    return F.split(text, "\n", -1)


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def truncated(text: Column, n: int = 120) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def slug(text: Column, n: int = 50) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, n)


def tags(text: Column) -> Column:
    """Comma-separated tags without blanks and empty ones."""
    return F.filter(F.transform(F.split(text, ",", -1), strip), lambda t: t != "")


def iso_seconds(stamp: Column) -> Column:
    """An ISO time without its fraction, in Z."""
    return F.when(stamp.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), F.concat(F.substring(stamp, 1, 19), F.lit("Z"))).otherwise(stamp)


def sort_time(stamp: Column) -> Column:
    return F.coalesce(iso_seconds(stamp), F.lit(NO_TIME))


def number_range(text: Column) -> Column:
    """42..47 as the numbers from 42 to 47, one number as itself."""
    a, b = F.regexp_extract(text, r"^\s*(\d+)", 1).cast("int"), F.regexp_extract(text, r"\.\.\s*(\d+)\s*$", 1)
    return F.sequence(a, F.when(b == "", a).otherwise(b.cast("int")))


def receipt_id(stamp: Column, commit: Column) -> Column:
    return F.concat_ws("_", F.date_format(stamp, "yyyyMMdd_HHmmss"), F.substring(commit, 1, 7))


def path_hash(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def normalized_extract(text: Column) -> Column:
    """Line ends made one, lines stripped at their ends, runs of blank lines cut to one, one line end at the end; blank texts are empty."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    t = F.array_join(F.transform(F.split(t, "\n", -1), rstrip), "\n")
    t = strip(F.regexp_replace(t, "\n{3,}", "\n\n"))
    return F.when(t == "", "").otherwise(F.concat(t, F.lit("\n")))


def first_difference(a: Column, b: Column) -> Column:
    """Place of the first code point in which two texts differ, the shorter length if one begins the other, -1 if they are equal."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))
    at = F.array_position(pairs, F.lit(False))
    return F.when(a == b, -1).when(at > 0, at - 1).otherwise(F.least(F.char_length(a), F.char_length(b))).cast("int")
