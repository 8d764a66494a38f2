"""Exact spans without Python: a text is its gaps (split) and its matches (extract_all), so starts are running sums of lengths in code points.

Patterns must not match the empty string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCERPT = 120


def gaps(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<col_start int, col_end int, hit string>> of all non-overlapping matches, 0-based, end exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<col_start:int,col_end:int,hit:string>>").alias("found"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.char_length(pair["gap"])
        end = begin + F.char_length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(state["found"], F.array(F.struct(begin.alias("col_start"), end.alias("col_end"), pair["hit"].alias("hit")))).alias("found"))

    hits = matches(text, pattern)
    pairs = F.zip_with(F.slice(gaps(text, pattern), F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step)["found"]).otherwise(F.array().cast("array<struct<col_start:int,col_end:int,hit:string>>"))


def overlapping(text: Column, needle: str) -> Column:
    """Spans of a literal, also where they overlap (a search that goes on one character after each start). The text is cut before every occurrence, so the work grows with its length and with the number of occurrences."""
    n, begins = len(needle), "(?=" + re.sub(r"([^\w])", r"\\\1", needle) + ")"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<col_start:int,col_end:int,hit:string>>").alias("found"))

    def step(state: Column, piece: Column) -> Column:
        hit = F.array(F.struct(state["at"].alias("col_start"), (state["at"] + n).alias("col_end"), F.lit(needle).alias("hit")))
        return F.struct((state["at"] + F.char_length(piece["piece"])).alias("at"), F.when(piece["first"] & ~F.startswith(text, F.lit(needle)), state["found"]).otherwise(F.concat(state["found"], hit)).alias("found"))

    pieces = F.transform(F.split(text, begins, -1), lambda p, i: F.struct(p.alias("piece"), (i == 0).alias("first")))
    return F.when(F.contains(text, F.lit(needle)), F.aggregate(pieces, start, step)["found"]).otherwise(F.array().cast("array<struct<col_start:int,col_end:int,hit:string>>"))


def count_literal(text: Column, needle: str) -> Column:
    """How often a literal occurs without overlap."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def replace_where(text: Column, pattern: str, mark: str, valid) -> Column:
    """Matches for which valid(match) holds become mark, others stay."""
    marked = F.transform(matches(text, pattern), lambda h: F.when(valid(h), F.lit(mark)).otherwise(h))
    return F.when(text.rlike(pattern), F.array_join(F.zip_with(gaps(text, pattern), marked, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")).otherwise(text)


def excerpt(line: Column, start: Column, end: Column, width: int = EXCERPT) -> Column:
    """A window of at most width characters around a match, with ... where it is cut; redaction follows on the result. A match longer than width is cropped at its middle."""
    pad = F.floor((F.lit(width) - (end - start)) / 2).cast("int")
    left, n = F.greatest(F.lit(0), start - pad), F.char_length(line)
    right = F.least(n, end + pad, left + width)
    cut = F.when(right > left, F.substring(line, left + 1, right - left)).otherwise("")
    return F.concat(F.when(left > 0, "...").otherwise(""), cut, F.when(right < n, "...").otherwise(""))
