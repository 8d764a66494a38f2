"""Dictionaries against texts: injection, counting, redaction, previews, and hashes of their entries."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import spans
from textquarry.functions.text import collapse

#: Tokens inside which nothing is replaced.
RESERVED = r"\[[A-Z0-9_]+\]"
CONTEXT = 20


def key_order(keys: Iterable[str]) -> list[str]:
    """Longest first, then by code points."""
    return sorted(keys, key=lambda k: (-len(k), k))


def inject(text: Column, mapping: dict[str, str]) -> Column:
    """Literal, case-sensitive replacement key by key, outside of reserved tokens as they stand at each key; later keys may match in what earlier ones made."""

    def one(acc: Column, key: str) -> Column:
        outside = F.zip_with(spans.gaps(acc, RESERVED), spans.matches(acc, RESERVED), lambda g, t: F.concat(F.replace(g, F.lit(key), F.lit(mapping[key])), F.coalesce(t, F.lit(""))))
        return F.when(F.contains(acc, F.lit(key)), F.array_join(outside, "")).otherwise(acc)

    return reduce(one, [k for k in key_order(mapping) if k], text)


def meta(name: str, mapping: dict[str, str], target: str = "input", mode: str = "replace") -> dict:
    return {"source": name.rsplit("/", 1)[-1], "rules_count": len(mapping), "target": target, "mode": mode}


def match_set(terms: Iterable[str]) -> dict[str, str]:
    """Folded term -> its first spelling; blanks around are cut, empty terms left out."""
    out: dict[str, str] = {}
    for t in terms:
        t = t.strip()
        if t:
            out.setdefault(t.casefold(), t)
    return out


def bounded(term: str, fold: bool = True) -> str:
    """A term that no letter, digit or underscore of ASCII touches, in Java's dialect."""
    return ("(?iu)" if fold else "") + r"(?<![a-zA-Z0-9_])" + re.sub(r"([^\w\s])", r"\\\1", term) + r"(?![a-zA-Z0-9_])"


def count_terms(docs: DataFrame, terms: Iterable[str], column: str = "text", fold: bool = True) -> DataFrame:
    """term, occurrences, documents over all texts, each term on its own (nested terms count too). Terms are literals of one projection; texts that hold none are left out before."""
    known = match_set(terms)
    found = [F.struct(F.lit(original).alias("term"), F.regexp_count(column, F.lit(bounded(term, fold))).alias("n")) for term, original in sorted(known.items())]
    rows = docs.select(F.explode(F.array(*found)).alias("x")).filter("x.n > 0")
    return rows.groupBy("x.term").agg(F.sum("x.n").alias("occurrences"), F.count(F.lit(1)).alias("documents"))


def totals(counted: DataFrame, total_entries: int) -> DataFrame:
    return counted.agg(F.lit(total_entries).alias("total_entries"), F.count(F.lit(1)).alias("matched_terms"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("total_occurrences"))


def redact(text: Column, terms: Iterable[str], pack_id: str, fold: bool = True) -> Column:
    """Each term, longest first, becomes [[LEXICON:pack]]; a later term may match inside an earlier mark."""
    mark = f"[[LEXICON:{pack_id}]]".replace("\\", r"\\").replace("$", r"\$")
    return reduce(lambda t, term: F.regexp_replace(t, F.lit(bounded(term, fold)), F.lit(mark)), key_order(match_set(terms)), text)


def previews(docs: DataFrame, terms: Iterable[str], pack_id: str, limit: int = 10, id_col: str = "doc_id", column: str = "text", fold: bool = True) -> DataFrame:
    """id, term, original, redacted, context: a text's first hit of each term, for its first limit terms in folded order; 20 characters on either side, white space collapsed, ... where it is cut."""
    known = match_set(terms)
    text = F.col(column)
    found = []
    for k, (term, original) in enumerate(sorted(known.items())):
        p = bounded(term, fold)
        hit, start = F.regexp_extract(text, p, 0), F.char_length(F.split(text, p, 2)[0])
        found.append(F.when(text.rlike(p), F.struct(F.lit(k).alias("order"), F.lit(original).alias("term"), hit.alias("original"), start.alias("begin"))))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.explode(F.slice(F.filter(F.array(*found), lambda x: x.isNotNull()), 1, limit)).alias("x"))
    begin, end, n = F.col("x.begin"), F.col("x.begin") + F.char_length("x.original"), F.char_length("t")
    left, right = F.greatest(F.lit(0), begin - CONTEXT), F.least(n, end + CONTEXT)
    context = F.concat(F.when(left > 0, "...").otherwise(""), collapse(F.substring("t", left + 1, right - left)), F.when(right < n, "...").otherwise(""))
    return rows.select("id", "x.order", "x.term", "x.original", F.lit(f"[[LEXICON:{pack_id}]]").alias("redacted"), context.alias("context"))


def compact_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def pretty_json(value) -> str:
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def sha256(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def entries_sha256(entries: list[dict]) -> str:
    """Of the entries in file order."""
    return sha256(compact_json(entries))


def normalized_sha256(entries: list[dict]) -> str:
    """Of the entries by folded term, term and category."""
    return sha256(compact_json(sorted(entries, key=lambda e: (e.get("term", "").casefold(), e.get("term", ""), e.get("category", "")))))


def fields_signature(names: list[str]) -> str:
    return sha256("|".join(names))


def entries_hash(rows: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """One row, entries_sha256 of a table of entries: fields (in alphabetical order inside an entry) as compact JSON, rows by the columns in order. For lexicons, which fit a row."""
    entry = F.struct(*[F.coalesce(f, F.lit("")).alias(f) for f in sorted(fields)])
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], entry.alias("entry")))), lambda x: x["entry"])
    return rows.agg(F.sha2(F.to_json(listed), 256).alias("entries_sha256"))
