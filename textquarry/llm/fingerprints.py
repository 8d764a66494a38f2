"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text is a set of paragraph cells: its lines, cut at sentence ends and after UNIT characters, each with the
number of its occurrence (so repeated paragraphs count). A sketch of m cells holds in each cell the number
of digests hashed there, their sum and the sum of their check values. Subtracting two versions' sketches
cancels what they share; peeling cells that hold a single digest recovers the digests that differ. Where that
stops early, both sides are sketched again with four times the cells. The likeness is the Jaccard index that follows
from the number of digests that differ. The published fingerprint is the sketch of CELLS cells: compare() gives the likeness
of two published ones where they differ little enough to be peeled, and nothing else where not; the likenesses of the
query come from the same cells, and from larger sketches of the texts where these fail.

The next document comes from ranges of doc_id: each range is sorted in one task, and the rows of a range's first id
are also sent to the range before. All rows of one id (and all without one) are in one range. There are MAX_RANGES at most, as
their bounds are literals of the plan; beyond RANGE_ROWS * MAX_RANGES rows ranges grow, and Spark sorts them with spilling.

Defined cases: a null or empty text has no cells; two empty texts are equal (likeness 1); null ids come first;
rows of equal id are ordered by a hash of the text; a single document is its own next; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.common import bounded_batches, id_and_text, table

UNIT, CELLS, HASHES, GROW = 64, 24, 3, 4
PARAGRAPH = re.compile(r"[^\n.!?]{1,%d}[.!?]*" % UNIT)
RANGE_ROWS, MAX_RANGES = 2000, 16_384
#: Multipliers of the digests' cells and check values.
CELL_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
CHECK_KEY = np.uint64(0xD6E8FEB86659FD93)
HALF = (1 << 32) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(text: str) -> np.ndarray:
    """Sorted distinct digests of a text's paragraph cells."""
    import xxhash

    of = xxhash.xxh3_64_intdigest
    d = np.sort(np.fromiter((of(p) for p in PARAGRAPH.findall(text)), dtype=np.uint64))
    if len(d) > 1:
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        if len(first) < len(d):
            times = np.arange(len(d)) - np.repeat(first, np.diff(np.append(first, len(d))))
            d = np.unique(mix(d + times.astype(np.uint64) * CHECK_KEY))
        else:
            d = np.sort(mix(d))
    elif len(d):
        d = mix(d)
    return d


class Sketches:
    """Sketches of many texts with m cells each, as matrices of a row per text."""

    def __init__(self, rows: int, m: int, mask: int = (1 << 64) - 1):
        """mask: the bits of the sums of check values that count."""
        self.m, self.mask = m, np.uint64(mask)
        self.count, self.keys, self.checks = np.zeros(rows * m, dtype=np.int64), np.zeros(rows * m, dtype=np.uint64), np.zeros(rows * m, dtype=np.uint64)

    def add(self, row: np.ndarray, key: np.ndarray, sign: np.ndarray | int) -> None:
        """Adds key sign times to its cells of row."""
        check, third = mix(key ^ CHECK_KEY), self.m // HASHES
        times = np.broadcast_to(np.asarray(sign, dtype=np.int64), key.shape)
        by = times.view(np.uint64) if times.flags.c_contiguous else np.ascontiguousarray(times).view(np.uint64)
        for h in range(HASHES):
            at = row * self.m + h * third + (mix(key * CELL_KEYS[h]) % np.uint64(third)).astype(np.int64)
            np.add.at(self.count, at, times)
            np.add.at(self.keys, at, key * by)
            np.add.at(self.checks, at, check * by)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, digests and signs that come out, all rows at once; cells that stay filled mark rows that failed."""
        found = []
        live = np.flatnonzero(np.abs(self.count) == 1)
        while len(live):
            sign = self.count[live]
            key = self.keys[live] * sign.view(np.uint64)
            pure = (mix(key ^ CHECK_KEY) * sign.view(np.uint64) ^ self.checks[live]) & self.mask == 0
            row, key, sign = live[pure] // self.m, key[pure], sign[pure]
            if not len(row):
                break
            order = np.lexsort((key, row))
            row, key, sign = row[order], key[order], sign[order]
            once = np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))
            row, key, sign = row[once], key[once], sign[once]
            self.add(row, key, -sign)
            found.append((row, key, sign))
            live = np.flatnonzero(np.abs(self.count) == 1)
        if not found:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def failed(self) -> np.ndarray:
        return ((self.count != 0) | (self.keys != 0) | (self.checks & self.mask != 0)).reshape(-1, self.m).any(axis=1)

    def text(self, row: int, n: int) -> str:
        """The sketch of one row, of n digests, in base 64; of the sums of check values the lower halves, which add and subtract like the whole."""
        cut = slice(row * self.m, (row + 1) * self.m)
        return base64.b64encode(np.int64(n).astype("<i8").tobytes() + self.count[cut].astype("<i4").tobytes() + self.keys[cut].astype("<u8").tobytes() + (self.checks[cut] & np.uint64(HALF)).astype("<u4").tobytes()).decode()


def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)


def sketch(sets: list[np.ndarray], m: int = CELLS) -> Sketches:
    out = Sketches(len(sets), m)
    out.add(*flat(sets), 1)
    return out


def differences(a: list[np.ndarray], b: list[np.ndarray], m: int = CELLS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each pair the digests that only a's set has, and only b's, by subtraction and peeling; what fails is tried again with GROW times the cells."""
    only_a: list = [None] * len(a)
    only_b: list = [None] * len(a)
    todo = np.arange(len(a))
    while len(todo):
        s = Sketches(len(todo), m)
        s.add(*flat([a[k] for k in todo]), 1)
        s.add(*flat([b[k] for k in todo]), -1)
        row, key, sign = s.peel()
        failed = s.failed()
        order = np.argsort(row, kind="stable")
        row, key, sign = row[order], key[order], sign[order]
        edges = np.searchsorted(row, np.arange(len(todo) + 1))
        for k in np.flatnonzero(~failed):
            keys, signs = key[edges[k] : edges[k + 1]], sign[edges[k] : edges[k + 1]]
            only_a[todo[k]], only_b[todo[k]] = keys[signs > 0], keys[signs < 0]
        todo, m = todo[failed], m * GROW
    return only_a, only_b


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> list[float]:
    only_a, only_b = differences(a, b)
    apart = [len(x) + len(y) for x, y in zip(only_a, only_b, strict=True)]
    return [(len(x) + len(y) - d) / (len(x) + len(y) + d) if len(x) + len(y) + d else 1.0 for x, y, d in zip(a, b, apart, strict=True)]


def compare(a: str, b: str) -> float | None:
    """The likeness of the texts of two published fingerprints, by subtracting and peeling them; None where too many digests differ for their cells."""
    parts = []
    for raw in map(base64.b64decode, (a, b)):
        m = (len(raw) - 8) // 16
        parts.append((int.from_bytes(raw[:8], "little"), np.frombuffer(raw, "<i4", m, 8).astype(np.int64), np.frombuffer(raw, "<u8", m, 8 + 4 * m), np.frombuffer(raw, "<u4", m, 8 + 12 * m).astype(np.uint64)))
    (n, *of_a), (k, *of_b) = parts
    s = Sketches(1, len(of_a[0]), HALF)
    s.count, s.keys, s.checks = (x - y for x, y in zip(of_a, of_b, strict=True))
    apart = len(s.peel()[1])
    if s.failed()[0]:
        return None
    return (n + k - apart) / (n + k + apart) if n + k + apart else 1.0


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_changes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row per document."""
    docs = id_and_text(docs, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    n = docs.count()
    many = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    side = max(1, int(np.ceil(np.sqrt(many))))
    cuts = sorted(set(docs.approxQuantile("key", [k / many for k in range(1, many)], 0.2 / many))) if many > 1 else []
    cuts = [int(c) for c in cuts]
    # Two steps of searching: which block of cuts, then which cut of the block.
    blocks = [cuts[k : k + side] for k in range(0, len(cuts), side)]
    long_array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    if blocks:
        block = F.greatest(F.size(F.filter(long_array([b[0] for b in blocks]), lambda c: c <= F.col("key"))) - 1, F.lit(0))
        inside = F.size(F.filter(F.element_at(F.array(*[long_array(b) for b in blocks]), block + 1), lambda c: c <= F.col("key")))
        docs = docs.withColumn("range", (block * side + inside).cast("int"))
    else:
        docs = docs.withColumn("range", F.lit(0))
    heads = sorted((r["range"], r["head"]) for r in docs.groupBy("range").agg(F.min("key").alias("head")).collect())  # a row per range, MAX_RANGES at most
    before = {heads[k][0]: heads[k - 1][0] for k in range(len(heads))}
    if heads:
        of = {r: h for r, h in heads}
        everything = range(max(of) + 1)
        is_head = F.col("key") == F.element_at(long_array([of.get(r, 0) for r in everything]), F.col("range") + 1)
        previous = F.element_at(F.array(*[F.lit(before.get(r, -1)) for r in everything]), F.col("range") + 1)
        places = F.when(is_head, F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")), F.struct(previous.alias("range"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest"))))
    else:
        places = F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("guest")))
    rows = docs.withColumn("place", F.explode(places)).select("place.range", "place.guest", "key", "doc_id", "text")
    rows = rows.repartition("range").sortWithinPartitions("range", "guest", "key", F.xxhash64("text")).select("range", "guest", "doc_id", "text")
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def results(pairs: list[tuple]) -> pa.RecordBatch:
        """pairs: (doc_id, text, its digests, next text, its digests)."""
        changed = [edited(text, following) for _, text, _, following, _ in pairs]
        own, new, after = [p[2] for p in pairs], [digests(t) for t in changed], [p[4] for p in pairs]
        s, e = sketch(own), sketch(new)
        columns = [[p[0] for p in pairs], [len(p[1]) for p in pairs], [hashlib.sha256(t.encode()).hexdigest() for t in changed], [s.text(k, len(x)) for k, x in enumerate(own)], [e.text(k, len(x)) for k, x in enumerate(new)], likeness(own, new), likeness(own, after)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (range, doc_id, text, digests) that waits for its next
        for batch in batches:
            pairs = []
            for r, guest, doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                now = (r, doc, text, digests(text))
                if last is not None and last[0] == r:
                    pairs.append((*last[1:], text, now[3]))
                last = None if guest else now  # a range's first guest ends it
            if pairs:
                yield results(pairs)

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_changes(table(spark, sf_dir, "documents"))
