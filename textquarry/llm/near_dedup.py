"""Near-duplicate documents: one-permutation MinHash with optimal densification.

1. Texts become sets of hashed word shingles; texts of equal sets form one class, and one row of it goes on.
2. One hash of each shingle is enough: its high bits choose one of BANDS * ROWS bins, each bin keeps its
   smallest value, and an empty bin takes the value of the first filled bin in an order of its own (optimal
   densification: a fresh random order per empty bin). ROWS bins form a band, a band's values a bucket.
3. In a bucket, candidate edges form a star. First each node is held against one centre, the node of its
   buckets that sits in the largest buckets (as the text does that copies were made from), then against each bucket's. Components of the confirmed links follow; in buckets that still hold several components,
   nodes of the smallest of these become centres, a growing number each round, and are held against
   the bucket's nodes of other components until no bucket has an untried pair across components. So no link
   between candidates is lost, and pairs within a component are never listed. Before that, shingles that
   no other of these nodes has, and what each node shares with its first centre, bound every intersection,
   and nodes and pairs that cannot reach the similarity go.
4. Links are confirmed on the full sets: 100 * intersection >= 80 * union. Sizes that cannot reach that are
   left out beforehand.

With 32 bands of 5 bins a pair of similarity 0.8 is missed with probability 3e-6, one of 0.85 with 7e-9.
Shingle sets are held as 64-bit hashes of position-weighted byte sums (collisions: 2**-57 a pair).

Defined cases: a null or empty text, or one of white space, has no shingles and is linked with nothing; fewer
words than a shingle are one shingle; a null doc_id takes part, and its component's id is the smallest that
is not null (null if there is none); repeated rows are equal texts; an empty table gives none; other columns, of
any name and type, are ignored, and kept by keep_one().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm.common import id_and_text, lists, map_batches, table, without, written
from textquarry.llm.graph import Forest

BANDS, ROWS, PERCENT = 32, 5, 80
#: Rounds in which a bucket's best-known node is its centre; by what factor the number of centres grows after that.
KNOWN_TURNS, GROW = 1, 64
#: Parts of a bucket in which its centres are looked for first, and of a centre's edges.
SALTS = 16
#: Sets of fewer shingles can't be similar to a different set: 4 of 5 is the first 0.8.
LEAST_SHINGLES = 4


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed shingles of size words; ASCII capitals are lowered, words are what ASCII white space parts."""

    def __init__(self, size: int = 4, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.size = size
        self.position = rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.block = rng.integers(1, 1 << 63, 1, dtype=np.uint64)[0] * np.uint64(2)
        self.place = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.white = np.zeros(256, dtype=bool)
        self.white[[0x20, 9, 10, 11, 12, 13]] = True

    def words(self, text: bytes) -> np.ndarray:
        """A 64-bit hash of each word."""
        data = np.frombuffer(text.lower(), dtype=np.uint8)
        inside = ~self.white[data]
        if not inside.any():
            return np.empty(0, dtype=np.uint64)
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        length = ends - starts
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        weight = self.position[at & 4095]
        if length.max() > 4096:
            weight = weight + (at >> 12).astype(np.uint64) * self.block
        return mix(np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * weight, np.cumsum(length) - length))

    def set(self, text: bytes) -> np.ndarray:
        """The sorted distinct shingles."""
        w = self.words(text)
        if not len(w):
            return w
        n = max(1, len(w) - self.size + 1)
        total = np.full(n, np.uint64(min(len(w), self.size)))
        for k in range(min(self.size, len(w))):
            total += w[k : k + n] * self.place[k]
        return np.unique(mix(total))


class Signer:
    """Band hashes of a sorted shingle set."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.edges = np.array([-(-(k << 64) // self.bins) for k in range(1, self.bins)], dtype=np.uint64)
        self.order = np.array([rng.permutation(self.bins) for _ in range(self.bins)])  # in which an empty bin looks for a filled one
        self.place = rng.integers(1, 1 << 63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = rng.integers(1, 1 << 63, bands, dtype=np.uint64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        first = np.concatenate(([0], np.searchsorted(shingles, self.edges)))
        filled = first < np.append(first[1:], len(shingles))
        values = shingles[np.minimum(first, len(shingles) - 1)]
        empty = np.flatnonzero(~filled)
        if len(empty):
            order = self.order[empty]
            values[empty] = values[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
        return values

    def hashes(self, shingles: np.ndarray) -> np.ndarray:
        return mix((mix(self.signature(shingles)).reshape(self.bands, self.rows) * self.place).sum(axis=1, dtype=np.uint64) + self.band).view(np.int64)


def features(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), bands array<long> (null below LEAST_SHINGLES)."""

    def setup():
        shingler, signer = Shingler(size), Signer(bands, rows)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingler.set(t.encode()) for t in batch.column(1).to_pylist()]
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            hashes = [signer.hashes(s) if len(s) >= LEAST_SHINGLES else np.empty(0, dtype=np.int64) for s in sets]
            columns = [batch.column(0), pa.array([len(s) for s in sets], type=pa.int64()), pa.array(digests, type=pa.binary()), lists(np.concatenate(hashes), [len(h) for h in hashes], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "bands"])

        return step

    return map_batches(docs, setup, "doc_id long, n_shingles long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """digest and the full set, shingles array<long>, of each document that has one."""

    def setup():
        shingler = Shingler(size)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            sets = [s for t in batch.column(1).to_pylist() if len(s := shingler.set(t.encode()))]
            if not sets:
                return None
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            return pa.RecordBatch.from_arrays([pa.array(digests, type=pa.binary()), lists(np.concatenate(sets).view(np.int64), [len(s) for s in sets], pa.int64())], names=["digest", "shingles"])

        return step

    return map_batches(docs, setup, "digest binary, shingles array<long>")


def measured(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (a centre, b) with the size of the intersection of the full sets, both, and similar's two sizes. b's set meets the edge first; a centre may have most of the edges, so these meet copies of its set in up to SALTS parts."""
    edges = edges.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    leaf = edges.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    centre = edges.select("a", "part").distinct().join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    return leaf.join(centre, ["a", "part"]).select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("both"), F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"))


def similar(measures: DataFrame, percent: int) -> DataFrame:
    return measures.filter(100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def similar_sizes(n: str, m: str, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def mixed_only(rows: DataFrame) -> DataFrame:
    """rows: h, label and others. Those of buckets that hold several labels."""
    mixed = rows.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("h")
    return rows.join(mixed, "h")


def open_only(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows: h, node and others. Those of buckets that hold several components, with their labels, written. rows are read twice, so they are written first."""
    return written(mixed_only(written(rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")), "mixed")


def shareable(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rows: h, node, n, pivot and others. shared becomes the number of a node's shingles that any other of these nodes or their pivots has: no intersection is larger. Nodes of which that leaves no similarity go."""
    nodes = rows.select("node").unionByName(rows.select(F.col("pivot").alias("node")).filter("node IS NOT NULL")).distinct()
    shingles = sets.join(nodes, "node").select("node", F.explode("shingles").alias("s"))
    alone = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node")).filter("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    rows = rows.drop("shared").join(alone, "node", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    return rows.filter(100 * F.col("shared") >= percent * F.col("n"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept, n_links (confirmed star links of its class), digest (of its set, null if empty), label (a number of its component, null if empty)."""
    docs = id_and_text(docs, id_col, text_col)
    rows_of = written(features(docs, size, bands, rows).withColumn("row", F.monotonically_increasing_id()), "features")
    full = rows_of.filter("digest IS NOT NULL")
    classes = written(full.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n")), "classes")

    banded = full.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), F.col("n_shingles").alias("n"), F.explode("bands").alias("h"))
    shared = banded.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    found = written(banded.join(shared, "h"), "buckets")
    # The texts that copies were made from sit in the largest buckets of all bands: they make the best centres.
    known = found.groupBy("node").agg(F.sum("c").alias("known"))
    buckets = written(found.select("h", "node", "n").join(known, "node"), "known-buckets")
    centre = buckets.groupBy("h").agg(F.max(F.struct("known", (-F.col("node")).alias("a"), F.col("n").alias("m"))).alias("centre"))

    # First round: each node against the best-known centre of its buckets.
    star = buckets.join(centre, "h").filter((F.col("node") != -F.col("centre.a")) & similar_sizes("n", "centre.m", percent))
    star = star.groupBy(F.col("node").alias("b")).agg(F.max("centre").alias("m")).select((-F.col("m.a")).alias("a"), "b")

    # Sets of the nodes that share a bucket, from their texts: found by doc_id, told apart by digest.
    wanted = written(buckets.select("node").distinct().join(classes, "node").select("node", "digest", F.col("least_id").alias("doc_id")), "wanted")
    texts = docs.join(wanted.select("doc_id"), "doc_id", "left_semi").unionByName(docs.filter("doc_id IS NULL"))
    sets = shingle_sets(texts, size).join(wanted.select("digest", "node"), "digest").dropDuplicates(["digest"])
    sets = written(sets.select("node", "shingles"), "sets")

    first_round = written(measured(star, sets), "first-round")
    links = similar(first_round, percent)
    pivots = first_round.select(F.col("b").alias("node"), F.col("a").alias("pivot"), F.col("both").cast("long").alias("inside"))
    places = buckets.groupBy("node").agg(F.collect_set("h").alias("places"))  # as many as bands at most
    # Equal labels mean connected nodes from the first pass on, which is all that the rounds need; components are settled after the last.
    forest, centres, turn = Forest(), 1, 0
    forest.grow(links)
    left = open_only(buckets.withColumn("shared", F.col("n")).join(pivots, "node", "left"), forest.labels())
    while True:
        if turn >= KNOWN_TURNS and not left.isEmpty():
            left = written(mixed_only(written(shareable(left, sets, percent), "shareable")), "shared")
        if left.isEmpty():
            break
        # Nodes of a bucket go by fame at first, later those of the smallest components come first.
        if turn < KNOWN_TURNS:
            left = left.withColumn("place", F.struct((-F.col("known")).alias("k"), "node"))
        else:
            centres *= GROW
            sizes = left.groupBy("h", "label").agg(F.count(F.lit(1)).alias("of_label"))
            left = left.join(sizes, ["h", "label"]).join(places, "node").withColumn("place", F.struct(F.col("of_label").alias("k"), "node"))
        carried = ["h", "node", "n", "known", "shared", "pivot", "inside"]
        ordered = left.select(*carried, "label", "place", *["places"][: turn >= KNOWN_TURNS])
        if turn >= KNOWN_TURNS:
            ordered = written(ordered, "ordered")
        # The centres: a limit of so many a bucket, which Spark applies inside each task before it moves anything; first in SALTS parts of each bucket, so that no task gets those of all tasks of a hot one.
        first = ordered
        for parts in (["h", F.pmod(F.xxhash64("node"), F.lit(SALTS))], ["h"]):
            first = first.withColumn("rank", F.row_number().over(Window.partitionBy(*parts).orderBy("place"))).filter(F.col("rank") <= centres)
        first = written(first.select(F.col("h").alias("at"), F.col("node").alias("a"), F.col("n").alias("m"), F.col("shared").alias("of_a"), F.col("pivot").alias("pivot_a"), F.col("inside").alias("inside_a"), F.col("label").alias("other"), F.col("place").alias("place_a"), *[F.col(c).alias("places_a") for c in ordered.columns if c == "places"]), "centres")
        # Of an intersection, a part is in the pivot of both and a part is not.
        parts = F.least("inside", "inside_a") + F.least(F.col("shared") - F.col("inside"), F.col("of_a") - F.col("inside_a"))
        most = F.when(F.col("pivot") == F.col("pivot_a"), parts).otherwise(F.least("shared", "of_a"))
        # A pair is tried in the first of the buckets that both have.
        once = F.array_min(F.array_intersect("places", "places_a")) == F.col("h") if turn >= KNOWN_TURNS else F.lit(True)
        tried = ordered.join(first, (F.col("h") == F.col("at")) & (F.col("place") > F.col("place_a")) & (F.col("label") != F.col("other")) & (100 * most >= percent * (F.col("n") + F.col("m") - most)) & once)
        new = written(similar(measured(tried.select("a", F.col("node").alias("b")).distinct(), sets), percent), "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            forest.grow(new)
        elif not forest.settled:
            forest.grow()
        untried = ordered.join(first.select(F.col("at").alias("h"), F.col("a").alias("node")), ["h", "node"], "left_anti").select(carried)
        left, turn = open_only(untried, forest.labels()), turn + 1

    forest.settle()
    label = classes.join(forest.labels(), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = label.groupBy("label").agg(F.min("least_id").alias("component_id"))
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    known = written(label.join(least, "label").join(degree, "node", "left").select("digest", "label", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "known")
    out = rows_of.select("doc_id", "n_shingles", "digest").join(known, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "digest", "label")


def keep_one(docs: DataFrame, size: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest doc_id (a null one comes last). Of several rows of that id the text whose set has the smallest digest stays, of rows equal in both that with the most code points, then the first. Texts without shingles stay all."""
    rows = written(near_duplicates(docs, size, percent).filter("digest IS NOT NULL").select(F.col("doc_id").alias("id"), "digest", "label"), "labelled")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")).alias("first"))
    keys = rows.groupBy("id", "digest", "label").agg(F.count(F.lit(1)).alias("times")).join(first, "label")
    some = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest"))
    doubtful = written(keys.select("id", "digest", some.alias("some"), "times").filter("NOT some OR times > 1").drop("times"), "doubtful")
    return without(docs, doubtful, lambda found: set_digests(found, size))


def set_digests(rows: DataFrame, size: int) -> DataFrame:
    """rows: row, id, text. row, id, digest of the text's set (null if empty), n (code points)."""

    def setup():
        shingler = Shingler(size)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(2).to_pylist()
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s := shingler.set(t.encode())) else None for t in texts]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, type=pa.binary()), pa.array(list(map(len, texts)), type=pa.int64())], names=["row", "id", "digest", "n"])

        return step

    return map_batches(rows, setup, "row long, id long, digest binary, n long")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4).drop("digest", "label")
