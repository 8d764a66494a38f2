"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from textquarry.llm import exact_dedup, near_dedup
from textquarry.llm.common import table
from textquarry.llm.graph import components


def test_exact_query_equals_sql(spark, sf):
    got = sorted(map(tuple, exact_dedup.op4_exact_dedup(spark, sf).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        want = sorted(db.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact_dedup.ORACLE_SQL})").fetchall())
    assert got == want


def test_exact_odd_rows(spark, odd, empty):
    index = exact_dedup.DigestIndex(spark, "odd_index")
    rows = exact_dedup.deduplicate(odd, index).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.text_sha256].append(r)
    white = by[hashlib.sha256(b"").hexdigest()]
    assert len(white) == 4 and {r.keep_id for r in white} == {3} and [r.doc_id for r in white if r.kept] == [3]  # the most code points
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in by.values())
    same = next(g for g in by.values() if {r.doc_id for r in g} == {None, 5})
    assert {r.keep_id for r in same} == {5}  # a null id comes last
    assert exact_dedup.deduplicate(empty, index).count() == 0
    index.drop()


def test_index_persists(spark, make):
    index = exact_dedup.DigestIndex(spark, "persistent_index")
    first = make([(1, "a b"), (2, "c")])
    assert all(r.kept for r in exact_dedup.deduplicate(first, index, "one").collect())
    assert all(r.kept for r in exact_dedup.deduplicate(first, index, "one").collect())  # a batch that is tried again
    second = {r.doc_id: (r.kept, r.keep_id) for r in exact_dedup.deduplicate(make([(3, "ab"), (4, "new"), (5, "n ew")]), index, "two").collect()}
    assert second == {3: (False, 1), 4: (False, 5), 5: (True, 5)}
    assert index.entries().count() == 3
    index.drop()


def test_keep_first_keeps_columns(spark, odd):
    index = exact_dedup.DigestIndex(spark, "keep_index")
    kept = exact_dedup.keep_first(odd, index)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == sorted([(3, 4), (4, len(odd.filter("doc_id = 4").first().text)), (5, 10), (6, 1), (7, 8), (8, 30_000)])
    index.drop()


def awkward(spark, rows):
    """Rows of doc_id and text with a map and names that the operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["some", "every", "all", "__id", "__n", "__bits", "__bucket", "row", "doc", "id", "digest", "n", "best", "of", "mark", "label", "a.b"]
    return df.selectExpr("map('k', doc_id) AS m", *[f"1 AS `{c}`" for c in names], "*")


def test_keep_first_on_awkward_columns(spark):
    rows = [(1, "a b"), (1, "ab"), (1, "ab"), (2, None), (2, "   "), (2, ""), (3, "x y"), (3, "z"), (None, "xy"), (None, "n ull"), (None, "null"), (4, "null")]
    index = exact_dedup.DigestIndex(spark, "awkward_index")
    docs = awkward(spark, rows)
    kept = exact_dedup.keep_first(docs, index)
    assert kept.columns == docs.columns and kept.schema["m"].dataType == docs.schema["m"].dataType
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, "a b"), (2, "   "), (3, "x y"), (3, "z"), (None, "n ull")], key=str)
    index.drop()


def test_keep_one_on_awkward_columns(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(5, base), (5, base + " x"), (5, "some other text of its own"), (6, base + " y"), (None, base), (None, "nobody has this text"), (None, "nobody has this text"), (None, "nobody has this text either at all, no"), (7, ""), (8, None), (9, "again again"), (9, "again  again")]
    docs = awkward(spark, rows)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len([t for _, t in got if t and t.startswith("w0 ")]) == 1 and [i for i, t in got if t and t.startswith("w0 ")] == [5]
    rest = sorted(((i, t) for i, t in got if not (t and t.startswith("w0 "))), key=str)
    assert rest == sorted([(5, "some other text of its own"), (None, "nobody has this text"), (None, "nobody has this text either at all, no"), (7, ""), (8, None), (9, "again  again")], key=str)


def test_rows_parted_by_id(spark):
    from textquarry.llm.common import parted_by_id

    docs, ids = spark.range(2000).selectExpr("IF(id = 1, NULL, id * 7 - 900) AS doc_id", "'x' AS text"), spark.range(300).selectExpr("IF(id = 1, NULL, id * 7 - 900) AS id")
    clear, others = parted_by_id(docs, ids)
    wanted = {r.id for r in ids.collect()}
    assert not wanted & {r.doc_id for r in clear.collect()} and clear.count() + others.count() == 2000 and others.count() < 310
    for bits in (1 << 5, 1 << 16):  # a filter that is too full sends more rows through the join, and loses none
        clear, others = parted_by_id(docs, ids, bits)
        assert wanted <= {r.doc_id for r in others.collect()} and clear.count() + others.count() == 2000


def shingles(text, size):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, size):
    """Smallest doc_id reachable, by all pairs that share a shingle."""
    sets = {i: shingles(t, size) for i, t in rows}
    inverted, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in inverted[s])
        for j, k in shared.items():
            if 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            inverted[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.op3_near_dedup(spark, sf).collect()}
    assert got == brute(rows, 4)


def test_near_groups_of_edited_copies(spark, make):
    """Copies of one text with one to four words changed: many pairs lie about the border."""
    rng = random.Random(3)
    rows, k = [], 0
    for group in range(4):
        base = [f"w{group}_{rng.randint(0, 200)}" for _ in range(rng.choice([30, 60, 120]))]
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 30)}"
            rows.append((k, " ".join(copy)))
            k += 1
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(make(rows), size=4).collect()}
    assert got == brute(rows, 4)


def test_near_odd_rows(spark, odd, empty):
    rows = near_dedup.near_duplicates(odd).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert [(r.component_id, r.kept) for r in rows if r.doc_id == 4] == [(4, True)] * 2
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in rows if r.n_shingles == 1 and r.doc_id in (5, None)) == [("5", 5, True), ("None", 5, False)]
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_one(odd).columns == odd.columns


def test_a_bucket_of_many_components(spark, make, monkeypatch):
    """Texts that share a long passage, too unlike to be linked, and copies of some: every round has something to do."""
    monkeypatch.setattr(near_dedup, "GROW", 2)
    rng = random.Random(9)
    common, rows = [f"c{k}" for k in range(70)], []
    for k in range(60):
        own = common + [f"o{k}_{j}" for j in range(20)]
        rows.append((k, " ".join(own)))
        if k % 6 == 0:
            own[rng.randrange(70, 90)] = "z"
            rows.append((1000 + k, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(make(rows), size=4).collect()}
    assert got == brute(rows, 4)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(k, k + 1) for k in range(500, 560)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_signatures_estimate_similarity():
    signer, rng = near_dedup.Signer(), np.random.default_rng(1)
    for n, shared in ((8, 7), (200, 180), (1000, 500)):
        hits = []
        for _ in range(200):
            x = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64) * np.uint64(2)
            hits.append((signer.signature(np.sort(x[:n])) == signer.signature(np.sort(x[n - shared :]))).mean())
        assert abs(np.mean(hits) - shared / (2 * n - shared)) < 0.03
