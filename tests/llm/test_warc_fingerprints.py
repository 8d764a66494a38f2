"""Archives and fingerprints: round trips and brute force."""

import hashlib
import struct

import duckdb
import numpy as np
import pytest
import zstandard

from textquarry.llm import fingerprints, warc
from textquarry.llm.common import table


def test_warc_query_equals_sql(spark, sf):
    got = sorted(map(tuple, warc.op8_warc(spark, sf).collect()), key=str)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
        assert got == sorted(db.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.ORACLE_SQL})").fetchall(), key=str)


@pytest.fixture(scope="module")
def pages(spark):
    big, small = "<p>é</p>" * 40, "<p>x</p>"
    rows = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (None, "u", big), (1, "again", big), (8, "u", "WARC/1.1\r\n\r\n" * 50_000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "1 AS digest", "2 AS n")


def test_archives_round_trip(pages):
    archives = warc.write_archives(pages, archive_bytes=2000)
    rows = warc.read_archives(archives).collect()
    assert len(rows) == 10
    for r in rows:
        if r.record_type == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest and len(r.payload) == r.payload_bytes
    by = sorted(((r.page_id, r.record_type, r.refers_to) for r in rows), key=str)
    assert by == sorted([(1, "response", None), (1, "response", None), (2, "revisit", 1), (3, "revisit", 1), (None, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None)], key=str)
    assert {r.payload_bytes for r in rows if r.record_type == "revisit"} == {360}


def test_archive_format(pages, tmp_path):
    archives = warc.write_archives(pages)
    row = max(archives.collect(), key=lambda r: r.n_records)
    magic, n = struct.unpack_from("<II", row.content)
    assert magic == warc.DICTIONARY_MAGIC and len(row.offsets) == row.n_records
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(bytes(row.content[8 : 8 + n])))
    for at in row.offsets:  # each record is a frame of its own
        assert zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(bytes(row.content[at:])).startswith(b"WARC/1.1\r\n")
    names = warc.export(archives, str(tmp_path / "out"))
    assert len(names) == archives.count() and sum(1 for f in names for _ in warc.read_archive((tmp_path / "out" / f).read_bytes())) == 10


def test_no_pages(pages):
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_damage_is_noticed(spark, pages):
    content = bytearray(max(warc.write_archives(pages).collect(), key=lambda r: r.n_records).content)
    content[-20] ^= 1
    with pytest.raises(Exception, match=r"."):
        list(warc.read_archive(bytes(content)))


def test_differences_equal_sets():
    rng = np.random.default_rng(1)
    a = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 5, 40, 400, 3000, 20)]
    b = [np.unique(np.concatenate((x[: len(x) // 2], rng.integers(0, 1 << 63, m, dtype=np.uint64)))) for x, m in zip(a, (0, 1, 3, 40, 10, 3000, 0), strict=True)]
    only_a, only_b = fingerprints.differences(a, b)
    for x, y, p, q in zip(a, b, only_a, only_b, strict=True):
        assert set(p.tolist()) == set(x.tolist()) - set(y.tolist()) and set(q.tolist()) == set(y.tolist()) - set(x.tolist())
    jaccard = [len(set(x) & set(y)) / len(set(x) | set(y)) if len(x) + len(y) else 1.0 for x, y in ((x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True))]
    assert np.allclose(fingerprints.likeness(a, b), jaccard)


def test_repeated_paragraphs_count():
    one, two = fingerprints.digests("same line\n"), fingerprints.digests("same line\nsame line\n")
    assert len(one) == 1 and len(two) == 2 and set(one.tolist()) < set(two.tolist())
    assert len(fingerprints.digests("")) == 0


def held(rows, result):
    """rows in the order of ids; the query against a plain loop."""
    by = {r.doc_id: r for r in result}
    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = by[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        for other, likeness in ((changed, r.near_edited), (following, r.near_next)):
            x, y = set(fingerprints.digests(text).tolist()), set(fingerprints.digests(other).tolist())
            assert abs(likeness - (len(x & y) / len(x | y) if x | y else 1.0)) < 1e-12


def test_fingerprint_query(spark, sf, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 30)  # several ranges
    rows = sorted((r.doc_id, r.text or "") for r in table(spark, sf, "documents").collect())
    result = fingerprints.op9_fingerprints(spark, sf).collect()
    assert len(result) == len(rows)
    held(rows, result)
    texts = dict(rows)
    same = {}
    for r in result:
        assert same.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_published_fingerprints_compare(spark, sf):
    """Where published fingerprints can be peeled, their likeness is that of the whole texts; small changes of long texts can."""
    rows = fingerprints.op9_fingerprints(spark, sf).collect()
    given = [(fingerprints.compare(r.fingerprint, r.edited_fingerprint), r.near_edited) for r in rows]
    assert all(x is None or abs(x - y) < 1e-12 for x, y in given) and any(x is not None and x < 1 for x, _ in given)
    text = "".join(f"sentence number {k} of a long text. " for k in range(2000))
    one, two = (fingerprints.sketch([fingerprints.digests(t)]).text(0, len(fingerprints.digests(t))) for t in (text, text.replace("number 77 ", "number x ")))
    assert fingerprints.compare(one, one) == 1 and fingerprints.compare(one, two) == 2000 / 2002  # 2,001 pieces, of which one differs
    assert fingerprints.compare(one, fingerprints.sketch([fingerprints.digests("")]).text(0, 0)) is None


def test_fingerprint_odd_rows(odd, empty, make):
    rows = fingerprints.fingerprint_changes(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.fingerprint_changes(empty).count() == 0
    one = fingerprints.fingerprint_changes(make([(1, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
    held([(1, "a. b. c"), (5, ""), (9, "a. b. d")], fingerprints.fingerprint_changes(make([(9, "a. b. d"), (5, None), (1, "a. b. c")])).collect())
