import json

import pytest
from pyspark.sql import functions as F

from textquarry.functions import text
from textquarry.operators import evidence
from textquarry.plans import queries
from textquarry.sources import files


def test_integrity_and_orphans(spark):
    items = spark.createDataFrame([("a/x", "1"), ("a/y", "2"), ("a/z", "3"), ("a/w", "4")], "path string, sha256 string")
    side = spark.createDataFrame([("a/x", "1", "x"), ("a/y", "9", "a/y"), ("a/w", "4", "q")], "target string, sha256 string, stored_path string")
    assert {r.path: r.status for r in evidence.integrity(items, side).collect()} == {"a/x": "ok", "a/y": "mismatch", "a/z": "missing", "a/w": "wrong_path"}
    assert [r.path for r in evidence.orphans(items, side.select(F.col("target").alias("path")), "path").collect()] == ["a/z"]


def test_drift(spark):
    a = spark.createDataFrame([("p", "1"), ("q", "2"), ("r", "3")], "path string, sha256 string")
    b = spark.createDataFrame([("q", "2"), ("r", "9"), ("s", "1")], "path string, sha256 string")
    assert {r.path: r.status for r in evidence.drift(a, b).collect()} == {"p": "only_left", "r": "changed", "s": "only_right"}


def test_text_helpers(spark):
    df = spark.createDataFrame([("  Hello, World!  ",)], "t string")
    got = df.select(text.slug(F.col("t")), text.strip(F.col("t")), text.number_range(F.lit("42..44")), text.number_range(F.lit("7")), text.iso_seconds(F.lit("2024-01-02T03:04:05.67+00:00")), text.sort_time(F.lit(None).cast("string")), text.normalized_extract(F.lit("a \r\nb\n\n\n\nc\n")), text.tags(F.lit("a, ,b"))).first()
    assert list(got) == ["hello-world", "Hello, World!", [42, 43, 44], [7], "2024-01-02T03:04:05Z", text.NO_TIME, "a\nb\n\nc\n", ["a", "b"]]


def test_text_functions_of_whole_texts(spark, tmp_path):
    body = " a ,b\n\n" * 100 + ", last tag "
    spark.createDataFrame([(1, body)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    row = queries.text_functions(spark, str(tmp_path)).first()
    assert row.tags == "|".join(["a"] + [x.strip() for x in body.split(",")[1:]])
    assert row.tags.endswith("last tag") and row.collapsed == " ".join(body.split()) and len(row.collapsed) > 300


def test_first_difference_of_whole_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "RANGE_ROWS", 4)
    head = "x" * 60
    docs = [(k, None if k % 11 == 0 else f"s{k % 3 % 2}", None if k == 20 else head + "é😀"[: k % 3] + str(k % 4)) for k in range(50)]
    spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for source in {s for _, s, _ in docs}:
        own = [d for d in docs if d[1] == source]
        for (k, _, a), (_, _, b) in zip(own, own[1:]):
            if b is not None:
                want[k] = len(b) if a is None else -1 if a == b else next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert any(v >= 60 for v in want.values())
    got = queries.first_difference(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.doc_id: r["at"] for r in got} == want


def test_path_decisions(spark, tmp_path):
    df = spark.createDataFrame([("/d/a.txt",), ("/d/../x",), ("/d/k.pem",), ("/e/a",), ("/d/.git/config",), ("/d/.env.local",)], "p string")
    got = [tuple(r[0]) for r in df.select(files.path_decision(F.col("p"), ["/d"])).collect()]
    assert got == [(True, None), (False, "traversal_detected"), (False, "blocked_pattern"), (False, "outside_allowed_roots"), (False, "blocked_pattern"), (False, "blocked_pattern")]
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / ".env").write_text("s")
    listed, more = files.list_dir(str(tmp_path), [str(tmp_path)])
    assert [(e["name"], e["accessible"]) for e in listed] == [(".env", False), ("a.txt", True)] and not more


def test_tree_glob():
    import re

    assert re.match(files.tree_glob("**/*.py"), "a/b/c.py") and re.match(files.tree_glob("**/*.py"), "c.py") and not re.match(files.tree_glob("*.py"), "a/c.py")


def test_bounded_reads_and_search(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"caf\xe9 one\ntwo one")
    (tmp_path / "a.txt").write_text("né one" * 3)
    (tmp_path / "c.log").write_text("one")
    rows = files.files(spark, str(tmp_path), ["txt"], max_bytes=12).orderBy("file").collect()
    assert [(r.text, r.truncated) for r in rows] == [("né onené o", True), ("café one\ntwo", True)]
    hits = files.search(files.files(spark, str(tmp_path), ["txt"]), "one").collect()
    assert [(r.line, r.begin) for r in hits] == [(1, 3), (1, 9), (1, 15), (1, 5), (2, 4)]
    part = spark.createDataFrame([(bytearray(b"0123456789"),)], "c binary").select(files.ranged(F.col("c"), 8, 5), files.ranged(F.col("c"), 20)).first()
    assert tuple(part[0]) == ("89", 2, False) and part[1].bytes_read == 0


def pack(tmp_path, **changes):
    fields = [{"name": "term", "type": "string", "required": True}, {"name": "notes", "type": "string", "required": False}]
    data = {"schema_version": "1.0.0", "pack_id": "p-1", "name": "n", "description": "d", "license": "l", "language": "en", "entry_format": "csv", "entries_path": "entries.csv", "fields": fields, "created_at_utc": "2024-01-01T00:00:00Z", "source_attribution": [{"name": "s"}]} | changes
    tmp_path.mkdir(exist_ok=True)
    (tmp_path / "pack.json").write_text(json.dumps(data))
    (tmp_path / "entries.csv").write_text("term,notes\nalpha,x\nbeta,\n")
    return str(tmp_path)


def test_packs_and_locks(tmp_path):
    folder = pack(tmp_path / "p")
    assert files.load_pack(folder)[1:] == ([{"term": "alpha", "notes": "x"}, {"term": "beta", "notes": ""}], [])
    assert files.verify_lock(folder)
    files.write_lock(folder, "2024-01-01T00:00:00Z")
    assert files.verify_lock(folder) == []
    (tmp_path / "p/entries.csv").write_text("term,notes\nbeta,\nalpha,x\n")
    assert [e.split(":")[0] for e in files.verify_lock(folder)] == ["entries_sha256"]
    pack(tmp_path / "q", extra=1)
    assert [d["errors"] for d in files.discover(str(tmp_path))][1] == ["unknown key: extra"]
    assert [n for n, _ in files.verify_all(str(tmp_path), fail_fast=True)] == ["p"]


def test_policies_from_a_file(tmp_path):
    p = {"id": "B", "title": "t", "severity": "low", "type": "contains", "needle": "x", "description": "d"}
    f = tmp_path / "p.json"
    f.write_text(json.dumps({"schema_version": "1.0", "policies": [p, p | {"id": "A"}]}))
    assert [x.id for x in files.load_policies(str(f))] == ["A", "B"]
    f.write_text(json.dumps({"schema_version": "2"}))
    with pytest.raises(ValueError, match="schema_version"):
        files.load_policies(str(f))


def test_receipts(tmp_path):
    paths = files.write_receipt(str(tmp_path), "r", {"b": 1, "a": "é"})
    assert paths[1].read_text() == '{"a":"é","b":1}' and paths[2].read_text().endswith("  r.canonical.json\n")


def test_logs_receipts_and_targets(spark):
    from textquarry.operators import evidence

    text = evidence.log_header() + "| 2024-01-02 | c | ok | high | s | `a/x.canonical.json` |\n| 2024-01-02 | c | ok | high | s | - |\n| VL-20240101-7 | a | b | c | d | e |\n| 2024-01-02 | four | columns | only |\n| 2024-01-03 | c | ok | high | s | `b/x.canonical.json` |\n"
    rows = evidence.log_rows(spark.createDataFrame([(1, text), (None, None), (2, "| 2024-01-02 | no | rule | before | it | `a/x` |")], "doc_id long, text string"))
    assert [(r.id, r.line, r.kind, r.receipt) for r in rows.orderBy("line").collect()] == [(1, 7, "standard", "a/x.canonical.json"), (1, 8, "standard", None), (1, 9, "legacy", None), (1, 11, "standard", "b/x.canonical.json")]
    cells = evidence.pipe_rows(spark.createDataFrame([(1, text)], "doc_id long, text string"), 4).collect()
    assert [(r.n, r.cells) for r in cells] == [(9, ["2024-01-02", "four", "columns", "only"])]
    there = spark.createDataFrame([("b/x.canonical.json",)], "path string")
    assert [(r.line, r.error) for r in evidence.receipt_errors(rows, there, "a/").orderBy("line").collect()] == [(7, "not found"), (8, "no receipt"), (11, "another folder")]
    sides = spark.createDataFrame([("e/a.sha256", "e/a"), ("e/b.sha256", "b"), ("e/c.sha256", "x/b"), ("f/b.sha256", "b"), ("b.sha256", "b")], "sidecar_path string, target string")
    gone = evidence.missing_targets(sides, spark.createDataFrame([("e/a",), ("e/b",)], "path string"))
    assert sorted(r.sidecar_path for r in gone.collect()) == ["b.sha256", "f/b.sha256"]


def test_packs_gates_and_reads(tmp_path):
    import json

    import pytest

    from textquarry.sources import files, trees

    rule = {"id": "X1", "title": "t", "severity": "low", "type": "contains", "needle": "n", "description": "d"}
    (tmp_path / "own.v1.json").write_text(json.dumps({"schema_version": "1.0", "policies": [rule]}))
    (tmp_path / ".hidden.json").write_text("{}")
    assert files.policy_packs(str(tmp_path)) == ["own.v1", "pii.v1", "secrets.v1"]
    assert [p.id for p in files.policy_pack("own.v1", str(tmp_path))] == ["X1"] and files.policy_pack("pii.v1")
    for bad in ("../own", ".x", "", "none"):
        with pytest.raises(ValueError, match="pack"):
            files.policy_pack(bad, str(tmp_path))
    (tmp_path / "p").mkdir()
    (tmp_path / "p/pack.json").write_text("{}")
    assert files.lock_gate(str(tmp_path)) == [{"path": "p", "problems": ["pack.lock.json is missing"]}]
    (tmp_path / "r.txt").write_bytes(b"0123456789")
    assert files.read_range(str(tmp_path / "r.txt"), [str(tmp_path)], 2, 3) == {"content": "234", "bytes_read": 3, "offset": 2, "truncated": True}
    assert files.read_range(str(tmp_path / "r.txt"), [str(tmp_path)], 20) == {"content": "", "bytes_read": 0, "offset": 20, "truncated": False}
    with pytest.raises(PermissionError, match="outside"):
        files.read_range(str(tmp_path / "r.txt"), [str(tmp_path / "p")])
    assert trees.merge_receipt({"state": "MERGED", "number": 3, "other": 1}) == {"number": 3, "state": "MERGED"}
    with pytest.raises(ValueError, match="OPEN"):
        trees.merge_receipt({"state": "OPEN"})
    (tmp_path / "f").write_text("")
    assert trees.source_folder_errors(str(tmp_path), ["./p", "./f", "./none", "../x"]) == [("./f", "no folder"), ("./none", "not found"), ("../x", "leaves the tree")]


def test_audit_and_paths(spark, tmp_path):
    from pyspark.sql import functions as F

    from textquarry.functions.text import path_hash
    from textquarry.sources import files, trees

    entries = [files.read_audit("/a/b.txt", 5, False, "T"), files.list_audit("/a", 3, True, "T"), files.search_audit("/a", 1, 9, "T"), files.denied_audit("read_file", "/x/.env", "blocked_pattern", "T")]
    files.append_audit(spark.createDataFrame(entries, files.AUDIT_SCHEMA), str(tmp_path / "log"))
    files.append_audit(spark.createDataFrame(entries[:1], files.AUDIT_SCHEMA), str(tmp_path / "log"))
    rows = spark.read.json(str(tmp_path / "log")).collect()
    assert len(rows) == 5 and {r.path for r in rows} == {"b.txt", "a", ".env"} and sum(not r.success for r in rows) == 1
    want = spark.range(1).select(path_hash(F.lit("/a/b.txt"))).first()[0]
    assert want in {r.path_hash for r in rows}
    df = spark.createDataFrame([("/r/a/b", "good-name"), ("/ra/b", "BadName"), ("/r", None)], "p string, n string")
    assert [r[0] for r in df.select(trees.relative_to(F.col("p"), "/r/")).collect()] == ["a/b", "/ra/b", "/r"]
    assert [len(r[0]) for r in df.select(trees.name_warnings(F.col("n"))).collect()] == [0, 1, 1]


def test_logs_of_any_length(spark, tmp_path):
    import duckdb
    from pyspark.sql import functions as F

    from textquarry.operators import evidence
    from textquarry.plans import queries
    from textquarry.plans.oracles import LOG_RECEIPTS

    # One nation has nearly all customers; some have no nation, name or number, or a name that would end a cell or a line.
    odd = F.when(F.col("id") % 101 == 1, None).when(F.col("id") % 103 == 1, "a | b\n| c").otherwise(F.concat(F.lit("C"), F.col("id").cast("string")))
    nation = F.when(F.col("id") % 50 == 7, None).when(F.col("id") % 50 == 8, 4).otherwise(3).cast("int")
    number = F.when(F.col("id") % 997 == 0, None).otherwise(F.col("id") * 5 + F.col("id") % 3)
    spark.range(9000).select(number.alias("c_custkey"), odd.alias("c_name"), nation.alias("c_nationkey"), F.when(F.col("id") % 7 > 0, "M").alias("c_mktsegment")).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    key = lambda r: tuple((v is not None, v) for v in r)
    want, found = con.sql(LOG_RECEIPTS).fetchall(), queries.log_receipts(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key) and len(want) > 7000
    assert "collect_list" not in found._jdf.queryExecution().toString()

    lines = queries.log_lines(spark, str(tmp_path)).filter("doc_id = 4")
    text = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    rows = evidence.log_rows(text)
    assert sorted(map(tuple, rows.collect()), key=key) == sorted(map(tuple, evidence.log_line_rows(lines).collect()), key=key)


def test_a_log_is_not_copied_to_its_lines(spark):
    import re

    from textquarry.operators import evidence

    docs = spark.createDataFrame([(1, "| no rule |"), (2, evidence.log_header()), (3, "|---|\n| 2024-01-02 | `x` |")], "doc_id long, text string")
    rows = evidence.log_rows(docs, columns=2)
    assert [tuple(r) for r in rows.collect()] == [(3, 2, "standard", "x")]
    kept = re.findall(r", \[([^\[\]]*)\], (?:true|false), \[\w+#", rows._jdf.queryExecution().executedPlan().toString())
    assert kept and all("text" not in k for k in kept)


def test_receipts_that_are_not_looked_up(spark):
    from textquarry.operators import evidence

    rows = spark.createDataFrame([(1, 8, "legacy", None), (None, 9, "standard", "a/x.canonical.json"), (1, 10, "standard", None), (1, 11, "standard", "a/y.canonical.json"), (1, 12, "standard", "b/y.canonical.json"), (1, 13, "standard", "a/y.json")], "id long, line long, kind string, receipt string")
    there = spark.createDataFrame([("a/y.canonical.json",), ("a/y.canonical.json",), ("b/y.canonical.json",), ("1:8",), (None,)], "path string")
    got = {r.line: r.error for r in evidence.with_receipt_errors(rows, there, "a/").collect()}
    assert got == {8: None, 9: "not found", 10: "no receipt", 11: None, 12: "another folder", 13: "another ending"}
    assert evidence.receipt_errors(rows, there, "a/").count() == 4
