import itertools
import random
import re

from pyspark.sql import functions as F

from textquarry.operators import clean, lexicon, tables


def normalized(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return [r.normalized for r in tables.normalize(df).orderBy("id").collect()]


def test_pipe_tables(spark):
    got = normalized(spark, ["x\n| Name | Mail |\n|---|---|\n| A | a@b |\n\n| B | c |\nend", "| only | header |\n|---|---|", "a | | c\nd | e | f", "plain"])
    assert got[0] == "x\nRow 1: Name=A, Mail=a@b\nRow 2: Name=B, Mail=c\nend"
    assert got[1] == "| only | header |\n|---|---|"
    assert got[2] == "Row 1: a=d, Col2=e, c=f"
    assert got[3] == "plain"


def test_delimited_tables(spark):
    got = normalized(spark, ["H,K\n1,2\n3,4\n5,6,7\nend", "a, b\nalone", "H\tK\n1\t2", "a,b,c\nd,e\nf,g\nh,i,j", "Row 1: a=b, c=d\nx,y", ",b\n1,2"])
    assert got[0] == "Row 1: H=1, K=2\nRow 2: H=3, K=4\nend"  # the ragged tail is dropped
    assert got[1] == "a, b\nalone"
    assert got[2] == "Row 1: H=1, K=2"
    assert got[3] == "a,b,c\nRow 1: d=f, e=g"
    assert got[4] == "Row 1: a=b, c=d\nx,y"
    assert got[5] == ",b\n1,2"


def test_repeated_and_null_ids_do_not_mix(spark):
    rows = [(1, "a,b\nc,d\n1,2"), (1, "x,y\nz,w\n3,4"), (None, "k,l\n5,6"), (None, "plain"), (2, None), (1, "a,b\nc,d\n1,2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = "Row 1: a=c, b=d\nRow 2: a=1, b=2", "Row 1: x=z, y=w\nRow 2: x=3, y=4"
    got = sorted(((r.id, r.normalized) for r in tables.normalize(df).collect()), key=str)
    assert got == sorted([(1, one), (1, two), (1, one), (None, "Row 1: k=5, l=6"), (None, "plain")], key=str)
    cleaned = sorted(((r.id, r.redacted, r.normalized) for r in clean.clean(df, normalize=True).collect()), key=str)
    assert cleaned == sorted([(1, rows[0][1], one), (1, rows[1][1], two), (1, rows[0][1], one), (None, rows[2][1], "Row 1: k=5, l=6"), (None, "plain", "plain"), (2, None, None)], key=str)


def plain_commas(text):
    """The pass over comma tables as a loop over lines."""
    lines, out, k = text.split("\n"), [], 0
    cells = [[c.strip() for c in x.strip().split(",")] for x in lines]
    member = ["," in x and sum(c != "" for c in cs) >= 2 and not re.match(r"Row \d+:", x.strip()) and not re.search(r"\w+=\S+,\s*\w+=", x.strip()) for x, cs in zip(lines, cells, strict=True)]
    while k < len(lines):
        if not member[k]:
            out.append(lines[k])
            k += 1
            continue
        end = next((j for j in range(k, len(lines)) if not member[j]), len(lines))
        head = next((j for j in range(k, end - 1) if len(cells[j]) == len(cells[j + 1])), None)
        if head is None:
            out += lines[k:end]
        else:
            out += lines[k:head]
            for n, row in enumerate(itertools.takewhile(lambda r, h=head: len(r) == len(cells[h]), cells[head + 1 : end]), 1):
                out.append(f"Row {n}: " + ", ".join(f"{h or f'Col{i}'}={c}" for i, (h, c) in enumerate(zip(cells[head], row, strict=True), 1)))
        k = end
    return "\n".join(out)


def test_comma_tables_equal_a_plain_loop(spark):
    rng = random.Random(2)
    texts = ["\n".join(",".join(rng.choice(["", "a", "b c", "1"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    assert normalized(spark, texts) == [plain_commas(t) for t in texts]


def test_injection(spark):
    df = spark.createDataFrame([("Visit NYC and New York, [NYC_X] is a New place",)], "t string")
    assert df.select(lexicon.inject(F.col("t"), {"New York": "NY", "New": "Old", "NYC": "New York City"})).first()[0] == "Visit Old York City and NY, [NYC_X] is a Old place"


def test_counts_and_redaction(spark):
    df = spark.createDataFrame([(0, "Cape Coast Castle near Cape Coast; capecoast_ CAPE COAST"), (1, "Accra"), (2, None)], "doc_id long, text string")
    got = {r.term: (r.occurrences, r.documents) for r in lexicon.count_terms(df, ["Cape Coast", "Cape Coast Castle", "Accra", " accra ", "Volta"]).collect()}
    assert got == {"Cape Coast": (3, 1), "Cape Coast Castle": (1, 1), "Accra": (1, 1)}
    assert df.select(lexicon.redact(F.col("text"), ["Cape Coast", "Cape Coast Castle"], "gh")).first()[0] == "[[LEXICON:gh]] near [[LEXICON:gh]]; capecoast_ [[LEXICON:gh]]"


def test_preview(spark):
    df = spark.createDataFrame([(0, "x" * 30 + " The  Volta\nlake " + "y" * 30)], "doc_id long, text string")
    row = lexicon.previews(df, ["volta", "none"], "p").first()
    assert (row.original, row.redacted) == ("Volta", "[[LEXICON:p]]") and row.context.startswith("...x") and " The Volta lake y" in row.context and row.context.endswith("y...")


def test_hashes(spark):
    entries = [{"term": "b", "category": "x"}, {"term": "A", "category": "y"}]
    assert lexicon.entries_sha256(entries) != lexicon.entries_sha256(entries[::-1])
    assert lexicon.normalized_sha256(entries) == lexicon.normalized_sha256(entries[::-1])
    df = spark.createDataFrame([(0, "b", "x"), (1, "A", "y")], "n int, term string, category string")
    assert lexicon.entries_hash(df, ["n"], ["term", "category"]).first()[0] == lexicon.entries_sha256(entries)


def test_clean_targets(spark):
    df = spark.createDataFrame([(0, "Name,Mail\nNYC,a@b.co")], "doc_id long, text string")
    row = clean.clean(df, normalize=True, mapping={"NYC": "New York"}, target="normalized").first()
    assert row.redacted == "Name,Mail\nNYC,[EMAIL_REDACTED]" and row.normalized == "Row 1: Name=New York, Mail=[EMAIL_REDACTED]"
