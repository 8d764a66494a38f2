"""Each stage of the pipeline against what it has to do, on the smallest tables and planted rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textquarry.llm import pii, toxicity
from textquarry.llm.common import crc_mod, table


def test_stages_follow_each_other(spark, sf):
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "pii", "packing"]
    packed = corpus_pipeline.run(spark, sf)
    assert set(r.doc_id for r in packed.select("doc_id").distinct().collect()) <= set(r.doc_id for r in docs.select("doc_id").collect())
    assert packed.filter("length > 4096 OR offset <> 0").count() == 0


def test_decisions(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, table(spark, sf, "labels"), crc_mod(F.col("doc_id"), 3) != 1)
    bad = {r.doc_id for r in toxicity.score(docs, model).filter("predicted = 1").collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, sf).cache()
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - bad
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 3
    rows = [(10_001, base + "a"), (10_002, base + "  a"), (10_003, base + "b"), (10_004, "mail me at a.b@mail.example.com or 10.1.2.3"), (10_005, None)]
    more = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], docs.schema)
    exact = corpus_pipeline.drop_exact_copies(spark, more, sf)
    assert exact.columns == docs.columns and sorted(r.doc_id for r in exact.collect()) == [10_002, 10_003, 10_004, 10_005]
    near = corpus_pipeline.drop_near_copies(spark, exact, sf)
    assert near.columns == docs.columns and sorted(r.doc_id for r in near.collect()) == [10_002, 10_004, 10_005]
    redacted = {r.doc_id: r for r in pii.redact_documents(near, pii.fit(docs)).collect()}
    assert redacted[10_004].text == "mail me at [EMAIL] or [IP]" and redacted[10_004].n_chars == 26 and redacted[10_005].text is None


def test_release(spark, sf):
    from textquarry.llm import common

    df = common.written(spark.range(3), "three")
    assert df.count() == 3
    path = common._scratch[-1]
    common.release(spark)
    assert not common._scratch
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
