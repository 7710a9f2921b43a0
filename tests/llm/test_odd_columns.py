"""Stages and operators on clashing names, empty tables and very long texts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxloom.llm.common import free_name, free_prefix

CLASH = ["_h", "h", "gone_id", "_gone_h", "again", "_found", "found_0", "_before", "_text", "_email", "_term", "_lang_pred", "_lang_score", "key", "id", "class_id", "bands", "hit_id", "ids", "at", "part", "start", "a.b"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{d}/benchmark.parquet")
    long_text = "the and of that with this from a b@c.org " * 30_000
    odd = spark.createDataFrame([(9001, long_text, "en", "s", len(long_text)), (9002, long_text, "en", "s", len(long_text)), (9003, None, None, None, None), (None, "the and of that", "en", None, 15)], docs.schema)
    return d, docs.unionByName(odd).withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASH}).cache()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_columns_with_any_name_pass(spark, folder, name):
    d, docs = folder
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, d)
    if name == "packing":
        assert got.agg(F.count_distinct("doc_id")).head()[0] == docs.agg(F.count_distinct("doc_id")).head()[0]
        return
    assert got.columns == docs.columns
    rows = got.select("doc_id", *(F.col(f"`{c}`") for c in CLASH)).collect()
    assert rows
    for x in rows:
        who = "none" if x["doc_id"] is None else str(x["doc_id"])
        assert list(x)[1:] == [f"{c}:{who}" for c in CLASH]
    ids = {x["doc_id"] for x in rows}
    if name == "near_dedup":
        assert 9001 in ids and 9002 not in ids and 9003 in ids
    if name == "sanitisation":
        assert "@" not in got.where("doc_id = 9001").head()["text"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, folder, name):
    d, docs = folder
    got = dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), d)
    assert got.count() == 0
    if name != "packing":
        assert got.columns == docs.columns


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2)], "_Found int, __found int")
    assert free_name("_found", df) == "___found" and free_prefix("_", df) == "___" and free_name("x", df) == "x"
