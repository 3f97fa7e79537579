"""Whole tables with nulls, repeated rows, very long texts and columns of clashing names, through the queries."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from treeloom.llm import queries

PROSE = " ".join(f"word{i * 7919 % 997}" for i in range(300))
ROWS = [
    (1, PROSE, "en", "web", len(PROSE)), (1, PROSE, "en", "web", len(PROSE)), (2, PROSE + " and more", "en", None, None), (3, None, None, "web", None), (None, None, "fr", None, 0),
    (None, PROSE + "\nits own line, this", "fr", "books", 9), (4, "", "de", "web", 0), (5, "lone " * 60_000, "es", "books", 1), (6, "\n".join(f"line {i} of a text" for i in range(20_000)), "en", "web", 2),
]
EXTRA = "x as key, x as node, x as signals, x as cut_, x as mix_, x as sequence_id, x as digest, x as fingerprint, x as piece"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = {}
    for name, rows in (("odd", ROWS), ("empty", [])):
        place = tmp_path_factory.mktemp(name)
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        docs.selectExpr("*", "'extra' as x").selectExpr("*", *EXTRA.split(", ")).write.parquet(f"{place}/documents.parquet")
        out[name] = str(place)
    return out


@pytest.mark.parametrize("name", ["op4_ngram_jaccard_join", "op7_licence_scan", "op10_quality_rules", "op11_infill", "op12_simhash"])
def test_queries(spark, tables, name):
    found = queries.queries()[name](spark, tables["odd"])
    ids = sorted((r["doc_id"] for r in found.collect()), key=repr)
    assert ids == sorted((r[0] for r in ROWS), key=repr)
    assert queries.queries()[name](spark, tables["empty"]).count() == 0


def test_pipeline(spark, tables):
    found = corpus_pipeline.run(spark, tables["odd"])
    assert {r["doc_id"] for r in found.select("doc_id").collect()} <= {r[0] for r in ROWS}
    assert found.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()
    assert corpus_pipeline.run(spark, tables["empty"]).count() == 0
