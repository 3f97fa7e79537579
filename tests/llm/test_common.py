"""Shared helpers: lookups with very uneven keys, scratch tables, and what the subpackage registers."""

import random

from pyspark.sql import functions as F

from treeloom.llm import queries
from treeloom.llm.common import fresh, looked_up, shared_dir, written


def test_lookup_with_hot_keys(spark):
    rng = random.Random(1)
    keys = ["hot"] * 3000 + [None] * 900 + [f"k{rng.randrange(200)}" for _ in range(1000)] + ["unknown"] * 5
    big = spark.createDataFrame(list(enumerate(keys)), "id long, key string")
    counts = {k: keys.count(k) for k in set(keys) if k != "unknown"}
    small = spark.createDataFrame([(k, f"v-{k}", n) for k, n in counts.items()], "key string, value string, n long")
    for parts in (4, 1000):
        got = {r["id"]: r["value"] for r in looked_up(big, small, "key", "value", "n", len(keys), "id", parts).collect()}
        assert got == {i: None if k == "unknown" else f"v-{k}" for i, k in enumerate(keys)}


def test_lookup_in_nothing(spark):
    big = spark.createDataFrame([(1, "a")], "id long, key string")
    small = spark.createDataFrame([], "key string, value string, n long")
    assert looked_up(big, small, "key", "value", "n", 1, "id").first()["value"] is None


def test_written_rows_stay(spark):
    drawn = written(spark.range(100).select("id", F.rand().alias("x")), "t")
    assert drawn.collect() == drawn.collect()
    assert drawn.inputFiles()[0].startswith(shared_dir(spark).split(":", 1)[-1]) or shared_dir(spark) in drawn.inputFiles()[0]


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "Size int, size_ int")
    assert fresh("size", df) == "size__" and fresh("other", df) == "other"


def test_queries():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, len(names) + 1)]
    assert all(isinstance(s, str) for s in queries.oracle_sql().values())
    assert set(queries.oracle_sql()) <= set(names)
