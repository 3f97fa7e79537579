"""Publishing files: what a run writes is seen whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from treeloom.sources.publish import parts_of, publish, published


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, text string").repartition(3)


def seen(spark, root):
    return {r["path"]: r["text"] for r in published(spark, root).collect()}


def test_runs_add_replace_and_take_away(spark, tmp_path):
    root = str(tmp_path / "out")
    assert seen(spark, root) == {}
    publish(files(spark, [("a/b.rs", "one\n"), ("c", "é"), (None, "x"), ("gone", "y")]), root)
    publish(files(spark, [("c", "two"), ("new", ""), ("gone", None), ("never", None)]), root)
    assert seen(spark, root) == {"a/b.rs": "one\n", "c": "two", "new": ""}
    publish(files(spark, [("only", "z")]), root, "overwrite")
    assert seen(spark, root) == {"only": "z"}
    publish(files(spark, [("more", "w")]), root)
    assert seen(spark, root) == {"only": "z", "more": "w"}
    publish(files(spark, []), root)
    assert seen(spark, root) == {"only": "z", "more": "w"}


@pytest.mark.parametrize("mode", ["append", "overwrite"])
def test_a_failing_task_leaves_the_old_tree(spark, tmp_path, mode):
    root = str(tmp_path / "out")
    publish(files(spark, [(f"f{i}", str(i)) for i in range(20)]), root)
    before, held = seen(spark, root), parts_of(root)
    bad = files(spark, [(f"f{i}", "changed") for i in range(50)])
    with pytest.raises(Exception, match="not whole"):
        publish(bad.withColumn("text", F.when(F.col("path") == "f33", F.raise_error(F.lit("not whole"))).otherwise(F.col("text"))), root, mode)
    with pytest.raises(Exception, match="not a path"):
        publish(bad.unionByName(files(spark, [("../out", "x")])), root, mode)
    assert seen(spark, root) == before and parts_of(root) == held
    os.makedirs(f"{root}/run-dead/0/1-1")
    publish(files(spark, [("f0", "last")]), root)
    assert seen(spark, root) == before | {"f0": "last"}
    assert not os.path.exists(f"{root}/run-dead")
