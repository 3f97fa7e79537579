"""Trees of digests against plain Python over the leaves."""

import hashlib
import random

from pyspark.sql import functions as F

from treeloom.operators import history, trees
from treeloom.sources.git import INDEX_FLAGS, WORKTREE_FLAGS


def made(spark, files):
    return trees.tree(spark.createDataFrame(sorted(files.items()), "path string, body string").select("path", trees.blob_id(F.col("body")).alias("id")))


def random_files(rng):
    names = ["a", "b", "c.rs", "d.md", "é"]
    return {"/".join([rng.choice(names) + "_" for _ in range(rng.randrange(4))] + [rng.choice(names)]): rng.choice(["", "x", "y", "same", None]) for _ in range(70)}


def edited(rng, files):
    out = dict(files)
    for p in rng.sample(sorted(out), 12):
        match rng.randrange(4):
            case 0:
                del out[p]
            case 1:
                out[p] = "other"
            case 2:
                out[p + ".moved"] = out.pop(p)
            case 3:
                out[f"new_/{p}"] = f"new {p}"
    return out


def plain_changes(old, new):
    gone, come = ({p: (t or "") for p, t in a.items() if p not in b} for a, b in ((old, new), (new, old)))
    out = [(p, "M", None) for p in old if p in new and (old[p] or "") != (new[p] or "")]
    for body in {*gone.values(), *come.values()}:
        d, a = (sorted(p for p, t in side.items() if t == body) for side in (gone, come))
        out += [(n, "R", o) for o, n in zip(d, a)] + [(p, "D", None) for p in d[len(a) :]] + [(p, "A", None) for p in a[len(d) :]]
    return sorted(out, key=repr)


def test_ids_are_those_of_git(spark):
    rows = spark.createDataFrame([("hello\n",), ("",), (None,)], "t string").select(trees.blob_id(F.col("t")).alias("id")).collect()
    assert [r["id"] for r in rows] == ["ce013625030ba8dba906f756967f9e9ca394464a"] + ["e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"] * 2


def test_changes_and_status(spark):
    rng = random.Random(3)
    head = random_files(rng)
    index = edited(rng, head)
    working = edited(rng, index)
    three = [made(spark, x) for x in (head, index, working)]
    got = sorted(map(tuple, trees.file_changes(three[0], three[1]).collect()), key=repr)
    assert got == plain_changes(head, index)
    want = {}
    for p, kind, _ in plain_changes(head, index):
        want[p] = want.get(p, 0) + INDEX_FLAGS[kind]
    for p in {*index, *working}:
        a, b = (None if p not in x else x[p] or "" for x in (index, working))
        if a != b:
            want[p] = want.get(p, 0) + WORKTREE_FLAGS["?" if a is None else "D" if b is None else "M"]
    entries = trees.status_entries(*three)
    assert {r["path"]: r["flags"] for r in entries.collect()} == want
    assert {r["path"] for r in history.status(entries).collect()} == set(want)


def test_unchanged_folders_stay_closed(spark):
    """One file of 2,000 differs: the folders on its way are opened, and no other."""
    files = {f"top{i % 20}/mid{i % 100}/f{i}": str(i) for i in range(2000)}
    one = made(spark, files)
    other = made(spark, files | {"top3/mid3/f3": "changed"})
    assert sorted(r["path"] for r in trees.changed(one, other).collect()) == ["", "top3", "top3/mid3", "top3/mid3/f3"]
    assert trees.changed(one, one).count() == 0
    assert one.where("is_dir").count() == 1 + 20 + 100


def test_empty_and_turned_trees(spark):
    none, one = made(spark, {}), made(spark, {"a": "x"})
    assert none.count() == 1
    assert [tuple(r) for r in trees.file_changes(none, one).collect()] == [("a", "A", None)]
    assert [tuple(r) for r in trees.file_changes(one, none).collect()] == [("a", "D", None)]
    turned = trees.file_changes(made(spark, {"a": "x", "b": "y"}), made(spark, {"a/b": "z", "b": "y"}))
    assert sorted(map(tuple, turned.collect())) == [("a", "D", None), ("a/b", "A", None)]
    assert hashlib.sha1(b"blob 0\0").hexdigest().startswith("e69de29")
