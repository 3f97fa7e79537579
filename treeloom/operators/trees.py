"""Trees of digests: what differs between two states of a folder tree, and a working tree's status.

A file's id is the SHA-1 of its header and content. A folder's id follows from
its entries, bottom up, a level in each round: every entry's digest is taken as
four numbers, these are summed, and the sums are digested. Sums don't depend on
order, so tasks add up before they shuffle and a folder of any size is a few
rows. Two trees are compared top down, and only folders whose ids differ are
opened, so the work follows the changes and not the trees.

Paths are relative, their parts divided by ``/``; the root is the empty path. A
null content is empty; a path comes once in a tree; an empty tree has a root
without entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators import graph
from treeloom.sources.git import INDEX_FLAGS, WORKTREE_FLAGS

ENTRY = ["path", "parent", "is_dir", "id"]


def blob_id(content: Column) -> Column:
    """The id of a file: the SHA-1 of its size and content."""
    body = F.coalesce(content.cast("binary"), F.lit(b""))
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(body).cast("string")), "utf-8"), F.lit(b"\0"), body))


def parent_of(path: Column) -> Column:
    """The folder that a path lies in; null for the root."""
    return F.when(path == "", None).otherwise(F.regexp_extract(path, "^(?:(.*)/)?[^/]*$", 1))


def folder_id() -> Column:
    """An aggregate over entries (path, is_dir, id): the folder's id."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    entry = F.sha2(F.concat_ws(":", F.col("is_dir").cast("string"), "id", name).cast("binary"), 256)
    words = [F.sum(F.conv(F.substring(entry, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return F.sha1(F.concat_ws(",", F.count("path").cast("string"), *words).cast("binary"))


def tree(files: DataFrame) -> DataFrame:
    """(path, parent, is_dir, id): ``files`` (path, id) with all folders above them and the root."""
    depth = F.size(F.split("path", "/"))
    leaves = graph.settled(files.select("path", "id", depth.alias("depth")))
    most = leaves.agg(F.max("depth")).first()[0] or 0
    entry = lambda df, is_dir: df.select("path", parent_of(F.col("path")).alias("parent"), F.lit(is_dir).alias("is_dir"), "id")
    out = entry(leaves, False)
    folders = leaves.select("path", "id").limit(0)
    for d in range(most, 0, -1):
        level = entry(leaves.where(F.col("depth") == d), False).unionByName(entry(folders, True))
        folders = graph.settled(level.groupBy("parent").agg(folder_id().alias("id")).select(F.col("parent").alias("path"), "id"))
        out = out.unionByName(entry(folders, True))
    if not most:
        root = leaves.sparkSession.range(1).select(F.lit("").alias("path"), F.sha1(F.lit(b"0")).alias("id"))
        out = out.unionByName(entry(root, True))
    return graph.settled(out)


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, is_dir, old_id, new_id) of entries that differ between two trees; a missing side is null.

    Level by level from the root: the entries of the folders that differ are
    compared, and the folders among them that differ are opened next. A path that
    is a file on one side and a folder on the other is two entries.
    """
    side = lambda df, name: df.select("path", "parent", "is_dir", F.col("id").alias(name))
    a, b = side(old, "old_id"), side(new, "new_id")

    def compared(left: DataFrame, right: DataFrame) -> DataFrame:
        joined = left.drop("parent").join(right.drop("parent"), ["path", "is_dir"], "full")
        return graph.settled(joined.where(~F.col("old_id").eqNullSafe(F.col("new_id"))).select("path", "is_dir", "old_id", "new_id"))

    level = compared(a.where("path = ''"), b.where("path = ''"))
    out = level
    while not (opened := level.where("is_dir").select(F.col("path").alias("parent"))).isEmpty():
        level = compared(a.join(opened, "parent", "left_semi"), b.join(opened, "parent", "left_semi"))
        out = out.unionByName(level)
    return out


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, old_path) of files: ``A`` new, ``D`` gone, ``M`` other content, ``R`` gone from ``old_path`` and new here with equal content.

    Of several with equal content, the first gone by path is the first new one.
    """
    found = changed(old, new).where("not is_dir")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("path"))
    gone = found.where("new_id is null").select("path", F.col("old_id").alias("id")).withColumn("nth", nth)
    come = found.where("old_id is null").select("path", F.col("new_id").alias("id")).withColumn("nth", nth)
    pairs = graph.settled(gone.withColumnRenamed("path", "old_path").join(come, ["id", "nth"], "full"))
    same = found.where("old_id is not null and new_id is not null").select("path", F.lit("M").alias("change"), F.lit(None).cast("string").alias("old_path"))
    kind = F.when(F.col("path").isNull(), "D").when(F.col("old_path").isNull(), "A").otherwise("R")
    moved = pairs.select(F.coalesce("path", "old_path").alias("path"), kind.alias("change"), F.when(kind == "R", F.col("old_path")).alias("old_path"))
    return same.unionByName(moved)


def status_entries(head: DataFrame, index: DataFrame, working: DataFrame) -> DataFrame:
    """(path, flags) as :func:`treeloom.operators.history.status` reads them, from three trees.

    What differs between head and index is staged; between index and working
    tree, changed, with new files untracked and moved ones gone and untracked.
    """
    labelled = lambda flags: F.element_at(F.create_map(*[x for k, v in flags.items() for x in (F.lit(k), F.lit(v))]), F.col("change"))
    staged = file_changes(head, index).select("path", labelled(INDEX_FLAGS).alias("flag"))
    found = changed(index, working).where("not is_dir")
    kind = F.when(F.col("old_id").isNull(), "?").when(F.col("new_id").isNull(), "D").otherwise("M")
    later = found.select("path", kind.alias("change")).select("path", labelled(WORKTREE_FLAGS).alias("flag"))
    return staged.unionByName(later).groupBy("path").agg(F.sum("flag").cast("long").alias("flags"))
