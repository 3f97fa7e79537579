"""Commits, blame and notes of files and symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import text
from treeloom.operators import aggregates, intervals
from treeloom.sources.git import CONFLICTED, INDEX_FLAGS, NO_COMMIT, WORKTREE_FLAGS

#: What status flags are called, the first that is set counts.
STAGED = {INDEX_FLAGS["A"]: "new file", INDEX_FLAGS["M"]: "modified", INDEX_FLAGS["D"]: "deleted", INDEX_FLAGS["R"]: "renamed", INDEX_FLAGS["T"]: "typechange"}
CHANGED = {WORKTREE_FLAGS["M"]: "modified", WORKTREE_FLAGS["D"]: "deleted", WORKTREE_FLAGS["R"]: "renamed", WORKTREE_FLAGS["T"]: "typechange"}


def shown(commits: DataFrame) -> DataFrame:
    """(hash, author, date, message, epoch_secs, walk_idx) as views show commits: seven digits, first line."""
    return commits.select(
        F.substring("hash", 1, 7).alias("hash"), F.coalesce("author", F.lit("unknown")).alias("author"), text.utc_date(F.col("epoch_secs")).alias("date"),
        text.first_line(F.col("message")).alias("message"), "epoch_secs", "walk_idx",
    )


def touching(commits: DataFrame, changes: DataFrame, path: str, limit: int) -> DataFrame:
    """The newest ``limit`` commits that changed ``path``, among those the walk examines."""
    hit = changes.where(F.col("path") == path).select("hash").distinct()
    examined = commits.where(F.col("walk_idx") < aggregates.EXAMINED)
    return examined.join(hit, "hash", "left_semi").orderBy("walk_idx").limit(limit)


def symbol_log(commits: DataFrame, changes: DataFrame, path: str, first: int, last: int, limit: int) -> DataFrame:
    """The newest commits one of whose hunks meets the symbol's current lines."""
    spans = commits.sparkSession.createDataFrame([(path, first, last)], "path string, start_line long, end_line long")
    hit = intervals.touching_commits(changes, spans, "path").select("hash").distinct()
    examined = commits.where(F.col("walk_idx") < aggregates.EXAMINED)
    return examined.join(hit, "hash", "left_semi").orderBy("walk_idx").limit(limit)


def contributors(commits: DataFrame, changes: DataFrame, path: str) -> DataFrame:
    """(author, commits), most first, among the newest commits of a file; ties by name."""
    return aggregates.contributors(touching(commits, changes, path, aggregates.LIMITS["contributors"]), "author")


def notes(commits: DataFrame, changes: DataFrame, notes_: DataFrame, path: str) -> DataFrame:
    """(hash, note) of the newest commits of a file that have one."""
    newest = touching(commits, changes, path, aggregates.LIMITS["notes"])
    return newest.join(notes_, "hash").orderBy("walk_idx").select("hash", "note")


def with_note(notes_: DataFrame, newest: Column, note: str) -> DataFrame:
    """The notes after setting one on the commit ``newest``; blank text removes it."""
    rest = notes_.where(F.col("hash") != newest)
    if not note.strip():
        return rest
    one = notes_.sparkSession.range(1).select(newest.alias("hash"), F.lit(note).alias("note"))
    return rest.unionByName(one)


def blame(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """(path, start_line, end_line, hash, author, date, message); lines not committed yet say so."""
    known = commits.select("hash", F.coalesce("author", F.lit("unknown")).alias("author"), text.utc_date(F.col("epoch_secs")).alias("date"), text.first_line(F.col("message")).alias("message"))
    named = rows.join(known, "hash", "left")
    new = F.col("hash") == NO_COMMIT
    return named.select(
        "path", "start_line", "end_line", F.when(new, "uncommitted").otherwise(F.substring("hash", 1, 7)).alias("hash"), F.when(new, "you").otherwise(F.col("author")).alias("author"),
        F.when(new, "-").otherwise(F.col("date")).alias("date"), F.when(new, "").otherwise(F.col("message")).alias("message"),
    )


def symbol_blame(rows: DataFrame, first: int, last: int) -> DataFrame:
    """The hunks that meet lines ``first`` to ``last``, cut to them."""
    return intervals.clamp(rows, "start_line", "end_line", F.lit(first).cast("long"), F.lit(last).cast("long"))


def status(entries: DataFrame) -> DataFrame:
    """(path, bucket, label): staged, modified, untracked and conflicted entries."""
    return aggregates.classified(entries, "flags", STAGED, CHANGED, WORKTREE_FLAGS["?"], CONFLICTED).drop("flags")


def file_names(commits: DataFrame, ext: str) -> DataFrame:
    """(hash, name): ``NNN_date_hash_slug.ext`` in the order of the walk. ``commits`` are a file's, limited."""
    nth = F.row_number().over(Window.orderBy("walk_idx"))  # a limited listing
    slug = text.bounded_slug(F.col("message"), 50)
    return shown(commits).select("hash", F.format_string("%03d_%s_%s_%s." + ext, nth, F.col("date"), F.col("hash"), slug).alias("name"))


def content_at(blobs: DataFrame, bodies: DataFrame) -> DataFrame:
    """(path, hash, content): the symbol's body in an old version, or the whole version without one."""
    return blobs.join(bodies, ["path", "hash"], "left").select("path", "hash", F.coalesce(F.encode("body", "utf-8"), F.col("content")).alias("content"))


def head_or_empty(paths: DataFrame, blobs: DataFrame) -> DataFrame:
    """(path, content): what HEAD has, nothing for what it lacks."""
    return paths.join(blobs.select("path", "content"), "path", "left").select("path", F.coalesce("content", F.lit(b"")).alias("content"))


def extensions(index: DataFrame) -> DataFrame:
    """(ext, n) of tracked files, most first; ties by extension."""
    from treeloom.functions import paths

    return index.select(paths.extension(F.col("path")).alias("ext")).where("ext is not null").groupBy("ext").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ext")


def may_delete(branches: DataFrame, reach: DataFrame) -> DataFrame:
    """Branches (name, target, is_head) with ``deletable``: not HEAD, and HEAD reaches their commit."""
    head = branches.where("is_head").select(F.col("target").alias("start"))
    merged = reach.join(head, "start", "left_semi").select(F.col("hash").alias("target"), F.lit(True).alias("merged")).distinct()
    return branches.join(merged, "target", "left").withColumn("deletable", ~F.col("is_head") & F.coalesce("merged", F.lit(False))).drop("merged")


def renamed_branch(name: Column, leaf: Column) -> Column:
    """A branch's name with its last segment made ``leaf``; the segments before it stay."""
    return F.when(name.contains("/"), F.concat(F.regexp_extract(name, "^(.*/)[^/]*$", 1), leaf)).otherwise(leaf)


def branch_changes(branches: DataFrame, reach: DataFrame, asked: DataFrame) -> DataFrame:
    """(name, leaf, new_name, outcome) of asked changes (name, leaf): a rename to ``leaf``, or a deletion where it is null.

    ``outcome`` is ``done``, ``not-found``, ``already-exists`` (the new name is
    taken) or ``unmerged`` (HEAD itself, or not reached by it). ``branches`` and
    ``reach`` are those of :func:`may_delete`.
    """
    known = may_delete(branches, reach).select("name", F.lit(True).alias("__known"), "deletable")
    taken = branches.select(F.col("name").alias("new_name"), F.lit(True).alias("__taken"))
    named = asked.select("name", "leaf", renamed_branch(F.col("name"), F.col("leaf")).alias("new_name"))
    rows = named.join(known, "name", "left").join(taken, "new_name", "left")
    outcome = F.when(F.col("__known").isNull(), "not-found").when(F.col("leaf").isNull(), F.when(F.col("deletable"), "done").otherwise("unmerged"))
    return rows.select("name", "leaf", "new_name", outcome.when(F.col("__taken"), "already-exists").otherwise("done").alias("outcome"))


def index_renamed(index: DataFrame, renames: DataFrame) -> DataFrame:
    """The tracked paths after renaming files (path, new_path): the new path is tracked, also where the old one wasn't."""
    rest = index.join(renames.select("path"), "path", "left_anti")
    return rest.select("path").unionByName(renames.select(F.col("new_path").alias("path"))).distinct()
