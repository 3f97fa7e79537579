"""Grouped operators: counts, top rows, collapsing, first writers, prefixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Default limits of history views, and how many commits a walk examines.
LIMITS = {"history": 50, "log": 200, "notes": 50, "contributors": 500, "recent": 10, "symbols": 20}
EXAMINED = 5000


def recent(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in an order that has no ties; each task keeps only its own first."""
    return df.orderBy(*order).limit(n)


def walked(commits: DataFrame, touching: Column, n: int, examined: int = EXAMINED) -> DataFrame:
    """The first ``n`` commits that satisfy ``touching``, among the first ``examined`` of the walk."""
    return commits.where((F.col("walk_idx") < examined) & touching).orderBy("walk_idx").limit(n)


def contributors(commits: DataFrame, author: str) -> DataFrame:
    """(author, commits), most first; equal counts by author."""
    return commits.groupBy(author).agg(F.count(F.lit(1)).alias("commits")).orderBy(F.desc("commits"), author)


def dominant(df: DataFrame, value: str, passed_over: str, default: str) -> DataFrame:
    """One row: the most frequent value other than ``passed_over``, by value on ties, or ``default``."""
    counts = df.where(F.col(value).isNotNull() & (F.col(value) != passed_over)).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.coalesce(F.min_by(value, F.struct(-F.col("n"), F.col(value))), F.lit(default)).alias(value))


def collapsed(df: DataFrame, group: list[str], kind: str, order: str, least: int = 3) -> DataFrame:
    """Rows of kinds with fewer than ``least`` in a group stay; others become one row.

    ``n`` is the number of rows behind a row and ``order`` the first of them.
    """
    whole = Window.partitionBy(*group, kind)
    marked = df.withColumns({"n": F.count(F.lit(1)).over(whole), "__first": F.min(order).over(whole)})
    kept = marked.where((F.col("n") < least) | (F.col(order) == F.col("__first")))
    return kept.withColumn("n", F.when(F.col("n") < least, F.lit(1)).otherwise(F.col("n"))).drop("__first")


def bucketed(spark: SparkSession, df: DataFrame, value: str, buckets: list[str]) -> DataFrame:
    """(value, n, nth) for each configured bucket in their order, also empty ones."""
    wanted = spark.createDataFrame([(b, i) for i, b in enumerate(buckets)], f"{value} string, nth int")
    counts = df.where(F.col(value).isin(buckets)).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"), "nth")


def priority(value: Column, order: list[str]) -> Column:
    """The place of ``value`` in a list, from 1; one more than its length for others."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def joined_rows(df: DataFrame, group: list[str], order: str, value: str, mark: str) -> DataFrame:
    """Each group's values, in order, as one text."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).alias("v"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(rows, lambda r: r["v"]), mark).alias(value))


def block_summary(languages: Column) -> Column:
    """``"2 blocks (py, txt)"``; null languages are ``txt``. An aggregate."""
    names = F.array_join(F.array_sort(F.collect_set(F.coalesce(languages, F.lit("txt")))), ", ")
    n = F.count(F.lit(1))
    return F.concat(n.cast("string"), F.when(n == 1, " block (").otherwise(" blocks ("), names, F.lit(")"))


def staged_counts(ops: DataFrame, group: list[str], file: str) -> DataFrame:
    """(group, ops, files): how many operations are staged, and in how many files."""
    return ops.groupBy(*group).agg(F.count(F.lit(1)).alias("ops"), F.count_distinct(file).alias("files"))


def validation(outcome: Column) -> Column:
    """FAIL if any failed, else PASS if any passed, else null. An aggregate over pass, fail and skip."""
    return F.when(F.coalesce(F.bool_or(outcome == "fail"), F.lit(False)), "FAIL").when(F.coalesce(F.bool_or(outcome == "pass"), F.lit(False)), "PASS")


def first_writer(sources: list[DataFrame], key: str, order: str, columns: list[str]) -> DataFrame:
    """The union of sources, one row for each key, each column from the first source that has a value."""
    ranked = [s.withColumn("__src", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, ranked)
    best = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("__src", order))).alias(c) for c in columns]
    return rows.groupBy(key).agg(*best)


def last_writer(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, that with the greatest ``order`` (registries, where later entries replace earlier)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(key, "__r.*")


def first_seen(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return df.groupBy(*key).agg(F.min(order).alias("first_seen"))


def next_segments(df: DataFrame, path: str, prefix: str) -> DataFrame:
    """(segment, is_leaf): what follows ``prefix`` up to the next slash."""
    tails = df.where(F.col(path).startswith(prefix) & (F.length(path) > len(prefix))).select(F.substring(path, len(prefix) + 1, 1 << 30).alias("tail"))
    return tails.groupBy(F.substring_index("tail", "/", 1).alias("segment")).agg(F.bool_or(~F.contains("tail", F.lit("/"))).alias("is_leaf"))


def longest_prefix(requests: DataFrame, names: DataFrame, request: str, name: str) -> DataFrame:
    """For each request the longest name that is a prefix of it up to a slash; null without one.

    A request is cut at each of its slashes and the cuts are looked up, so this
    is an equality join.
    """
    parts = F.split(request, "/")
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    cut = requests.select(request, F.explode(cuts).alias("__cut"))
    found = cut.join(names.select(F.col(name).alias("__cut"), F.col(name).alias("__hit")), "__cut", "left")
    return found.groupBy(request).agg(F.max_by("__hit", F.length("__hit")).alias(name))


def classified(df: DataFrame, flags: str, staged: dict[int, str], changed: dict[int, str], untracked: int, conflicted: int) -> DataFrame:
    """Rows (bucket, label) of status flags; a row may land in several buckets, by the first flag that is set."""
    has = lambda bit: F.col(flags).bitwiseAND(F.lit(bit).cast("long")) != 0

    def label(table: dict[int, str]) -> Column:
        out = F.lit(None).cast("string")
        for bit, name in reversed(table.items()):
            out = F.when(has(bit), name).otherwise(out)
        return out

    bucket = lambda name, what: F.when(what.isNotNull(), F.struct(F.lit(name).alias("bucket"), what.alias("label")))
    all_ = F.array(
        bucket("conflicted", F.when(has(conflicted), "conflicted")), bucket("staged", label(staged)),
        bucket("modified", label(changed)), bucket("untracked", F.when(has(untracked), "untracked")),
    )
    return df.withColumn("__b", F.explode(F.array_compact(all_))).select(*df.columns, "__b.bucket", "__b.label")


def resolved(value: list[Column], default: Column) -> Column:
    """The first layer that says something, in order of priority."""
    return F.coalesce(*value, default)
