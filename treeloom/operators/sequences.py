"""Operators over ordered rows: naming, runs, islands, pairing, nesting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators import intervals


def numbered_names(df: DataFrame, group: list[str], name: str, order: str) -> DataFrame:
    """``fs_name``: the first of equal names keeps it, later ones get ``-2``, ``-3``."""
    nth = F.row_number().over(Window.partitionBy(*group, name).orderBy(order))
    return df.withColumn("fs_name", F.when(nth == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), nth.cast("string"))))


def kind_suffixed_names(df: DataFrame, group: list[str], name: str, kind: str, order: str) -> DataFrame:
    """``fs_name``: names that clash get ``~kind``, repeats of a kind ``~kind-2``; others stay."""
    clash = F.count(F.lit(1)).over(Window.partitionBy(*group, name)) > 1
    nth = F.row_number().over(Window.partitionBy(*group, name, kind).orderBy(order))
    suffix = F.concat(F.lit("~"), F.col(kind), F.when(nth > 1, F.concat(F.lit("-"), nth.cast("string"))).otherwise(""))
    return df.withColumn("fs_name", F.when(clash, F.concat(F.col(name), suffix)).otherwise(F.col(name)))


def free_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """``free``: the name itself if no earlier row took it, else the first of ``-2``, ``-3``, ... that is free (session ids).

    ``order`` has no ties. What a row may take depends on all rows before it
    whose names differ in numbers at the end only, so these are dealt with one
    after another; they are the sessions that were given one name.
    """
    import pandas as pd

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        taken, following, free = set(), {}, []
        rows = rows.sort_values("o")
        for asked in rows["n"]:
            got, k = asked, following.get(asked, 2)
            while got in taken:
                got, k = f"{asked}-{k}", k + 1
            following[asked] = k
            taken.add(got)
            free.append(got)
        return rows.assign(free=free)[["o", "free"]]

    base = F.regexp_extract(F.col("n"), "^(.*?)(-[0-9]+)*$", 1)
    asked = df.select(F.col(order).alias("o"), F.col(name).alias("n"))
    kind = df.schema[order].dataType.simpleString()
    dealt = asked.where(F.col("n").isNotNull()).groupBy(base.alias("base")).applyInPandas(deal, f"o {kind}, free string")
    return df.join(dealt.withColumnRenamed("o", order), order, "left")


def history_name(nth: Column, date: Column, key: Column, slug: Column) -> Column:
    """``NNN_date_key_slug``."""
    return F.format_string("%03d_%s_%s_%s", nth, date, key, slug)


def after_last(df: DataFrame, group: str, order: str, marker: Column) -> DataFrame:
    """Rows after their group's last marked row; all rows of groups without one."""
    last = F.max(F.when(marker, F.col(order))).over(Window.partitionBy(group))
    return df.withColumn("__last", last).where(F.col("__last").isNull() | (F.col(order) > F.col("__last"))).drop("__last")


#: How lists of records are sliced: one from 1, a range, or the last so many.
SLICE = re.compile(r"(?:(?P<first>[1-9][0-9]*)(?:-(?P<last>[1-9][0-9]*))?|-(?P<tail>[1-9][0-9]*))\Z")


def sliced_rows(df: DataFrame, group: list[str], order: list[str], spec: str) -> DataFrame:
    """The records of each group that ``M``, ``M-N`` or ``-N`` selects, clamped, with ``nth``, their place from 1.

    ``order`` has no ties. Raises ValueError for another or an inverted spec.
    """
    found = SLICE.match(spec)
    if found is None or found["last"] and int(found["last"]) < int(found["first"]):
        raise ValueError(f"not a slice: {spec}")
    forward = Window.partitionBy(*group).orderBy(*order)
    if found["tail"]:
        back = Window.partitionBy(*group).orderBy(*map(F.desc, order))
        return df.withColumns({"nth": F.row_number().over(forward), "__r": F.row_number().over(back)}).where(F.col("__r") <= int(found["tail"])).drop("__r")
    first = int(found["first"])
    return df.withColumn("nth", F.row_number().over(forward)).where(F.col("nth").between(first, int(found["last"] or first)))


def islands(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``island``: a number that consecutive rows of equal ``value`` share."""
    whole = Window.partitionBy(group).orderBy(order)
    same = Window.partitionBy(group, value).orderBy(order)
    return df.withColumn("island", (F.row_number().over(whole) - F.row_number().over(same)).cast("long"))


def longest_run(df: DataFrame, group: str, order: str, value: str, least: int) -> DataFrame:
    """Each group's longest run of equal values, the earliest of equally long ones, if it has ``least`` rows."""
    runs = islands(df, group, order, value).groupBy(group, value, "island").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.max_by(F.struct(value, "n", "first"), F.struct("n", -F.col("first")))
    return runs.where(F.col("n") >= least).groupBy(group).agg(best.alias("b")).select(group, "b.*")


def island_around(df: DataFrame, group: str, order: str, value: str, probes: DataFrame, at: str) -> DataFrame:
    """The first and last row of the island that holds each probe (group, at); probes outside all rows get none.

    Islands don't overlap, so the one that begins last before a probe is the
    only one that can hold it.
    """
    bounds = islands(df, group, order, value).groupBy(group, value, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    held = intervals.as_of(probes, bounds.withColumn("__b", F.struct(value, "first", "last")), group, at, "first", "__b")
    return held.where(F.col("__b").isNotNull() & (F.col(at) <= F.col("__b.last"))).select(*probes.columns, f"__b.{value}", "__b.first", "__b.last")


def paired(df: DataFrame, group: str, order: str, opens: Column, closes: Column) -> DataFrame:
    """Opening rows with the row that closes them; unclosed ones have null, stray closers go.

    With the running depth, an opener and its closer are neighbours among the
    rows of their depth. A stray closer would make depths sink, so depth counts
    from the least value so far.
    """
    running = Window.partitionBy(group).orderBy(order)
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    deep = df.where(opens | closes).withColumn("__raw", F.sum(step).over(running)).withColumn("__low", F.least(F.min("__raw").over(running), F.lit(0)))
    deep = deep.withColumn("depth", (F.col("__raw") - F.col("__low")).cast("long")).withColumn("__stray", closes & (F.col("__raw") == F.col("__low")) & (F.col("__raw") < F.coalesce(F.lag("__low").over(running), F.lit(0))))
    level = F.when(closes, F.col("depth") + 1).otherwise(F.col("depth"))
    live = deep.where(~F.col("__stray")).withColumn("depth", level)
    nearest = Window.partitionBy(group, "depth").orderBy(order)
    closer = F.lead(F.when(closes, F.col(order))).over(nearest)
    return live.withColumn("closed_by", closer).where(opens).drop("__raw", "__low", "__stray")


def nesting(nodes: DataFrame, group: str, counts: Column) -> DataFrame:
    """``nested``: how many ancestors of each node (pre, post) satisfy ``counts``, by a running sum.

    Every counted node adds one at its pre number and takes it away at its
    post number; the sum so far is the number of open ones.
    """
    enter = nodes.select(group, F.col("pre").alias("at"), F.when(counts, 1).otherwise(0).alias("step"), F.col("pre").alias("node"))
    leave = nodes.where(counts).select(group, F.col("post").alias("at"), F.lit(-1).alias("step"), F.lit(None).cast("long").alias("node"))
    order = Window.partitionBy(group).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    depth = enter.unionByName(leave).withColumn("nested", F.coalesce(F.sum("step").over(order), F.lit(0)).cast("long"))
    return nodes.join(depth.where(F.col("node").isNotNull()).select(group, F.col("node").alias("pre"), "nested"), [group, "pre"])
