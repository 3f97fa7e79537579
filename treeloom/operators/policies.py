"""Access policies and gates of sessions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.operators import sweeps


def access_mode(tool: Column, n_lines: Column, limit: Column, threshold: Column, narrow: int = 50) -> Column:
    """``hint`` for what may go on, ``deny`` for reading a long file whole.

    Other tools than Read, narrow limits, thresholds below zero and files under
    the threshold only get a hint.
    """
    return F.when(tool != "Read", "hint").when(F.coalesce(limit, F.lit(1 << 30)) <= narrow, "hint").when((threshold < 0) | (n_lines < threshold), "hint").otherwise("deny")


def threshold(language: Column, default: Column, builtin: Column) -> Column:
    """The language's own threshold, else the default, else the built-in one."""
    return F.coalesce(language, default, builtin)


def large_edit(tool: Column, old: Column, new: Column, least: int = 10) -> Column:
    """Whether an edit is large: any Write, and edits of more than ``least`` old and new lines together."""
    n = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.regexp_count(c, F.lit("\n")) + 1)
    return (tool == "Write") | ((tool == "Edit") & (n(old) + n(new) > least))


def unique_place(text: Column, wanted: Column) -> Column:
    """The 0-based place of ``wanted`` in ``text`` if it occurs exactly once, else null."""
    times = (F.length(text) - F.length(F.replace(text, wanted, F.lit("")))) / F.length(wanted)
    return F.when((F.length(wanted) > 0) & (times == 1), F.instr(text, wanted) - 1)


def changed_range(edits: DataFrame, scopes: DataFrame, least: int = 5) -> DataFrame:
    """(path, first, last): the smallest named scope around each edit that has at least as many lines as it, and ``least``.

    ``edits`` has (path, row_start, row_end), ``scopes`` (path, row_start, row_end, name); rows from 0, ends inclusive; the result counts from 1, half open.
    """
    e = edits.select("path", F.col("row_start").alias("a"), F.col("row_end").alias("b"))
    size = F.col("row_end") - F.col("row_start") + 1
    named = scopes.where("name is not null").withColumn("__end", F.col("row_end") + 1)
    around = sweeps.containing(e.distinct(), named, "path", "a", "row_start", "__end").select("row.*", "span.row_start", "span.row_end")
    around = around.where((F.col("row_end") >= F.col("b")) & (size >= F.greatest(F.col("b") - F.col("a") + 1, F.lit(least))))
    best = around.groupBy("path", "a", "b").agg(F.min_by(F.struct("row_start", "row_end"), size).alias("s"))
    return e.join(best, ["path", "a", "b"], "left").select("path", (F.coalesce("s.row_start", "a") + 1).alias("first"), (F.coalesce("s.row_end", "b") + 2).alias("last"))


def within_grace(touched: Column, now: Column, seconds: int = 300) -> Column:
    """Whether a file was touched less than ``seconds`` before ``now``."""
    return F.unix_timestamp(now) - F.unix_timestamp(touched) < seconds


def visibility(processes: DataFrame, pids: DataFrame, dynamic: DataFrame, static: DataFrame, chains: DataFrame, default: str) -> DataFrame:
    """(pid, policy): explicit rules first, then names, then the nearest ancestor with an explicit rule, then the default.

    ``pids`` has (pid, policy), ``dynamic`` and ``static`` (comm, policy),
    ``chains`` (start, id, steps) of :func:`treeloom.operators.graph.ancestors`.
    """
    named = lambda d, n: F.broadcast(d.select("comm", F.col("policy").alias(n)))
    above = chains.where("steps > 0").join(pids.select(F.col("pid").alias("id"), "policy"), "id").groupBy(F.col("start").alias("pid")).agg(F.min_by("policy", "steps").alias("inherited"))
    rows = processes.join(pids.select("pid", F.col("policy").alias("own")), "pid", "left").join(named(dynamic, "dyn"), "comm", "left").join(named(static, "sta"), "comm", "left").join(above, "pid", "left")
    return rows.select("pid", F.coalesce("own", "dyn", "sta", "inherited", F.lit(default)).alias("policy"))


def visibility_report(processes: DataFrame, pids: DataFrame, dynamic: DataFrame) -> DataFrame:
    """(kind, subject, policy): registered processes with a rule of their own, and rules by name."""
    own = processes.join(pids, "pid").select(F.lit("pid").alias("kind"), F.col("pid").cast("string").alias("subject"), "policy")
    return own.unionByName(dynamic.select(F.lit("name").alias("kind"), F.col("comm").alias("subject"), "policy"))
