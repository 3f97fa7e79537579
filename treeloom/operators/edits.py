"""Staged edits: upserts, resolution to ranges, conflicts and application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import text

KINDS = ("replace", "delete", "insert_before", "insert_after", "append")


def staged(ops: DataFrame, key: list[str], at: str, content: str) -> DataFrame:
    """One row for each key: the first sequence it was staged at, and the last content that isn't null."""
    return ops.groupBy(*key).agg(F.min(at).alias("seq"), F.max_by(content, F.when(F.col(content).isNotNull(), F.col(at))).alias(content))


def resolve(ops: DataFrame, body: Column, start: Column, end: Column, last_child_end: Column, kind: Column, content: Column) -> DataFrame:
    """``ops`` with (edit_start, edit_end, edit_text): what an operation on the span [start, end) replaces.

    Places count characters from 0. Replacing goes from the beginning of the
    span's line; deleting takes the blank lines that follow along; inserting
    before goes to the beginning of the line, after to the end of the span;
    appending goes behind the last child, else before the last brace, else to
    the end.
    """
    line = text.line_start(body, start)
    span = F.substring(body, start + 1, end - start)
    brace = start + F.length(span) - F.locate("}", F.reverse(span))
    gone = end + F.when(F.substring(body, end + 1, F.lit(1)) == "\n", 1 + text.blank_lines_after(F.substring(body, end + 2, F.length(body)))).otherwise(0)
    append = F.coalesce(last_child_end, F.when(F.contains(span, F.lit("}")), brace).otherwise(end))
    begin = F.when(kind.isin("replace", "insert_before", "delete"), line).when(kind == "insert_after", end).otherwise(append)
    stop = F.when(kind == "replace", end).when(kind == "delete", gone).otherwise(begin)
    closed = text.ensure_trailing_newline(F.coalesce(content, F.lit("")))
    new = F.when(kind == "delete", "").when(kind == "replace", F.coalesce(content, F.lit(""))).when(kind == "insert_before", closed).otherwise(F.concat(F.lit("\n"), F.coalesce(content, F.lit(""))))
    return ops.withColumns({"edit_start": begin.cast("long"), "edit_end": stop.cast("long"), "edit_text": new})


def applied(edits: DataFrame, key: list[str], body: str) -> DataFrame:
    """(key, result): the body with all of its edits; empty ones go before others at one place.

    Edits that overlap are refused: the result is null, and :func:`conflicts`
    says which they are. A document's edits are collected with it: they are no
    more than its own.
    """
    order = F.struct(F.col("edit_start").alias("s"), (F.col("edit_end") > F.col("edit_start")).alias("filled"), F.col("seq").alias("seq"), F.col("edit_end").alias("e"), F.col("edit_text").alias("t"))
    grouped = edits.groupBy(*key).agg(F.first(body).alias("__b"), F.array_sort(F.collect_list(order)).alias("__e"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("bad"))
    step = lambda s, e: F.struct(
        F.concat(s["out"], F.substring(F.col("__b"), s["at"] + 1, e["s"] - s["at"]), e["t"]).alias("out"), e["e"].alias("at"), (s["bad"] | (e["s"] < s["at"])).alias("bad")
    )
    done = grouped.withColumn("__d", F.aggregate("__e", start, step))
    whole = F.concat("__d.out", F.substring("__b", F.col("__d.at") + 1, F.length("__b")))
    return done.select(*key, F.when(~F.col("__d.bad"), whole).alias("result"))


def conflicts(edits: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of neighbouring edits that overlap."""
    order = Window.partitionBy(*key).orderBy("edit_start", F.col("edit_end") > F.col("edit_start"), "seq")
    last = edits.withColumns({"prev_seq": F.lag("seq").over(order), "prev_start": F.lag("edit_start").over(order), "prev_end": F.lag("edit_end").over(order)})
    empty = (F.col("prev_start") == F.col("prev_end")) & (F.col("edit_start") == F.col("edit_end"))
    return last.where((F.col("prev_end") > F.col("edit_start")) & ~empty)


def spliced(body: Column, start: Column, end: Column, new: Column) -> Column:
    """``body`` with [start, end) replaced; null if the range lies outside."""
    inside = (start >= 0) & (start <= end) & (end <= F.length(body))
    return F.when(inside, text.ensure_trailing_newline(F.concat(F.substring(body, F.lit(1), start), new, F.substring(body, end + 1, F.length(body)))))


def splice_lines(body: Column, first: int, last: int, new: Column) -> Column:
    """``body`` with lines ``first`` to ``last`` replaced by those of ``new``."""
    parts = text.lines(body)
    return F.concat(F.array_join(F.concat(F.slice(parts, 1, first - 1), text.lines(new), F.slice(parts, last + 1, F.greatest(F.size(parts) - last, F.lit(0)))), "\n"), F.lit("\n"))


def splice_verdict(changed: Column, valid_before: Column, valid_after: Column) -> Column:
    """``unchanged``, ``rejected`` if a valid text would turn invalid, else ``written``."""
    return F.when(~changed, "unchanged").when(valid_before & ~valid_after, "rejected").otherwise("written")


def unless_any_fails(results: DataFrame, group: list[str]) -> DataFrame:
    """All rows of groups in which no validation failed, and none of the others."""
    failed = F.coalesce(F.bool_or(F.col("validation") == "fail").over(Window.partitionBy(*group)), F.lit(False))
    return results.withColumn("__f", failed).where(~F.col("__f")).drop("__f")


def layered(layers: list[DataFrame], key: str, scalars: list[str], arrays: list[str], maps: list[str] | None = None) -> DataFrame:
    """One row for each key: scalars from the last layer that has them, arrays one after another, maps merged."""
    out = None
    for i, layer in enumerate(layers):
        named = layer.select(key, *[F.col(c).alias(f"{c}__{i}") for c in (*scalars, *arrays, *(maps or []))])
        out = named if out is None else out.join(named, key, "full")
    n = range(len(layers))

    def array(c: str) -> Column:
        none = F.array().cast(layers[0].schema[c].dataType)
        return F.concat(*[F.coalesce(F.col(f"{c}__{i}"), none) for i in n]).alias(c)

    def merged(c: str) -> Column:
        got = F.col(f"{c}__0")
        for i in n[1:]:
            new = F.col(f"{c}__{i}")
            kept = F.map_filter(got, lambda k, _: ~F.map_contains_key(new, k))  # noqa: B023
            got = F.coalesce(F.map_concat(kept, new), got, new)
        return got.alias(c)

    last = [F.coalesce(*[F.col(f"{c}__{i}") for i in reversed(n)]).alias(c) for c in scalars]
    return out.select(key, *last, *map(array, arrays), *map(merged, maps or []))
