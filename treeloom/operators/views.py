"""What views show of fragments, locations, hints and diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import text
from treeloom.operators import aggregates
from treeloom.parse.fragments import STRUCTURAL

#: Kinds of inlay hints by number.
INLAY = {1: "type", 2: "parameter"}


def navigable(found: DataFrame) -> DataFrame:
    """Fragments with a name of their own: no code blocks, nothing structural."""
    return found.where(F.col("fs_name").isNotNull() & (F.col("kind") != "code") & ~F.col("kind").isin(*STRUCTURAL))


def by_kind(found: DataFrame, kind: str) -> DataFrame:
    return navigable(found).where(F.lower("kind") == kind.lower())


def kinds(found: DataFrame) -> DataFrame:
    return navigable(found).select("path", F.lower("kind").alias("kind")).distinct().orderBy("path", "kind")


def symbol_table(found: DataFrame) -> DataFrame:
    """One row for each fragment: indented name, kind, lines from 1, tokens, children, code blocks, description."""
    kids = found.where("parent_id is not null").groupBy("path", F.col("parent_id").alias("frag_id")).agg(
        F.count_if((F.col("kind") != "code") & ~F.col("kind").isin(*STRUCTURAL)).alias("children"),
        F.when(F.count_if(F.col("kind") == "code") > 0, aggregates.block_summary(F.when(F.col("kind") == "code", F.col("code_lang")))).alias("_all"),
    )
    blocks = found.where("kind = 'code' and parent_id is not null").groupBy("path", F.col("parent_id").alias("frag_id")).agg(aggregates.block_summary(F.col("code_lang")).alias("code_blocks"))
    rows = navigable(found).join(kids.drop("_all"), ["path", "frag_id"], "left").join(blocks, ["path", "frag_id"], "left")
    label = F.concat_ws(" ", F.nullif(text.compact_visibility(F.coalesce("visibility", F.lit(""))), F.lit("-")), F.lower("kind"))
    return rows.orderBy("path", "byte_start").select(
        "path", F.concat(F.repeat(F.lit("  "), F.col("depth")), "fs_name").alias("name"), label.alias("kind"),
        F.concat((F.col("line_start") + 1).cast("string"), F.lit("-"), F.col("line_end").cast("string")).alias("lines"),
        text.token_label(F.col("full_end") - F.col("full_start")).alias("tokens"), F.coalesce("children", F.lit(0)).alias("children"),
        F.coalesce("code_blocks", F.lit("")).alias("code_blocks"), text.first_line(F.coalesce("doc", F.lit(""))).alias("description"),
    )


def facets(found: DataFrame) -> DataFrame:
    """(path, frag_id, entry): what a fragment's folder lists."""
    kids = found.where("parent_id is not null").groupBy("path", F.col("parent_id").alias("frag_id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("fs_name").isNotNull() & (F.col("kind") != "code"), F.struct("ord", F.concat("fs_name", F.lit("@")).alias("n"))))).alias("names"),
        F.bool_or(F.col("kind") == "code").alias("has_code"), F.bool_or(F.col("kind") == "docstring").alias("has_doc"), F.bool_or(F.col("kind") == "decorator").alias("has_decorators"),
    )
    rows = navigable(found).join(kids, ["path", "frag_id"], "left")
    own = F.array(
        F.lit("body"), F.when(F.col("signature").isNotNull(), "signature"), F.when(F.col("has_doc"), "docstring"), F.when(F.col("has_decorators"), "decorators"),
        F.when(F.size("names") > 0, "OVERVIEW.md"), F.when(F.col("has_code"), "code"), F.lit("edit"),
    )
    return rows.select("path", "frag_id", F.explode(F.concat(F.array_compact(own), F.coalesce(F.transform("names", lambda r: r["n"]), F.array().cast("array<string>")))).alias("entry"))


def code_blocks(found: DataFrame) -> DataFrame:
    """(path, parent_id, name) of fenced blocks: ``N.lang``."""
    nth = F.row_number().over(Window.partitionBy("path", "parent_id").orderBy("byte_start"))
    return found.where("kind = 'code'").select("path", "parent_id", F.concat(nth.cast("string"), F.lit("."), F.coalesce("code_lang", F.lit("txt"))).alias("name"))


def body(raw: Column, full_start: Column, byte_end: Column) -> Column:
    """A fragment's text, from the beginning of the line its documentation begins on."""
    head = F.decode(F.substring(raw, F.lit(1), full_start.cast("int")), "utf-8")
    begin = full_start - F.octet_length(F.substring_index(head, "\n", -1))
    return F.decode(F.substring(raw, (begin + 1).cast("int"), (byte_end - begin).cast("int")), "utf-8")


def masked_body(text_: Column, start: Column, end: Column) -> Column:
    """The lines around [start, end) of a text with everything outside made blank."""
    from_ = text.line_start(text_, start)
    to = text.line_end(text_, end)
    blank = lambda a, b: F.regexp_replace(F.substring(text_, a + 1, b - a), "[^\n]", " ")
    return F.concat(blank(from_, start), F.substring(text_, start + 1, end - start), blank(end, to))


def locations(rows: DataFrame, root: str) -> DataFrame:
    """(file, line, column) inside ``root``, relative to it and counted from 1."""
    base = root.rstrip("/") + "/"
    return rows.where(F.col("file").startswith(base)).select(F.substring("file", len(base) + 1, 1 << 30).alias("file"), (F.col("line") + 1).alias("line"), (F.col("column") + 1).alias("column"))


def inlay_hints(rows: DataFrame) -> DataFrame:
    """(line, column, label, kind) of hints (line, column, parts, kind number)."""
    name = F.when(F.col("kind").isNull(), "unknown")
    for n, label in INLAY.items():
        name = name.when(F.col("kind") == n, label)
    return rows.select((F.col("line") + 1).alias("line"), (F.col("column") + 1).alias("column"), F.array_join("parts", "").alias("label"), name.otherwise("other").alias("kind"))


def hover(scalar: Column, parts: Column) -> Column:
    """Hover text: one text, or several with blank lines between."""
    return F.coalesce(scalar, F.array_join(parts, "\n\n"), F.lit(""))


def diagnostics(rows: DataFrame) -> DataFrame:
    """(line, column, severity, source, code, message) as views show them; what is missing is empty."""
    return rows.select(
        (F.col("line") + 1).alias("line"), (F.col("column") + 1).alias("column"), text.severity_label(F.coalesce("severity", F.lit(0))).alias("severity"),
        F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.col("code").cast("string"), F.lit("")).alias("code"), "message",
    )


def todo_entries(entries: DataFrame, key: str) -> DataFrame:
    """(tag, name, target): links of entries below their tag's folder; tags without entries have none."""
    return entries.select("tag", F.concat(F.replace(key, F.lit("/"), F.lit("-")), F.lit(":"), F.col("line_no").cast("string"), F.lit("-"), F.col("entry")).alias("name"), F.concat(F.col(key), F.lit("@/lines:"), F.col("line_no").cast("string")).alias("target"))


def markdown_table(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row: the table as Markdown, in order. For views, whose rows are few."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]), F.lit(" |"))
    rows = F.array_sort(F.collect_list(F.struct(*order, line.alias("__line"))))
    head = f"| {' | '.join(columns)} |\n|{'-|' * len(columns)}\n"
    return df.agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["__line"]), "\n"), F.lit("\n")).alias("table"))


def at_line(points: DataFrame, found: DataFrame) -> DataFrame:
    """(path, line, fs_path): the symbol at each line from 1: the deepest around it, else the nearest top-level one."""
    from treeloom.operators import intervals

    asked = points.where("line > 0").select("path", "line", (F.col("line") - 1).alias("row"))
    spans = navigable(found).select("path", "line_start", "line_end", "depth", "ord", F.to_json("fs_path").alias("name"))
    inside = intervals.deepest(asked, spans, "path", "row", "line_start", "line_end", "depth", "ord").select("path", "line", "name")
    outside = asked.join(inside.select("path", "line"), ["path", "line"], "left_anti")
    near = intervals.nearest(outside, spans.where("depth = 0").drop("depth"), "path", "row", "line_start", "line_end", "name", "ord").select("path", "line", "name")
    return inside.unionByName(near).select("path", "line", F.from_json("name", "array<string>").alias("fs_path"))


def system(providers: DataFrame, index: DataFrame) -> DataFrame:
    """(nth, id, languages): providers in order of depth, priority and id, and the languages of the index by size."""
    top = index.groupBy("language").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "language"))), lambda r: r["language"]), ", ").alias("languages"))
    nth = F.row_number().over(Window.orderBy("terminal", F.when(F.col("terminal"), 0).otherwise(F.col("depth")), F.when(F.col("terminal"), 0).otherwise(F.col("priority")), "id"))  # a handful of providers
    return providers.select(nth.alias("nth"), "id").join(top, F.lit(True))
