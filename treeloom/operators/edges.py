"""References, calls and positions as tables of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions import paths
from treeloom.operators import intervals

#: Query features and the edge kinds they read, and which end of an edge they show.
FEATURES = {
    "CALLERS": ("call", "src"), "DEPS": ("call", "dst"), "REFERENCES": ("ref", "src"), "IMPLEMENTATION": ("impl", "src"),
    "DEFINITION": ("def", "dst"), "DECLARATION": ("decl", "dst"), "TYPE-DEFINITION": ("type", "dst"),
}


def feature(edges: DataFrame, name: str, file: Column | None = None, line: Column | None = None) -> DataFrame:
    """Rows (file, line, name) of a feature, at one position or for all.

    Edges are (src_file, src_line, edge_kind, dst_file, dst_line, name); lines
    count from 0 and are shown from 1.
    """
    kind, shown = FEATURES[name]
    asked = "dst" if shown == "src" else "src"
    rows = edges.where(F.col("edge_kind") == kind)
    if file is not None:
        rows = rows.where(F.col(f"{asked}_file") == file)
    if line is not None:
        rows = rows.where(F.col(f"{asked}_line") == line)
    return rows.select(F.col(f"{asked}_file").alias("of_file"), (F.col(f"{asked}_line") + 1).alias("of_line"), F.col(f"{shown}_file").alias("file"), (F.col(f"{shown}_line") + 1).alias("line"), "name")


def by_file(rows: DataFrame) -> DataFrame:
    """(file, refs, symbols, lines) of a feature's rows (file, line, name): how many, of how many names, and on which lines."""
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("name").alias("symbols"), F.array_sort(F.collect_set("line")).alias("lines"))


def linked(rows: DataFrame, symbols: DataFrame, root: str) -> DataFrame:
    """Rows (file, line, name) inside ``root`` with the symbol around them, and the name of a link to it.

    ``symbols`` has (file, start, stop, depth, ord, fs_name), lines half open
    from 1. Rows outside of all symbols link to their line. Of rows with one
    link name the first counts.
    """
    inside = rows.where(F.col("file").startswith(root))
    around = intervals.deepest(inside.select("file", "line").distinct(), symbols, "file", "line", "start", "stop", "depth", "ord").select("file", "line", "fs_name")
    named = inside.join(around, ["file", "line"], "left")
    link = paths.target_link(F.col("name"), F.col("file"), F.col("line"))
    target = F.coalesce(F.concat(F.col("file"), F.lit("@/symbols/"), F.col("fs_name"), F.lit("@")), F.concat(F.col("file"), F.lit("@/lines:"), F.col("line").cast("string")))
    best = F.min_by(F.struct(F.col("file"), F.col("line"), target.alias("target")), F.struct("file", "line"))
    return named.groupBy(link.alias("link")).agg(best.alias("b")).select("link", "b.*")


def search(symbols: DataFrame, wanted: str, limit: int = 20) -> DataFrame:
    """The first symbols whose name contains ``wanted`` in any case, by server and order."""
    return symbols.where(F.contains(F.lower("name"), F.lit(wanted.lower()))).orderBy("server", "ord").limit(limit)


def applicable(servers: DataFrame, entries: DataFrame) -> DataFrame:
    """Servers (server, markers, ...) one of whose root ``markers`` is among a project's root entries (name), or that need none."""
    names = F.broadcast(entries.select(F.col("name").alias("__m")).distinct())  # the files directly in one folder
    marked = servers.select("server", F.explode("markers").alias("__m")).join(names, "__m", "left_semi").select("server").distinct()
    found = marked.select(F.col("server").alias("__s"), F.lit(True).alias("__found"))
    needless = F.coalesce(F.size("markers"), F.lit(0)) <= 0
    return servers.join(found, F.col("server") == F.col("__s"), "left").where(needless | F.col("__found")).drop("__s", "__found")


def server_index(servers: DataFrame, parsers: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(ext, server, language): enabled servers for the extensions that have a parser; the first listed wins.

    An override (ext, server) from the configuration goes before that, if its server is enabled.
    """
    each = servers.where("enabled").select("server", "ord", "language", F.explode("exts").alias("ext")).join(parsers, "ext", "left_semi").withColumn("by_ext", F.lit(1))
    if overrides is not None:
        chosen = servers.where("enabled").select("server", "ord", "language").join(overrides.select("ext", "server"), "server").join(parsers, "ext", "left_semi")
        each = each.unionByName(chosen.select("server", "ord", "language", "ext", F.lit(0).alias("by_ext")))
    return each.groupBy("ext").agg(F.min_by(F.struct("server", "language"), F.struct("by_ext", "ord")).alias("s")).select("ext", "s.*")
