"""Ignore rules: patterns as rows, and which paths they exclude."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places where rules stand, in order of precedence after nested files.
ORIGINS = {"nested": 0, "info": 1, "global": 2, "configured": 3}


def to_regex(pattern: str) -> tuple[str, bool, bool]:
    """(regex on a path below the rule's folder, whether it negates, whether only folders match)."""
    negate = pattern.startswith("!")
    body = pattern[1:] if negate else pattern
    body = body[1:] if body.startswith(("\\#", "\\!")) else body
    only_dirs = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            inside = body[i + 1 : end]
            out, i = out + "[" + ("^" + inside[1:] if inside[:1] in "!^" else inside) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}$", negate, only_dirs


def rules(spark: SparkSession, sources: list[tuple[str, str, str]]) -> DataFrame:
    """(base, origin, ord, regex, negate, only_dirs) of (base folder, origin, text of an ignore file)."""
    rows = []
    for base, origin, body in sources:
        for i, line in enumerate(body.splitlines()):
            line = line.rstrip() if not line.rstrip().endswith("\\") else line
            if line and not line.startswith("#"):
                rows.append((base.strip("/"), ORIGINS[origin], i, *to_regex(line)))
    return spark.createDataFrame(rows, "base string, origin int, ord int, regex string, negate boolean, only_dirs boolean")


def excluded(files: DataFrame, rules_: DataFrame) -> DataFrame:
    """``files`` (path) with ``excluded``.

    Deeper ignore files speak first, then the other places; in one file the
    last match counts, and the first place with a match decides. A path in an
    excluded folder is excluded. Paths meet rules by an equality join on the
    folders above them.
    """
    parts = F.split("path", "/")
    upto = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    heads = files.select("path", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"))
    each = heads.select("path", upto(F.col("n")).alias("head"), (F.col("n") < F.size(F.split("path", "/"))).alias("is_dir"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("b"))
    based = each.select("path", "head", "is_dir", F.array_join(F.slice(F.split("path", "/"), 1, F.col("b")), "/").alias("base"), "b")
    rel = F.when(F.col("base") == "", F.col("head")).otherwise(F.substring("head", F.length("base") + 2, F.length("head")))
    hits = based.withColumn("rel", rel).join(F.broadcast(rules_), "base").where(F.expr("rel rlike regex") & (~F.col("only_dirs") | F.col("is_dir")))
    first = F.min_by("negate", F.struct("origin", -F.col("b"), -F.col("ord")))
    verdicts = hits.groupBy("path", "head").agg(first.alias("negate"))
    out = verdicts.groupBy("path").agg(F.bool_or(~F.col("negate")).alias("hit"))
    return files.join(out, "path", "left").withColumn("excluded", F.coalesce("hit", F.lit(False))).drop("hit")
