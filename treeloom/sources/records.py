"""Small record sources: transcripts, session files, configuration."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.operators.sequences import after_last

#: Names of a project's configuration, in order.
PROJECT_FILES = (".treeloom.toml", "treeloom.toml", ".config/treeloom.toml")
TRANSCRIPT = "conv string, ord long, type string, is_prompt boolean, tool string, file_path string"


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Session logs as rows; lines that can't be read are left out."""
    rows = spark.read.schema(TRANSCRIPT + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null and type is not null").drop("_bad")


def changed_since_prompt(log: DataFrame, ignored: list[str]) -> DataFrame:
    """(conv, file_path): files written after each conversation's last prompt, each once, without ignored extensions."""
    later = after_last(log, "conv", "ord", F.col("is_prompt"))
    ext = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    return later.where(F.col("tool").isin("Edit", "Write", "MultiEdit") & F.col("file_path").isNotNull() & ~ext.isin(*[e.lower() for e in ignored])).select("conv", "file_path").distinct()


def stop_gate(log: DataFrame, ignored: list[str], least: int = 2) -> DataFrame:
    """(conv, n_files): conversations with at least ``least`` changed files since their last prompt."""
    return changed_since_prompt(log, ignored).groupBy("conv").agg(F.count(F.lit(1)).alias("n_files")).where(F.col("n_files") >= least)


def sessions(spark: SparkSession, folder: str, alive: DataFrame) -> DataFrame:
    """(id, pid, path) of session files whose process is in ``alive`` (pid)."""
    rows = spark.read.schema("id string, pid long, path string").json(folder)
    return rows.where("id is not null").join(alive, "pid", "left_semi").select("id", "pid", "path").orderBy("id")


def config(user: str | None, project: str | None) -> list[dict]:
    """The layers of configuration, lowest first: the user's, then the first project file that exists."""
    out = []
    if user and Path(user).is_file():
        out.append(tomllib.loads(Path(user).read_text("utf-8")))
    for name in PROJECT_FILES if project else ():
        if (found := Path(project) / name).is_file():
            out.append(tomllib.loads(found.read_text("utf-8")))
            break
    return out


def merged(base: object, over: object) -> object:
    """Maps merge by key, arrays go one after another, anything else is replaced."""
    if isinstance(base, dict) and isinstance(over, dict):
        return base | {k: merged(base[k], v) if k in base else v for k, v in over.items()}
    if isinstance(base, list) and isinstance(over, list):
        return base + over
    return over
