"""Files as tables: scan, lookup, listing, lines, and writing back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions import paths, text


def scan(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, n_bytes, mtime, content) of all files below ``root``; paths are relative to it.

    Content is read only where a query uses it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    raw = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    base = F.lit(root.rstrip("/") if "://" in root or root.startswith("file:") else "file:" + root.rstrip("/"))
    path = F.regexp_replace("path", "^file:/+", "file:/")
    return raw.select(F.substring(path, F.length(F.regexp_replace(base, "^file:/+", "file:/")) + 2, F.length(path)).alias("path"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("mtime"), "content")


def from_rows(spark: SparkSession, rows: list[tuple[str, bytes]]) -> DataFrame:
    """The same table from (path, content) pairs, for tests."""
    return spark.createDataFrame(rows, "path string, content binary").select("path", F.length("content").cast("long").alias("n_bytes"), F.lit(None).cast("timestamp").alias("mtime"), "content")


def texts(files: DataFrame) -> DataFrame:
    """(path, text) of files that are valid UTF-8."""
    return files.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("text"))


def lossy(files: DataFrame) -> DataFrame:
    """(path, text) of all files; what isn't UTF-8 is replaced."""
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def entry(files: DataFrame, path: str) -> DataFrame:
    """The one file at ``path``, or no row."""
    return files.where(F.col("path") == path)


def listing(files: DataFrame, folder: str) -> DataFrame:
    """(name, is_dir) of what lies directly in ``folder``, by name."""
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    below = files.where(F.col("path").startswith(prefix)).select(F.substring("path", len(prefix) + 1, 1 << 30).alias("rest"))
    return below.groupBy(F.substring_index("rest", "/", 1).alias("name")).agg(F.bool_or(F.contains("rest", F.lit("/"))).alias("is_dir")).orderBy("name")


def lines(texts_: DataFrame) -> DataFrame:
    """(path, line_no, byte_start, byte_end, text): every line, numbered from 1."""
    rows = texts_.select("path", F.posexplode(text.lines(F.col("text"))).alias("i", "line"))
    before = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long")
    return rows.select("path", (F.col("i") + 1).alias("line_no"), start.alias("byte_start"), (start + F.octet_length("line")).alias("byte_end"), F.col("line").alias("text"))


def overview(texts_: DataFrame) -> DataFrame:
    """(path, folder, language, n_lines, tokens) of files with a decomposer, by path."""
    from treeloom.parse.tables import with_language

    known = with_language(texts_).where("language is not null")
    return known.select("path", paths.parent(F.col("path")).alias("folder"), "language", F.size(text.lines(F.col("text"))).alias("n_lines"), text.token_label(F.octet_length("text")).alias("tokens")).orderBy("path")


def write(results: DataFrame, folder: str) -> None:
    """Stores (path, text) results as a table partitioned by folder; files are materialised from it."""
    results.withColumn("folder", paths.parent(F.col("path"))).write.mode("overwrite").partitionBy("folder").parquet(folder)


def materialise(results: DataFrame, root: str) -> DataFrame:
    """Writes each (path, text) below ``root`` as a file and gives (path, n_bytes) of what was written; null texts write nothing.

    ``root`` is a folder that all executors share. A file is written beside its
    place and then moved there, so a task that is tried again leaves whole
    files. Paths that lead out of ``root`` are an error. Writing happens when
    the result is computed.
    """
    import pyarrow as pa

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for batch in batches:
            done = []
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if path is None or body is None:
                    continue
                parts = path.split("/")
                if path.startswith("/") or not all(parts) or ".." in parts or "." in parts:
                    raise ValueError(f"not a path below the root: {path!r}")
                place, raw = "/".join([base.rstrip("/"), *parts]), body.encode("utf-8")
                store.create_dir(place.rpartition("/")[0], recursive=True)
                beside = f"{place}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(beside) as out:
                    out.write(raw)
                store.move(beside, place)
                done.append((path, len(raw)))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "n_bytes"])

    return results.select("path", "text").mapInArrow(put, "path string, n_bytes long")
