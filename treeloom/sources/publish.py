"""Files written all or not at all: a Python data source that stages files and publishes them with one list.

``df.write.format("published_files").mode("append").save(root)`` takes rows
(path, text). Tasks write their files into a folder of the run, with a list of
what they wrote, and report that folder; folders of attempts that failed aren't
reported. When all tasks have succeeded, the driver writes a new ``CURRENT``
beside the old one and moves it over that: the one step that others see. When a
task fails for good, the run's folder is removed and ``CURRENT`` is as before; what
tasks that were still running add later is listed nowhere and goes with the next run.

A run adds to what was published; of several runs that name a path the last
counts, and a null text takes the path away. ``mode("overwrite")`` starts anew.
Rows without a path are skipped; of rows with equal paths in one run, one counts.
``root`` is a folder that driver and executors share; one run at a time may write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

ENTRIES = "run long, path string, file string, size long"


def located(uri: str):
    """The file system that a path or URI belongs to, and the path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.rstrip("/")
    store, base = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return store, base.rstrip("/")


def parts_of(root: str) -> list[str]:
    """The folders that ``CURRENT`` lists, oldest run first; none where nothing was published."""
    from pyarrow import fs

    store, base = located(root)
    if store.get_file_info(f"{base}/CURRENT").type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(f"{base}/CURRENT") as f:
        return json.loads(f.read())


@dataclass
class Written(WriterCommitMessage):
    part: str | None


class FileWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool) -> None:
        self.root, self.overwrite, self.run = root, overwrite, f"run-{uuid.uuid4().hex}"
        self.nth = 0 if overwrite else 1 + max((int(p.split("/")[1]) for p in parts_of(root)), default=-1)

    def write(self, iterator: Iterator[Row]) -> Written:
        context, (store, base) = TaskContext.get(), located(self.root)
        part, lines = f"{self.run}/{self.nth}/{context.partitionId()}-{context.taskAttemptId()}", []
        for row in iterator:
            path, text = row["path"], row["text"]
            if path is None:
                continue
            steps = path.split("/")
            if path.startswith("/") or not all(steps) or ".." in steps or "." in steps:
                raise ValueError(f"not a path below the root: {path!r}")
            name, raw = None, (text or "").encode("utf-8")
            if not lines:
                store.create_dir(f"{base}/{part}", recursive=True)
            if text is not None:
                name = f"{len(lines)}.body"
                with store.open_output_stream(f"{base}/{part}/{name}") as out:
                    out.write(raw)
            lines.append(json.dumps({"run": self.nth, "path": path, "file": name and f"{part}/{name}", "size": len(raw)}))
        if not lines:
            return Written(None)
        with store.open_output_stream(f"{base}/{part}/entries.json") as out:
            out.write("\n".join(lines).encode("utf-8"))
        return Written(part)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, base = located(self.root)
        old = parts_of(self.root)
        parts = ([] if self.overwrite else old) + [m.part for m in messages if m and m.part]
        store.create_dir(base, recursive=True)
        beside = f"{base}/CURRENT-{self.run}"
        with store.open_output_stream(beside) as out:
            out.write(json.dumps(parts).encode("utf-8"))
        store.move(beside, f"{base}/CURRENT")
        # What runs that failed have left, and what was listed before last, goes.
        listed = {p.split("/")[0] for p in [*old, *parts]}
        for info in store.get_file_info(fs.FileSelector(base)):
            if info.base_name.startswith("run-") and info.base_name not in listed:
                store.delete_dir(info.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        store, base = located(self.root)
        if store.get_file_info(f"{base}/{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.run}")


class PublishedFiles(DataSource):
    """The data source; register it with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "published_files"

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def publish(results: DataFrame, root: str, mode: str = "append") -> None:
    """Publishes rows (path, text) below ``root``."""
    results.sparkSession.dataSource.register(PublishedFiles)
    results.select("path", "text").write.format(PublishedFiles.name()).mode(mode).save(root)


def published(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all that is published below ``root``."""
    parts = parts_of(root)
    if not parts:
        return spark.createDataFrame([], "path string, text string")
    base = root.rstrip("/")
    entries = spark.read.schema(ENTRIES).json([f"{base}/{p}/entries.json" for p in parts])
    last = entries.groupBy("path").agg(F.max_by(F.struct("file", "size"), F.struct("run", "file")).alias("e")).select("path", "e.*").where("file is not null")
    bodies = spark.read.format("binaryFile").option("pathGlobFilter", "*.body").load([f"{base}/{p}" for p in parts])
    named = bodies.select(F.regexp_extract("path", r"(run-[0-9a-f]+/\d+/[^/]+/[^/]+)$", 1).alias("name"), F.decode("content", "utf-8").alias("text"))
    lost = F.raise_error(F.concat(F.lit("a published file is gone: "), F.col("file")))
    whole = F.when(F.col("size") == 0, "").otherwise(F.coalesce("text", lost))  # empty files aren't read
    return last.join(named, F.col("file") == F.col("name"), "left").select("path", whole.alias("text"))
