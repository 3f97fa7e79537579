"""Files in, rows of fragments, nodes and errors out: the parsers as Arrow map operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from treeloom.functions import paths
from treeloom.parse import fragments as fr
from treeloom.parse import tree


def languages(spark: SparkSession) -> DataFrame:
    """(ext, language): the registry as a dimension."""
    return spark.createDataFrame([(e, lang.name) for e, lang in sorted(fr.LANGUAGES.items())], "ext string, language string")


def with_language(files: DataFrame) -> DataFrame:
    """``files`` (path, ...) with ``language`` and ``inner_ext``: compound extensions first, then simple ones."""
    known = languages(files.sparkSession)
    ext, pair = paths.extension(F.col("path")), paths.compound_extension(F.col("path"))
    inner = F.when(pair["outer"] == "j2", pair["inner"])
    named = files.withColumns({"__ext": ext, "__inner": inner})
    joined = named.join(F.broadcast(known.withColumnsRenamed({"ext": "__ext"})), "__ext", "left").join(F.broadcast(known.select(F.col("ext").alias("__inner"), F.lit(True).alias("__known"))), "__inner", "left")
    return joined.withColumn("inner_ext", F.when(F.col("__known"), F.col("__inner"))).drop("__ext", "__inner", "__known")


def mapped(files: DataFrame, columns: str, rows_of: Callable[[str, str], Iterator[tuple]]) -> DataFrame:
    """One call for each file (path, text); its rows get the path. Texts that are null give none."""
    schema = StructType.fromDDL(f"path string, {columns}")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(path, *r) for r in rows_of(path, text)] if path is not None and text is not None else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return files.select("path", "text").mapInArrow(run, schema)


def fragments(files: DataFrame, depth: int = fr.MAX_DEPTH) -> DataFrame:
    """The fragments of files (path, text), flat; files without a decomposer give none."""

    def rows_of(path: str, text: str) -> Iterator[tuple]:
        found = fr.decompose(path, text, depth)
        return iter(()) if found is None else ((found[0], *r) for r in fr.fragment_rows(found[1], text, found[2]))

    return mapped(files, f"language string, {fr.FRAGMENT_COLUMNS}", rows_of)


def parsed(path: str, text: str) -> tree.Node | None:
    found = fr.language_for(path)
    return found[0].tree(text) if found is not None and found[1] is None and found[0].tree is not None else None


def nodes(files: DataFrame) -> DataFrame:
    """The syntax trees of files (path, text) as rows with nested-set numbers."""

    def rows_of(path: str, text: str) -> Iterator[tuple]:
        root = parsed(path, text)
        return iter(()) if root is None else tree.rows(root, text)

    return mapped(files, tree.NODE_COLUMNS, rows_of)


def parse_errors(files: DataFrame) -> DataFrame:
    """(path, row, byte, text) of what couldn't be read."""

    def rows_of(path: str, text: str) -> Iterator[tuple]:
        root = parsed(path, text)
        return iter(()) if root is None else iter(tree.errors(root, text))

    return mapped(files, "row long, byte long, text string", rows_of)


def validations(files: DataFrame) -> DataFrame:
    """(path, valid, message): whether files can be read; those without a tree are not judged."""

    def rows_of(path: str, text: str) -> Iterator[tuple]:
        root = parsed(path, text)
        if root is not None:
            message = tree.validate(root, text)
            yield message is None, message

    return mapped(files, "valid boolean, message string", rows_of)


def symbol_bodies(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, fs_path, body): the symbols ``wanted`` (path, fs_path) of any texts, such as old versions."""
    found = fragments(files).join(wanted, ["path", "fs_path"], "left_semi").select("path", "fs_path", "full_start", "byte_end")
    raw = files.select("path", F.encode("text", "utf-8").alias("raw"))
    body = F.decode(F.substring("raw", (F.col("full_start") + 1).cast("int"), (F.col("byte_end") - F.col("full_start")).cast("int")), "utf-8")
    return found.join(raw, "path").select("path", "fs_path", body.alias("body"))


def invariant_breaches(found: DataFrame) -> DataFrame:
    """Fragments that overlap their next sibling or stick out of their file's parent span."""
    from pyspark.sql import Window

    plain = found.where(~F.col("kind").isin(*fr.STRUCTURAL))
    order = Window.partitionBy("path", "parent_id").orderBy("byte_start", "ord")
    marked = plain.withColumn("next_start", F.lead("byte_start").over(order))
    parents = found.select("path", F.col("frag_id").alias("parent_id"), F.col("full_start").alias("ps"), F.col("full_end").alias("pe"))
    joined = marked.join(parents, ["path", "parent_id"], "left")
    return joined.where((F.col("byte_end") > F.col("next_start")) | (F.col("byte_start") < F.col("ps")) | (F.col("byte_end") > F.col("pe")))
