"""Tagged comments: scanning, blocks, index and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions import text
from treeloom.operators.aggregates import bucketed, priority

#: Tags in order of priority.
TAGS = ["FIXME", "TODO", "HACK", "XXX", "SAFETY", "NOTE"]
COMMENT = r"^\s*(?://|#|\* |/\*)"


def has_tag(body: Column, tags: list[str]) -> Column:
    """Whether any tag occurs, in any case: a cheap test before the scan."""
    return body.rlike("(?i)" + "|".join(tags))


def tag_lines(files: DataFrame, key: str, body: str, tags: list[str]) -> DataFrame:
    """(key, line_no, column, tag, after): matches of tags, left to right and not overlapping, on every line.

    Where several tags begin at one place, the first in the list counts.
    """
    pattern = "(?i)(" + "|".join(tags) + ")"
    rows = files.where(has_tag(F.col(body), tags)).select(key, F.posexplode(F.split(F.col(body), "\n")).alias("i", "line")).where(has_tag(F.col("line"), tags))
    pairs = F.arrays_zip(F.split("line", pattern).alias("before"), F.regexp_extract_all("line", F.lit(pattern)).alias("hit"))
    each = rows.select(key, "i", "line", F.posexplode(pairs).alias("k", "pair")).where("pair.hit is not null")
    so_far = Window.partitionBy(key, "i").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    column = F.sum(F.length("pair.before") + F.length("pair.hit")).over(so_far) - F.length("pair.hit")
    placed = each.withColumn("column", column.cast("int"))
    return placed.select(key, (F.col("i") + 1).cast("long").alias("line_no"), "line", "column", F.upper("pair.hit").alias("tag"), F.substring("line", F.col("column") + F.length("pair.hit") + 1, F.length("line")).alias("after"))


def in_comment(line: Column, column: Column) -> Column:
    """Whether a place on a line lies in a comment, as its beginning or a comment sign before it tell."""
    return line.rlike(COMMENT) | F.substring(line, F.lit(1), column).rlike(r"//|#|/\*")


def comment_blocks(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line_no, block_first, block_last): comment lines with the bounds of their run of one prefix."""
    rows = files.select(key, F.posexplode(F.split(F.col(body), "\n")).alias("i", "line"))
    prefix = F.regexp_extract("line", r"^\s*(//|#)", 1)
    marked = rows.withColumn("prefix", prefix)
    run = F.row_number().over(Window.partitionBy(key).orderBy("i")) - F.row_number().over(Window.partitionBy(key, "prefix").orderBy("i"))
    comments = marked.withColumn("run", run).where("prefix <> ''")
    whole = Window.partitionBy(key, "prefix", "run")
    return comments.select(key, (F.col("i") + 1).cast("long").alias("line_no"), "line", (F.min("i").over(whole) + 1).cast("long").alias("block_first"), (F.max("i").over(whole) + 1).cast("long").alias("block_last"))


def entries(files: DataFrame, key: str, body: str, tags: list[str] = TAGS) -> DataFrame:
    """(key, line_no, tag, text, entry): tagged comments that say something after a colon; text runs to the end of their block."""
    hits = tag_lines(files, key, body, tags)
    said = hits.where(in_comment(F.col("line"), F.col("column"))).withColumn("said", text.tag_suffix(F.col("after"))).where("said is not null")
    blocks = comment_blocks(files, key, body)
    # A tag's own line names its block, and the block's lines are met by its first one.
    owned = said.join(blocks.select(key, "line_no", F.col("block_first").alias("block")), [key, "line_no"], "left")
    later = owned.alias("s").join(blocks.alias("b"), (F.col(f"s.{key}") == F.col(f"b.{key}")) & (F.col("b.block_first") == F.col("s.block")) & (F.col("b.line_no") > F.col("s.line_no")), "left")
    rest = F.regexp_replace("b.line", r"^\s*(?://+|#+)!?/? ?", "")
    lines_ = F.array_sort(F.collect_list(F.when(F.col("b.line_no").isNotNull(), F.struct(F.col("b.line_no").alias("n"), rest.alias("t")))))
    grouped = later.groupBy(F.col(f"s.{key}").alias(key), F.col("s.line_no").alias("line_no"), F.col("s.column").alias("column"), F.col("s.tag").alias("tag"), F.col("s.said").alias("said")).agg(lines_.alias("more"))
    whole = F.trim(F.array_join(F.concat(F.array("said"), F.transform("more", lambda r: r["t"])), "\n"))
    return grouped.select(key, "line_no", "tag", whole.alias("text"), text.entry_slug(whole).alias("entry"))


def index(spark: SparkSession, found: DataFrame, tags: list[str] = TAGS) -> DataFrame:
    """(tag, n, nth): entries by tag, also tags without any."""
    return bucketed(spark, found, "tag", tags)


def overview(found: DataFrame, key: str, tags: list[str] = TAGS) -> DataFrame:
    """Entries by file, then by the tag's place in the list, then by line."""
    return found.withColumn("place", priority(F.col("tag"), tags)).orderBy(key, "place", "line_no")
