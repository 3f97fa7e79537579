"""Section trees from headings, as relational operators.

Headings are rows (key, pos, level) of a document; a section runs from its
heading to the next one of the same or a higher rank (a level that isn't
greater), and lies in the nearest section before it with a smaller level. Both
follow from running windows, one for each of the six levels, so no section is
joined with another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import text

LEVELS = 6


def nested(headings: DataFrame, key: str, pos: str, level: str, end: str) -> DataFrame:
    """``headings`` with ``section_end``, ``parent`` (the pos of the enclosing heading) and ``depth``.

    ``end`` names the column with the document's end.
    """
    after = Window.partitionBy(key).orderBy(pos).rowsBetween(1, Window.unboundedFollowing)
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    out = headings
    nexts, lasts = [], []
    for n in range(1, LEVELS + 1):
        out = out.withColumns({
            f"__n{n}": F.min(F.when(F.col(level) == n, F.col(pos))).over(after),
            f"__l{n}": F.max(F.when(F.col(level) == n, F.col(pos))).over(before),
        })
        nexts.append(F.when(F.col(level) >= n, F.col(f"__n{n}")))
        lasts.append(F.when(F.col(level) > n, F.col(f"__l{n}")))
    out = out.withColumns({"section_end": F.coalesce(F.least(*nexts), F.col(end)), "parent": F.greatest(*lasts)})
    return out.drop(*[f"__{x}{n}" for n in range(1, LEVELS + 1) for x in "nl"])


def markdown_lines(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line_no, begin, line, in_code, heading level or null, title) of Markdown texts.

    ``begin`` is the byte at which a line starts, from 0. Fences open with
    three or more backticks or tildes; headings in code don't count.
    """
    parts = files.select(key, F.posexplode(F.split(F.col(body), "\n")).alias("i", "line"))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike("^ {0,3}(?:```|~~~)")
    marked = parts.withColumns({
        "begin": F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)),
        "fence": fence,
        "fences": F.sum(F.when(fence, 1).otherwise(0)).over(so_far),
    })
    in_code = (F.col("fences") % 2 == 1) | F.col("fence")
    hashes = F.regexp_extract("line", r"^ {0,3}(#{1,6})(?:[ \t]|$)", 1)
    return marked.select(
        key, (F.col("i") + 1).cast("long").alias("line_no"), "begin", "line", in_code.alias("in_code"), "fence", "fences",
        F.when(~in_code & (hashes != ""), F.length(hashes)).alias("level"),
        F.regexp_replace(F.trim(F.regexp_extract("line", r"^ {0,3}#{1,6}(.*)$", 1)), r"[ \t]+#+$", "").alias("title"),
    )


def markdown_sections(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, name, kind, level, byte_start, byte_end, parent_start, ord, fs_name): sections, preamble and code blocks.

    Sections nest by rank. Text before the first heading is a preamble if it
    isn't blank. A code block belongs to the innermost section around it, and
    its language is the name after its fence.
    """
    rows = markdown_lines(files, key, body)
    ends = files.select(key, F.octet_length(body).alias("n_bytes"), F.col(body).alias("__body"))
    headings = nested(rows.where("level is not null").join(ends.select(key, "n_bytes"), key), key, "begin", "level", "n_bytes")
    sections = headings.select(key, F.col("title").alias("name"), F.lit("section").alias("kind"), "level", F.col("begin").alias("byte_start"), F.col("section_end").alias("byte_end"), F.col("parent").alias("parent_start"))
    first = rows.groupBy(key).agg(F.min(F.when(F.col("level").isNotNull(), F.col("begin"))).alias("first"))
    head = ends.join(first, key).withColumn("stop", F.coalesce("first", "n_bytes"))
    opening = F.decode(F.substring(F.encode("__body", "utf-8"), F.lit(1), F.col("stop").cast("int")), "utf-8")
    preamble = head.where(F.trim(F.regexp_replace(opening, r"\s", "")) != "").select(
        key, F.lit("preamble").alias("name"), F.lit("preamble").alias("kind"), F.lit(None).cast("int").alias("level"), F.lit(0).cast("long").alias("byte_start"), F.col("stop").cast("long").alias("byte_end"), F.lit(None).cast("long").alias("parent_start")
    )
    last_heading = F.last(F.when(F.col("level").isNotNull(), F.col("begin")), ignorenulls=True).over(Window.partitionBy(key).orderBy("line_no"))
    fenced = rows.withColumn("section", last_heading).where("in_code").withColumn("block", F.ceil(F.col("fences") / 2))
    blocks = fenced.groupBy(key, "block").agg(
        F.nullif(F.regexp_extract(F.min_by("line", "line_no"), r"^ {0,3}(?:`{3,}|~{3,})[ \t]*([^ \t`{]*)", 1), F.lit("")).alias("name"),
        F.min("begin").alias("byte_start"), F.max(F.col("begin") + F.octet_length("line") + 1).alias("stop"), F.min("section").alias("parent_start"),
    )
    blocks = blocks.join(ends.select(key, "n_bytes"), key).select(
        key, "name", F.lit("code").alias("kind"), F.lit(None).cast("int").alias("level"), "byte_start", F.least("stop", "n_bytes").alias("byte_end"), "parent_start"
    )
    every = sections.select(key, "name", "kind", F.col("level").cast("int").alias("level"), F.col("byte_start").cast("long"), F.col("byte_end").cast("long"), F.col("parent_start").cast("long")).unionByName(preamble).unionByName(blocks.select(key, "name", "kind", "level", F.col("byte_start").cast("long"), F.col("byte_end").cast("long"), F.col("parent_start").cast("long")))
    place = F.row_number().over(Window.partitionBy(key, "parent_start", F.col("kind") == "code").orderBy("byte_start")) - 1
    named = every.withColumn("ord", place.cast("int"))
    prefix = F.lpad(F.col("ord").cast("string"), F.greatest(F.length(F.col("ord").cast("string")), F.lit(2)), F.lit("0"))
    fs_name = F.when(F.col("kind") == "section", F.concat(prefix, F.lit("-"), F.coalesce(F.nullif(text.bounded_slug(F.col("name"), 40), F.lit("")), F.lit("section")))).when(F.col("kind") == "preamble", F.concat(prefix, F.lit("-preamble")))
    code_name = F.concat((F.col("ord") + 1).cast("string"), F.lit("."), F.coalesce("name", F.lit("txt")))
    return named.withColumn("fs_name", F.coalesce(fs_name, code_name))


def toml_sections(files: DataFrame, key: str, body: str) -> DataFrame:
    """(key, name, kind, byte_start, byte_end, fs_name): the tables of TOML texts and what stands before them."""
    parts = files.select(key, F.posexplode(F.split(F.col(body), "\n")).alias("i", "line"))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    quotes = lambda mark: F.regexp_count("line", F.lit(mark))
    rows = parts.withColumns({
        "begin": F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)),
        "open": F.coalesce(F.sum(quotes('"""') + quotes("'''")).over(before), F.lit(0)) % 2,
    })
    head = F.regexp_extract("line", r"^\s*\[\[?\s*([^\[\]]+?)\s*\]\]?\s*(?:#.*)?$", 1)
    tables = rows.withColumn("name", F.when((F.col("open") == 0), F.nullif(head, F.lit("")))).where("name is not null")
    ends = files.select(key, F.octet_length(body).cast("long").alias("n_bytes"), F.col(body).alias("__body"))
    after = Window.partitionBy(key).orderBy("begin")
    mods = tables.join(ends.select(key, "n_bytes"), key).select(key, "name", F.lit("module").alias("kind"), F.col("begin").cast("long").alias("byte_start"), F.coalesce(F.lead("begin").over(after), F.col("n_bytes")).cast("long").alias("byte_end"))
    first = ends.join(tables.groupBy(key).agg(F.min("begin").alias("first")), key, "left").withColumn("stop", F.coalesce("first", "n_bytes").cast("long"))
    opening = F.decode(F.substring(F.encode("__body", "utf-8"), F.lit(1), F.col("stop").cast("int")), "utf-8")
    pre = first.where(F.regexp_replace(opening, r"\s", "") != "").select(key, F.lit("preamble").alias("name"), F.lit("preamble").alias("kind"), F.lit(0).cast("long").alias("byte_start"), F.col("stop").alias("byte_end"))
    from treeloom.operators.sequences import numbered_names

    return numbered_names(mods.unionByName(pre).withColumn("slugged", text.slug(F.col("name"))), [key], "slugged", "byte_start").drop("slugged")
