"""Mixing sources to target weights.

The size of a document is its number of words. Sizes are summed for each
source, every source gets a target, and the rate target/size says how often a
document goes into the mix: floor(rate) times, and once more with the
probability that is left over. That last draw is a hash of the document, so
reruns and retried tasks agree.

Targets share the total size by weight, but none may exceed ``most`` times its
source; what is cut off is shared out again by weight. That is the level
``x`` with ``sum(min(most * size, weight * x)) = total``. Sources whose cap lies
below the level are found by repeated aggregation, each round of which returns
two numbers to the driver; the level only rises, so the rounds end.

Defined results for odd input: a null or empty text has size 0 and is taken 0
times in words (its row stays); a null source is a source of its own, after
all others; sources of no words have target 0 and rate 0; repeated rows with
the same doc_id draw alike; an empty table gives an empty result; further
columns are carried through where the caller keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.llm.common import fresh, looked_up, table, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEED = "mix"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    bare = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.regexp_count(bare, F.lit("[^ ]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of a digest of the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``nth``, their place by code point, null last.

    Rows are sorted over all partitions; each partition's count is added up on
    the driver, one number for each partition.
    """
    ordered = written(
        sources.repartitionByRange(F.col("source").asc_nulls_last())
        .sortWithinPartitions(F.col("source").asc_nulls_last())
        .withColumn("part", F.spark_partition_id()),
        "sources",
    )
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, bases = 0, []
    for part, n in sizes:
        bases.append((part, before))
        before += n
    spark = sources.sparkSession
    base = spark.createDataFrame(bases, "part int, base long")
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    return ordered.join(F.broadcast(base), "part").withColumn("nth", F.col("base") + F.row_number().over(inside) - 1)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size, n_rows) with ``target``."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    weighed = written(numbered(sizes).withColumn("weight", weight), "weights")
    cap = F.col("source_size") * F.lit(most)
    total, level = weighed.agg(F.sum("source_size")).first()[0] or 0, 0.0
    while total:
        over = cap <= F.col("weight") * F.lit(level)
        fixed, free = weighed.agg(F.sum(F.when(over, F.col("source_size")).otherwise(0)), F.sum(F.when(~over, F.col("weight")).otherwise(0.0))).first()
        if not free:
            break
        higher = (total - most * fixed) / free
        if higher <= level:
            break
        level = higher
    return weighed.select("source", "source_size", "n_rows", F.least(cap, F.col("weight") * F.lit(float(level))).alias("target"))


def rated(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, most: float = MOST, seed: str = SEED, words: Column | None = None) -> DataFrame:
    """``docs`` with a struct column ``mix_``: size, source_size, target and copies.

    ``words`` is the size, where it is known already; else it is counted in ``text``.
    """
    size, key, found = (fresh(f"mix_{n}", docs) for n in ("size", "key", "found"))
    sized = docs.withColumn(size, word_count(F.col(f"`{text}`").cast("string")) if words is None else words).withColumn(key, F.col(f"`{source}`").cast("string"))
    sizes = sized.groupBy(F.col(key).alias("source")).agg(F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    aims = targets(sizes, weights, most).select(F.col("source").alias(key), F.struct("source_size", "target").alias(found), "n_rows")
    total = aims.agg(F.sum("n_rows")).first()[0] or 0
    joined = looked_up(sized, aims, key, found, "n_rows", total, doc_id)
    row = F.col(found)
    rate = F.when(row["source_size"] > 0, row["target"] / row["source_size"]).otherwise(0.0)
    extra = (draw(F.col(f"`{doc_id}`"), seed) < rate - F.floor(rate)).cast("long")
    mix = F.struct(F.col(size).alias("size"), row["source_size"].alias("source_size"), row["target"].alias("target"), (F.floor(rate) + extra).alias("copies"))
    return joined.withColumn(fresh("mix_", docs), mix).drop(size, key, found)


def mix(docs: DataFrame, **options) -> DataFrame:
    """Every document as often as the mix takes it, with the columns it came with."""
    name, nth = fresh("mix_", docs), fresh("mix_nth", docs)
    taken = rated(docs, **options).where(F.col(name)["copies"] > 0)
    return taken.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(name)["copies"]))).select(*[f"`{c}`" for c in docs.columns])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    counted = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("words")), "sizes")  # texts are read once
    m = F.col("mix_")
    return rated(counted, words=F.col("words")).select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["size"] * m["copies"]).alias("taken"))


OP9_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM sized GROUP BY source
), total AS (SELECT CAST(sum(source_size) AS DOUBLE) AS t FROM sources
), levels(n, level) AS (
  SELECT 0, 0.0::DOUBLE
  UNION ALL
  SELECT n + 1, higher FROM (
    SELECT l.n, l.level,
           (SELECT (t - 3.0::DOUBLE * (SELECT coalesce(sum(CASE WHEN source_size * 3.0::DOUBLE <= weight * l.level THEN source_size ELSE 0 END), 0) FROM sources))
                   / (SELECT nullif(sum(CASE WHEN source_size * 3.0::DOUBLE <= weight * l.level THEN 0.0::DOUBLE ELSE weight END), 0) FROM sources)
            FROM total) AS higher
    FROM levels l) WHERE higher > level
), aims AS (
  SELECT source, source_size, least(source_size * 3.0::DOUBLE, weight * (SELECT max(level) FROM levels)) AS target FROM sources
), rates AS (
  SELECT d.doc_id, d.size, a.source_size, a.target,
         CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0.0 END AS rate,
         CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM rates
"""
