"""Fill-in-the-middle over an index of distinct texts.

A text is cut at two of its line boundaries into prefix, middle and suffix, and
put together again with sentinels so that a model learns to fill the middle.
Which cut, and which form, is drawn from a digest of the document's id.

Corpora hold many copies of one text, so boundaries are found once for each
*distinct* text: texts are grouped by SHA-256 and, within equal digests, by
their bytes (a set of texts; a digest that two texts share is an error, never
one entry). An entry keeps the places where its lines end as an Elias-Fano list, about
``2 + log2(chars / lines)`` bits a line, which answers "where does line k end"
by a select. Documents, as rows of id and digest, are joined with the entries
and pick the two ends that their seed names.

Scale: a text is shuffled once for each distinct text of a task, ids and lists
are narrow. A text with more than a thousandth of all documents (fewer than a
thousand by arithmetic, broadcast as digests) has its entry dealt over many
salts, so its copies don't meet in one task.

Defined results for odd input: a null text counts as empty; an empty text, one
that contains a sentinel, and one whose draw says so stay plain; a text without
a line feed is one line; ``\\r`` and other line ends don't cut; a null id is
drawn as the text ``null``; repeated rows give equal results, as often as they
come; texts of any length are cut whole; an empty table gives an empty result;
of the input only the two named columns are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from treeloom.llm.common import table, tidy, written


@dataclass(frozen=True)
class Infill:
    """Seed, sentinels, and the share of texts transformed and of those in suffix-first form, in percent."""

    seed: str = "7"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    percent: int = 100
    spm_percent: int = 50

    def __post_init__(self):
        marks = self.marks
        if len({m for m in marks}) < 3 or not all(marks) or any(a in b for a in marks for b in marks if a != b):
            raise ValueError("sentinels must be three texts, none of which holds another")
        if any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b)) + (a != b))):
            raise ValueError("no sentinel may end as one begins")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def line_ends(text: str) -> np.ndarray:
    """The code points before each line's end: one more than a line feed's place, and the end of the text."""
    codes = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.flatnonzero(codes == 10) + 1
    return ends if not len(codes) or codes[-1] == 10 else np.append(ends, len(codes))


def elias_fano(values: np.ndarray) -> bytes:
    """Rising numbers as low bits, packed, after high bits in unary; (count, low bits) as the first nine bytes."""
    n = len(values)
    if not n:
        return (0).to_bytes(8, "little") + b"\0"
    low_bits = max(0, int(values[-1] // n).bit_length() - 1)
    values = values.astype(np.uint64)
    high = np.zeros(n + int(values[-1] >> np.uint64(low_bits)), np.uint8)
    high[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
    low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
    high_bytes, low_bytes = (np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes() for x in (high, low))
    return n.to_bytes(8, "little") + bytes([low_bits]) + len(high_bytes).to_bytes(8, "little") + high_bytes + low_bytes


def count_of(listed: bytes) -> int:
    return int.from_bytes(listed[:8], "little")


_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def select(listed: bytes, k: int) -> int:
    """The number at place ``k`` of an Elias-Fano list: counted by bytes to the k-th set bit, then within that byte."""
    low_bits, size = listed[8], int.from_bytes(listed[9:17], "little")
    high = np.frombuffer(listed, np.uint8, size, 17)
    upto = np.cumsum(_ONES[high])
    at = int(np.searchsorted(upto, k + 1))
    left = k + 1 - int(upto[at - 1] if at else 0)
    byte, bit = int(high[at]), -1
    while left:
        bit += 1
        left -= byte >> bit & 1
    value = at * 8 + bit - k
    if low_bits:
        first = k * low_bits
        piece = int.from_bytes(listed[17 + size + first // 8 : 17 + size + (first + low_bits + 7) // 8], "little")
        value = value << low_bits | piece >> first % 8 & (1 << low_bits) - 1
    return value


@F.arrow_udf(StructType().add("n", LongType()).add("ends", BinaryType()))
@tidy
def bounds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The number of lines and the list of their ends."""
    for batch in batches:
        lists = [elias_fano(line_ends(t.as_py())) for t in batch]
        yield pa.StructArray.from_arrays([pa.array([count_of(x) for x in lists], pa.int64()), pa.array(lists, pa.binary())], ["n", "ends"])


@F.arrow_udf(StructType().add("low", LongType()).add("high", LongType()))
@tidy
def selected(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Where the first ``low`` and the first ``high`` lines of a list end."""

    def ends_of(lists: pa.Array, counts: pa.Array) -> pa.Array:
        return pa.array([select(x.as_py(), k - 1) if k else 0 for x, k in zip(lists, counts.to_pylist())], pa.int64())

    for lists, low, high in batches:
        yield pa.StructArray.from_arrays([ends_of(lists, low), ends_of(lists, high)], ["low", "high"])


def drawn(doc_id: Column, seed: str) -> list[Column]:
    """Four numbers below 2**32 from a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def digest_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def text_index(docs: DataFrame, hot: DataFrame, digest=digest_of) -> DataFrame:
    """(digest, salt, text): every distinct text of (doc_id, text), once for each salt of a hot one.

    Texts meet by digest in a set, which keeps those apart that differ in any
    byte; a digest with more than one text is an error.
    """
    sets = salted(docs.select("doc_id", "text", digest(F.col("text")).alias("digest")), hot).groupBy("digest", "salt").agg(F.collect_set("text").alias("texts"))
    only = F.when(F.size("texts") == 1, F.col("texts")[0]).otherwise(F.raise_error(F.concat(F.lit("different texts share the digest "), F.col("digest"))))
    return sets.select("digest", "salt", only.alias("text"))


def salted(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with ``salt``: 0, or for hot digests one of so many as they have thousandths of all rows."""
    found = rows.join(F.broadcast(hot.select(F.col("digest").alias("__hot"), "salts")), F.col("digest") == F.col("__hot"), "left")
    return found.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(0).cast("long"))).drop("__hot", "salts")


def infilled(docs: DataFrame, plan: Infill = Infill(), text: str = "text", doc_id: str = "doc_id", parts: int = 1000, digest=digest_of) -> DataFrame:
    """(doc_id, text, n, form, prefix, middle, suffix, output): each document cut at its seeded boundaries.

    ``form`` is plain, psm or spm; prefix, middle and suffix are null where it is plain.
    """
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    ids = written(docs.groupBy("doc_id", digest(F.col("text")).alias("digest")).agg(F.count(F.lit(1)).alias("times")), "infill")
    many = max((ids.agg(F.sum("times")).first()[0] or 0) / parts, 1)
    hot = ids.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > many).select("digest", F.ceil(F.col("rows") / many).alias("salts"))
    index = text_index(docs, hot, digest)
    lists = index.select(F.col("digest").alias("b_digest"), F.col("salt").alias("b_salt"), bounds("text").alias("b")).select("b_digest", "b_salt", "b.*")
    texts = index.select(F.col("digest").alias("t_digest"), F.col("salt").alias("t_salt"), "text")
    rows = salted(ids, hot)
    joined = rows.join(lists, (F.col("digest") == F.col("b_digest")) & (F.col("salt") == F.col("b_salt")))
    joined = joined.join(texts, (F.col("digest") == F.col("t_digest")) & (F.col("salt") == F.col("t_salt")))
    return cut(joined, plan)


def cut(rows: DataFrame, plan: Infill) -> DataFrame:
    """Forms and pieces of rows (doc_id, text, n, ends, times)."""
    h = drawn(F.col("doc_id"), plan.seed)
    a, b = (F.pmod(x, F.col("n") + 1) for x in h[:2])
    plain = (F.col("text") == "") | (F.pmod(h[2], F.lit(100)) >= plan.percent)
    for mark in plan.marks:
        plain = plain | F.contains(F.col("text"), F.lit(mark))
    form = F.when(plain, "plain").when(F.pmod(h[3], F.lit(100)) < plan.spm_percent, "spm").otherwise("psm")
    placed = rows.withColumn("form", form).withColumn("at", selected("ends", F.least(a, b), F.greatest(a, b)))
    low, high = F.col("at.low").cast("int"), F.col("at.high").cast("int")
    piece = lambda first, size: F.when(F.col("form") != "plain", F.substring("text", first, size))
    parts = placed.withColumns({"prefix": piece(F.lit(1), low), "middle": piece(low + 1, high - low), "suffix": piece(high + 1, F.length("text"))})
    p, s, m = map(F.lit, plan.marks)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm)
    each = parts.withColumn("output", output).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", "output")


def restored(output: Column, form: Column, plan: Infill = Infill()) -> Column:
    """The text that ``output`` was made from, by its sentinels alone."""
    p, s, m = map(F.lit, plan.marks)

    def between(first: Column, second: Column) -> Column:
        bare = F.substring(output, F.length(first) + 1, F.length(output))
        one, rest = F.split_part(bare, second, F.lit(1)), F.split_part(bare, second, F.lit(2))
        return F.struct(one.alias("one"), F.split_part(rest, m, F.lit(1)).alias("two"), F.split_part(rest, m, F.lit(2)).alias("middle"))

    psm, spm = between(p, s), between(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(psm["one"], psm["middle"], psm["two"])).otherwise(F.concat(spm["two"], spm["middle"], spm["one"]))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infilled(table(spark, sf_dir, "documents", "doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents
), r AS (
  SELECT *, len(u) AS n, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) AS h1, CAST(('0x' || substr(h, 9, 8)) AS BIGINT) AS h2,
         CAST(('0x' || substr(h, 25, 8)) AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
