"""SimHash fingerprints, and all of them within a Hamming radius.

Each term of a text (a run of five words or of two, in lower case; a shorter
text is one run) is hashed to 64 bits and votes with its weight, one plus the
logarithm of how often it occurs: for a set bit with plus, for a clear one with
minus. The signs of the sums are the fingerprint. The angle between two texts' weighted terms is then
about ``pi * distance / 64``, and its cosine is the likeness given here, 1 for
equal fingerprints and 0 from 32 differing bits on.

:func:`within` finds all pairs that differ in at most ``radius`` bits. The 64
bits are divided into blocks; of any two such fingerprints all blocks but
``radius`` agree, so a table for each choice of ``blocks - radius`` blocks,
those moved to the front, holds the pair under one key. Pairs are compared
inside a key and counted in the first table that holds them, so none is missed
and none counted twice; no pair is written. Equal fingerprints are one row.

A key with many fingerprints is dealt into slots of at most about
``bucket_limit``, each pair of slots a group of its own, so a task holds two
slots at most; no key is cut.

Defined results for odd input: null and empty texts, and those of white space,
have no term, so all sums are 0 and so is the fingerprint; a sum of 0 is a clear
bit; long texts are split and counted in pieces; equal texts have equal
fingerprints; repeated rows count as documents of their own in the search; an
empty table gives an empty result; further columns pass through untouched.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from treeloom.llm.common import looked_up, table, tidy, written

BITS = 64
#: Words in a run: five as elsewhere, and two, so that short texts have more than one term.
WIDTHS = (2, 5)
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Stands for a null id, after all others.
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Tables:
    """Radius and number of blocks; ``bucket_limit`` fingerprints are compared at once."""

    radius: int = 3
    blocks: int = 5
    bucket_limit: int = 4096

    def __post_init__(self):
        if not 0 <= self.radius < self.blocks <= BITS:
            raise ValueError("blocks must outnumber the radius")
        agreeing = self.blocks - self.radius
        if math.comb(self.blocks, self.radius) << min(BITS, math.ceil(BITS / self.blocks) * agreeing) > 1 << BITS:
            raise ValueError("the number of a table and its bits must fit in 64 bits")

    def tables(self) -> list[tuple[tuple[int, int], ...]]:
        """The (place, size) of the blocks that agree in each table."""
        cuts = [round(i * BITS / self.blocks) for i in range(self.blocks + 1)]
        whole = [(a, b - a) for a, b in itertools.pairwise(cuts)]
        return list(itertools.combinations(whole, self.blocks - self.radius))

    def masks(self) -> list[int]:
        return [sum((1 << size) - 1 << at for at, size in t) for t in self.tables()]

    def keys(self, fingerprint: Column) -> Column:
        """For each table the blocks that agree, moved together, behind the table's number."""
        found = []
        for nth, t in enumerate(self.tables()):
            key = F.lit(nth).cast("long")
            for at, size in t:
                key = F.shiftleft(key, size) + F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
            found.append(F.struct(F.lit(nth).alias("nth"), key.alias("key")))
        return F.array(*found)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers: shifts and odd multipliers, invertible."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A number for each word, piece by piece; a word never lies in two pieces."""
    from xxhash import xxh3_64_intdigest

    out, start = [], 0
    while start < len(raw):
        end = min(len(raw), start + PIECE)
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = raw[start:end].split()
        out.append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
        start = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def term_hashes(raw: bytes, widths: tuple[int, ...] = WIDTHS) -> np.ndarray:
    """A number for each run of as many words as each width says; a shorter text is one run, an empty one has none."""
    h, out = word_hashes(raw), [np.empty(0, np.uint64)]
    for width in (min(w, len(h)) for w in widths if len(h)):
        runs = np.zeros(len(h) - width + 1, np.uint64)
        for i in range(width):
            runs = mixed(runs * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(runs)])
        out.append(runs)
    return np.concatenate(out)


def fingerprint_of(text: str | None, widths: tuple[int, ...] = WIDTHS) -> int:
    """The signs of the sums of all terms' votes, as an unsigned number."""
    terms, times = np.unique(term_hashes((text or "").lower().encode(), widths), return_counts=True)
    weights, sums = 1 + np.log(times), np.zeros(BITS)
    for i in range(0, len(terms), 1 << 16):
        bits = np.unpackbits(terms[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        part = weights[i : i + (1 << 16)]
        sums += 2 * (part @ bits) - part.sum()
    return int.from_bytes(np.packbits(sums > 1e-9, bitorder="little").tobytes(), "little")


def simhash(text: Column, widths: tuple[int, ...] = WIDTHS) -> Column:
    """The fingerprint of each text as a signed 64-bit number."""

    @tidy
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = (fingerprint_of(t.as_py(), widths) for t in batch)  # one text at a time
            yield pa.array(np.fromiter(found, np.uint64, len(batch)).view(np.int64))

    return F.arrow_udf(prints, "bigint")(text.cast("string"))


def shown(fingerprint: Column) -> Column:
    """Sixteen hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """The cosine that the number of differing bits stands for, 0 to 1."""
    apart = F.bit_count(a.bitwiseXOR(b))
    return F.when(apart == 0, 1.0).when(apart * 2 >= BITS, 0.0).otherwise(F.cos(apart * F.lit(np.pi / BITS)))


def followed(docs: DataFrame, doc_id: str, text: str, **more: Column) -> DataFrame:
    """(part, kind, times, row, next): each document with the next one by id, after the last the first, as structs of id, text and the columns ``more``.

    Null ids come first, and documents of one id by digest. Rows with equal id
    and text are one document that comes ``times`` (a table of one document is
    followed by itself); the columns ``more`` are made from the text once rows
    are sorted, not in the sample before. Rows are sorted over all partitions
    and read in order, one document ahead. The
    last document of a partition (kind 2) lacks its next, which is the first
    (kind 1, an extra row) of the next partition: :func:`closed` joins them.
    """
    keyed = docs.select(doc_id, text, F.struct(F.col(doc_id), F.sha2(F.col(text).cast("binary"), 256)).alias("key"))
    placed = keyed.repartitionByRange("key").sortWithinPartitions("key").withColumns(more).select(F.struct(doc_id, text, *more).alias("row"), "key")
    names, kind = ["part", "kind", "times", "row", "next"], placed.schema["row"].dataType
    schema = StructType()
    for name, type_ in zip(names, [LongType()] * 3 + [kind] * 2):
        schema = schema.add(name, type_)

    @tidy
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, times, key = TaskContext.get().partitionId(), None, 0, None

        def batch(k: int, counts, rows: pa.Array, following: pa.Array | None = None) -> pa.RecordBatch:
            same = [pa.array([x] * len(rows), pa.int64()) for x in (part, k)]
            return pa.RecordBatch.from_arrays([*same, pa.array(counts, pa.int64()), rows, pa.nulls(len(rows), rows.type) if following is None else following], names)

        for b in batches:
            rows, keys = b.column("row"), b.column("key").to_pylist()
            starts = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else key)]
            times += starts[0] if starts else len(keys)
            if not starts:
                continue
            found, counts = rows.take(pa.array(starts)), np.diff([*starts, len(keys)]).tolist()
            if held is None:
                yield batch(1, [0], found.slice(0, 1))
            else:
                found, counts = pa.concat_arrays([held, found]), [times, *counts]
            if len(found) > 1:
                yield batch(0, counts[:-1], found.slice(0, len(found) - 1), found.slice(1))
            held, times, key = found.take(pa.array([len(found) - 1])), counts[-1], keys[-1]
        if held is not None:
            yield batch(2, [times], held)

    return placed.mapInArrow(pairs, schema)


def closed(pairs: DataFrame) -> DataFrame:
    """(times, row, next) of pairs from :func:`followed` that have been written: last rows meet the first of the next partition."""
    spark = pairs.sparkSession
    firsts = pairs.where("kind = 1").select(F.col("part").alias("first_part"), F.col("row").alias("first"))
    parts = sorted(r[0] for r in firsts.select("first_part").collect())  # a number for each partition
    links = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "last_part long, following long")
    lasts = pairs.where("kind = 2").join(F.broadcast(links), F.col("part") == F.col("last_part")).join(firsts, F.col("following") == F.col("first_part"))
    return pairs.where("kind = 0").select("times", "row", "next").unionByName(lasts.select("times", "row", F.col("first").alias("next")))


def compared(prints: np.ndarray, other: np.ndarray | None, masks: np.ndarray, nth: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs within ``radius`` whose first common table is ``nth``: among ``prints``, or between them and ``other``."""
    right = prints if other is None else other
    for i in range(0, len(prints), 512):
        x = prints[i : i + 512, None] ^ right[None, :]
        a, b = np.nonzero((np.bitwise_count(x) <= radius) & (x != 0))
        a, x = a + i, x[a, b]
        keep = np.ones(len(a), bool) if other is not None else a < b
        keep &= (x & masks[nth]) == 0
        for m in masks[:nth]:
            keep &= (x & m) != 0
        yield a[keep], b[keep]


def within(prints: DataFrame, plan: Tables = Tables()) -> DataFrame:
    """(fingerprint, n_near, near_id) of rows (fingerprint, n, first_id), one for each fingerprint.

    ``n_near`` is the sum of ``n`` over the others within the radius and
    ``near_id`` their least ``first_id``. Fingerprints without any have no row.
    """
    rows = prints.withColumn("table", F.explode(plan.keys(F.col("fingerprint")))).select("table.nth", "table.key", "fingerprint", "n", F.coalesce("first_id", F.lit(LAST)).alias("first_id"))
    sizes = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "prints")
    total = prints.count() * len(plan.tables())
    sized = looked_up(rows, sizes.withColumn("size", F.col("rows")), "key", "size", "rows", total, "fingerprint").where("size is not null")
    slots = F.ceil(F.col("size") / plan.bucket_limit)
    slot = F.pmod(F.xxhash64("fingerprint"), slots)
    dealt = sized.withColumn("slots", slots).withColumn("slot", slot).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)))
    pair = [F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high")]
    groups = dealt.groupBy("key", "nth", *pair).agg(F.collect_list(F.struct("fingerprint", "n", "first_id", "slot")).alias("members")).where(F.size("members") > 1)
    known, radius = np.array(plan.masks(), np.uint64), plan.radius

    @tidy
    def near(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for tables, low, high, members in batches:
            out = []
            for nth, a, b, group in zip(tables.to_pylist(), low.to_pylist(), high.to_pylist(), members):
                p, n, first, at = (group.values.field(c).to_numpy(zero_copy_only=False) for c in ("fingerprint", "n", "first_id", "slot"))
                p, count, least = p.view(np.uint64), np.zeros(len(p), np.int64), np.full(len(p), LAST)
                left = np.flatnonzero(at == a)
                right = left if a == b else np.flatnonzero(at == b)
                for i, j in compared(p[left], None if a == b else p[right], known, nth, radius):
                    i, j = left[i], right[j]
                    for x, y in ((i, j), (j, i)):
                        np.add.at(count, x, n[y])
                        np.minimum.at(least, x, first[y])
                some = np.flatnonzero(count)
                out.append([{"fingerprint": int(p.view(np.int64)[k]), "n": int(count[k]), "first_id": int(least[k])} for k in some])
            yield pa.array(out, pa.list_(pa.struct([("fingerprint", pa.int64()), ("n", pa.int64()), ("first_id", pa.int64())])))

    found = groups.select(F.explode(F.arrow_udf(near, "array<struct<fingerprint:bigint,n:bigint,first_id:bigint>>")("nth", "low", "high", "members")).alias("f"))
    return found.groupBy("f.fingerprint").agg(F.sum("f.n").alias("n_near"), F.nullif(F.min("f.first_id"), F.lit(LAST)).alias("near_id"))


def near_prints(docs: DataFrame, fingerprint: str, doc_id: str, plan: Tables = Tables()) -> DataFrame:
    """``docs`` with ``n_near``, other documents within the radius, equal ones included, and ``near_id``, the least id among all of these and its own."""
    each = written(docs.groupBy(F.col(fingerprint).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"), F.min(doc_id).alias("first_id")), "prints")
    near = within(each, plan).withColumnRenamed("fingerprint", "near_print").withColumnRenamed("near_id", "other_id")
    facts = each.join(near, F.col("fingerprint") == F.col("near_print"), "left")
    found = written(facts.select("fingerprint", "n", F.struct((F.coalesce("n_near", F.lit(0)) + F.col("n") - 1).alias("n_near"), F.least("first_id", "other_id").alias("near_id")).alias("near")), "prints")
    total = found.agg(F.sum("n")).first()[0] or 0
    joined = looked_up(docs.withColumn("fingerprint_", F.col(fingerprint)), found.select(F.col("fingerprint").alias("fingerprint_"), "n", "near"), "fingerprint_", "near", "n", total, doc_id)
    return joined.select(*docs.columns, "near.n_near", "near.near_id")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    text, after = F.col("row.text"), F.col("next.text")
    size = F.length(text)
    tail = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), size - tail), F.substring(after, F.lit(1), tail))
    facts = [F.col("row.doc_id").alias("doc_id"), size.cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), F.col("row.fingerprint").alias("own"), simhash(edited).alias("changed"), F.col("next.fingerprint").alias("following")]
    pairs, bare = followed(docs, "doc_id", "text", fingerprint=simhash(F.col("text"))), F.col("kind") == 0
    # Texts are written for the ends of partitions only; of all other rows, what was made from them.
    kept = written(pairs.select("part", "kind", "times", F.when(~bare, F.col("row")).alias("row"), F.when(bare, F.struct(*facts)).alias("facts")), "prints")
    ends = kept.where("kind > 0").select("part", "kind", "times", "row", F.lit(None).cast(kept.schema["row"].dataType).alias("next"))
    each = kept.where("kind = 0").select("times", "facts.*").unionByName(closed(ends).select("times", *facts))
    made = each.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("time", "times")
    found = near_prints(made, "own", "doc_id")
    return found.select("doc_id", "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("changed")).alias("edited_fingerprint"),
                        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"), "n_near", "near_id")
