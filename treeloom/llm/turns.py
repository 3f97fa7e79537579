"""A trie of conversations' prefixes, with totals of every subtree.

A node is a sequence of turns that some conversation begins with. Turns are
sorted over all partitions by conversation and place and read in order
(:func:`carried`): each partition is first summed up in one small record, how
many turns of which conversation it has and what they do to the hash of a
prefix; the driver carries a state over the records, one for each partition, and
then every partition knows where it begins. So a conversation may span
partitions, and its turns never meet in one task. A prefix is known by its
length and the value of a polynomial in its turns' SHA-256 digests modulo the
prime ``2**255 - 19``.

Totals come by peeling leaves. Of equal prefixes the smallest conversation
names the node, so nodes of one name are a path; runs of a path in which every
node has the next as its only child are one unit with one sum, found by the same
carried reading. Units hold a counter of children that have yet to report.
In each round those at 0 send their totals to their parents, which add them up
and count down, until only the root's unit is left and has finished. Rounds are
as many as units lie above each other, not as many as turns.

Defined results for odd input: turns are ordered by number, null first, those of
one number by the digest of role and text; null role and text are empty; rows
repeated are turns of their own; rows without a conversation id belong to no
conversation; conversations that end up without a turn are members of the root;
the remainder of a negative id takes its sign (-3 is rebuilt from 0); texts of
any length are read whole and only their digests and word counts travel; an
empty table has no nodes; only the named columns are read, so others can't clash.

The ids that end at a node are hashed in order, a sequence that one task reads,
two numbers a row, however long the list.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructType

from treeloom.llm.common import looked_up, released, scratch, shared_dir, table, tidy, written
from treeloom.llm.mixing import word_count

PRIME = (1 << 255) - 19
BASE = int.from_bytes(hashlib.sha256(b"prefix").digest(), "big") % PRIME
ROOT = 1
#: Conversations of one block begin as its first one does, by fewer than so many turns.
BLOCK, HEADS = 20, 4

KINDS = {"long": (LongType(), pa.int64()), "binary": (BinaryType(), pa.binary()), "boolean": (BooleanType(), pa.bool_()), "string": (StringType(), pa.string())}


def chained(first: dict, rest: Iterator[dict]) -> Iterator[dict]:
    yield first
    yield from rest


def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def sorted_parts(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` sorted over all partitions, kept so, with ``part``, their partition's number."""
    shared_dir(rows.sparkSession)  # where checkpoints go
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).checkpoint()


def carried(rows: DataFrame, summed: Callable[[Iterator[dict]], object], onward: Callable[[object, object], object], read: Callable[[object, object, Iterator[dict]], Iterator[tuple]], columns: dict[str, str]) -> DataFrame:
    """Reads sorted partitions in order, each told by those before it where it begins.

    ``summed`` makes a small record of a partition's rows, ``onward`` takes a
    state (at first None) over a record, and ``read`` gives rows with ``columns``
    from the state at its partition's beginning, the record of the partition
    after it (None for the last) and its rows. Partitions without rows don't count.
    """

    @tidy
    def record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = lines(batches)
        first = next(each, None)
        if first is not None:
            made = pickle.dumps(summed(chained(first, each)))
            yield pa.RecordBatch.from_pydict({"part": pa.array([first["part"]], pa.int32()), "made": pa.array([made], pa.binary())})

    records = sorted((r["part"], bytes(r["made"])) for r in rows.mapInArrow(record, "part int, made binary").collect())
    begins, state = {}, None
    for i, (part, made) in enumerate(records):
        begins[part] = pickle.dumps(state), records[i + 1][1] if i + 1 < len(records) else pickle.dumps(None)
        state = onward(state, pickle.loads(made))
    schema = StructType()
    for name, kind in columns.items():
        schema = schema.add(name, KINDS[kind][0])
    arrow = pa.schema([(name, KINDS[kind][1]) for name, kind in columns.items()])

    @tidy
    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = lines(batches)
        first = next(each, None)
        if first is None:
            return
        before, after = map(pickle.loads, begins[first["part"]])
        held: list[tuple] = []
        for row in read(before, after, chained(first, each)):
            held.append(row)
            if len(held) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), arrow.types)], schema=arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), arrow.types)], schema=arrow)

    return rows.mapInArrow(rest, schema)


# Places of turns in their conversations. State: (conversation, turns so far).


def _count(rows):
    first = last = None
    for r in rows:
        conv = r["conv_id"]
        if first is None:
            first = last = [conv, 0]
        elif conv != last[0]:
            last = [conv, 0]
        last[1] += 1
    return tuple(last), first is last


def _count_on(state, record):
    (conv, n), alone = record
    return (conv, n + state[1]) if alone and state and state[0] == conv else (conv, n)


def _number(state, after, rows):
    conv, n = state or (None, 0)
    for r in rows:
        conv, n = r["conv_id"], n + 1 if r["conv_id"] == conv else 1
        yield conv, n, r["digest"], r["words"]


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, nth, digest, words) of turns (conv_id, turn, digest, words)."""
    return carried(sorted_parts(turns, "conv_id", "turn", "digest"), _count, _count_on, _number, {"conv_id": "long", "nth": "long", "digest": "binary", "words": "long"})


# Hashes of prefixes. State: (conversation, turns so far, hash). A row without a digest begins a conversation.


def taken_in(value: int, digest: bytes) -> int:
    """The prefix ``value`` with one more turn."""
    return (value * BASE + int.from_bytes(digest, "big")) % PRIME


def _fold(rows):
    conv, n, times, plus, begun = None, 0, 1, 0, None
    for r in rows:
        conv = r["conv_id"] if conv is None else conv
        if r["digest"] is None:
            begun = r["conv_id"], 0, ROOT
        elif begun:
            begun = begun[0], begun[1] + 1, taken_in(begun[2], r["digest"])
        else:
            n, times, plus = n + 1, times * BASE % PRIME, taken_in(plus, r["digest"])
    return conv, n, times, plus, begun


def _fold_on(state, record):
    _, n, times, plus, begun = record
    return begun or (state[0], state[1] + n, (state[2] * times + plus) % PRIME)


def _prefixes(state, after, rows):
    held = None
    conv, depth, value = state or (None, 0, ROOT)
    for r in rows:
        if held:
            yield *held, r["conv_id"] != held[0]
        if r["digest"] is None:
            conv, depth, value, before = r["conv_id"], 0, ROOT, None
        else:
            depth, before, value = depth + 1, value, taken_in(value, r["digest"])
        held = conv, depth, value.to_bytes(32, "big"), None if before is None else before.to_bytes(32, "big"), r["words"]
    if held:
        yield *held, after is None or after[0] != held[0]


def prefixes(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, hash, parent, words, ends): every prefix of every conversation, its own whole length last.

    ``rebuilt`` has (conv_id, kind, nth, digest, words), ordered by kind and nth,
    with a first row of null digest for each conversation.
    """
    columns = {"conv_id": "long", "depth": "long", "hash": "binary", "parent": "binary", "words": "long", "ends": "boolean"}
    return carried(sorted_parts(rebuilt, "conv_id", "kind", "nth"), _fold, _fold_on, _prefixes, columns)


# Units of paths, from the deepest node upward. State: (conversation, depth of the unit's lowest node, sum so far).


def _climb(rows):
    conv, top, plus, last = None, None, 0, None
    for r in rows:
        if conv is None:
            conv, top = r["conv_id"], r["depth"]
        here = r["conv_id"]
        if r["n_children"] != 1 or here != (last[0] if last else conv):
            last = here, r["depth"], r["own"]
        elif last:
            last = last[0], last[1], last[2] + r["own"]
        else:
            plus += r["own"]
    return conv, top, plus, last


def _climb_on(state, record):
    conv, top, plus, last = record
    if last:
        return last
    return (conv, state[1], state[2] + plus) if state and state[0] == conv else (conv, top, plus)


NODE = {"conv_id": "long", "depth": "long", "parent_conv_id": "long", "n_convs": "long", "n_children": "long", "own": "long", "ends_sha256": "string"}


def _units(state, after, rows):
    conv, lowest, below = state or (None, None, 0)
    for r in rows:
        if r["conv_id"] != conv or r["n_children"] != 1:
            conv, lowest, below = r["conv_id"], r["depth"], 0
        below += r["own"]
        yield *(r[c] for c in NODE), lowest, below


def in_units(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``unit``, the depth of their unit's lowest node, and ``below``, the sum of ``own`` from there up to them."""
    return carried(sorted_parts(nodes.select(*NODE), "conv_id", F.col("depth").desc()), _climb, _climb_on, _units, NODE | {"unit": "long", "below": "long"})


def peeled(units: DataFrame) -> DataFrame:
    """(id, leaves, saved) of ``units`` (id, up, waiting, leaves, saved): totals of the units below and of each itself.

    ``waiting`` counts the children that have yet to report. Each round reads the
    units still open and writes those that remain.
    """
    spark, place, nth = units.sparkSession, scratch(units.sparkSession, "peeled"), 0
    open_ = written(units, "open")
    while not open_.isEmpty():
        ready = open_.where("waiting = 0")
        ready.select("id", "leaves", "saved").write.parquet(f"{place}/{nth}")
        sent = ready.groupBy(F.col("up").alias("to")).agg(F.count(F.lit(1)).alias("reports"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        rest = open_.where("waiting > 0").join(sent, F.col("id") == F.col("to"), "left")
        more = lambda c, m: (F.col(c) + F.coalesce(m, F.lit(0))).alias(c)  # noqa: E731
        before, open_ = open_, written(rest.select("id", "up", (F.col("waiting") - F.coalesce("reports", F.lit(0))).alias("waiting"), more("leaves", "more_leaves"), more("saved", "more_saved")), "open")
        released(before)
        nth += 1
    released(open_)
    return spark.read.parquet(*[f"{place}/{i}" for i in range(nth)]) if nth else units.select("id", "leaves", "saved")


def ends_of(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ``members`` (node, conv_id): the digest of their ids in order, read one by one."""

    @tidy
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            nodes, out = [], []
            for r in batch.to_pylist():
                if r["node"] != node:
                    if state:
                        nodes.append(node)
                        out.append(state.hexdigest())
                    node, state = r["node"], hashlib.sha256(str(r["conv_id"]).encode())
                else:
                    state.update(f",{r['conv_id']}".encode())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, batch.schema.field("node").type), pa.array(out)], ["node", "ends_sha256"])
            kind = batch.schema.field("node").type
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], kind), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    schema = StructType().add("node", members.schema["node"].dataType).add("ends_sha256", StringType())
    return members.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(digests, schema)


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, kind, nth, digest, words): a row of null digest for each conversation, what it borrows of its block's first one, and its own turns after as many."""
    remainder = F.col("conv_id") % BLOCK
    borrows = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    placed = written(numbered(turns), "turns")
    begins = placed.where("nth = 1").select("conv_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("nth"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    heads = placed.where((F.col("nth") < HEADS) & (remainder == 0)).select(F.col("conv_id").alias("head"), F.lit(1).alias("kind"), "nth", "digest", "words")
    lent = begins.where(remainder != 0).select("conv_id", (F.col("conv_id") - remainder).alias("base")).join(heads, F.col("base") == F.col("head")).where(F.col("nth") <= borrows)
    own = placed.where((remainder == 0) | (F.col("nth") > borrows)).select("conv_id", F.lit(2).alias("kind"), "nth", "digest", "words")
    return begins.unionByName(lent.select(*begins.columns)).unionByName(own)


def trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): one row for each node."""
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    digest = F.unhex(F.sha2(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said).cast("binary"), 256))
    brief = turns.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), word_count(said[1]).alias("words")).where("conv_id is not null")
    every = written(prefixes(rebuilt_turns(brief)), "prefixes")

    node = F.struct("depth", "hash")
    above = F.when(F.col("parent").isNotNull(), F.struct((F.col("depth") - 1).alias("depth"), F.col("parent").alias("hash")))
    nodes = every.groupBy(node.alias("node")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), F.min(above).alias("above"))
    nodes = written(nodes, "nodes")
    total = nodes.count()
    kids = nodes.where("above is not null").groupBy(F.col("above").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    counted = nodes.join(kids, F.col("node") == F.col("of"), "left").select(*nodes.columns, F.coalesce("n", F.lit(0)).alias("n_children"))
    ends = ends_of(every.where("ends").select(node.alias("node"), "conv_id")).withColumnRenamed("node", "ended")
    counted = written(counted.join(ends, F.col("node") == F.col("ended"), "left").select(*counted.columns, F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256")), "nodes")
    parents = counted.where("n_children > 0").select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("rows"))
    named = looked_up(counted, parents, "above", "parent_conv_id", "rows", total, "conv_id").withColumn("depth", F.col("node.depth")).withColumn("own", (F.col("n_convs") - 1) * F.col("words"))

    placed = written(in_units(named), "units")
    lowest, highest = F.col("depth") == F.col("unit"), F.min(F.struct("depth", "parent_conv_id"))
    units = placed.groupBy(F.struct("conv_id", F.col("unit").alias("depth")).alias("id")).agg(F.sum("own").alias("own"), F.count(F.lit(1)).alias("rows"), F.max(F.when(lowest, F.col("n_children"))).alias("waiting"), highest.alias("top"))
    units = written(units, "units")
    up = F.struct(F.col("top.parent_conv_id").alias("conv_id"), (F.col("top.depth") - 1).alias("depth"))
    done = peeled(units.select("id", up.alias("up"), "waiting", (F.col("waiting") == 0).cast("long").alias("leaves"), F.col("own").alias("saved")))
    facts = units.select("id", "own", "rows").join(done, "id").select("id", "rows", F.struct("leaves", (F.col("saved") - F.col("own")).alias("lower")).alias("found"))
    full = looked_up(placed.withColumn("id", F.struct("conv_id", F.col("unit").alias("depth"))), facts, "id", "found", "rows", total, "depth")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("found.leaves").alias("n_leaves"), (F.col("below") + F.col("found.lower")).alias("saved_tokens"), "ends_sha256")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, text, dig, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dig) AS nth
  FROM (SELECT conv_id, turn, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS dig FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id % 20 AS r, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), b AS (
  SELECT c.conv_id, 0 AS kind, t.nth, t.dig, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.r WHERE c.r <> 0 AND t.nth <= c.h
  UNION ALL SELECT c.conv_id, 1, t.nth, t.dig, t.text FROM c JOIN t ON t.conv_id = c.conv_id WHERE c.r = 0 OR t.nth > c.h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(dig, '') OVER w AS pre, CAST(len(regexp_extract_all(text, '[^ 	-]+')) AS BIGINT) AS words FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY kind, nth)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), e AS (
  SELECT depth, pre, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM p) WHERE depth = last GROUP BY ALL
), n AS (
  SELECT depth, pre, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY depth, pre
), k AS (
  SELECT depth - 1 AS depth, left(pre, -64) AS pre, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), f AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, coalesce(e.ends, sha256('')) AS ends_sha256 FROM n LEFT JOIN k USING (depth, pre) LEFT JOIN e USING (depth, pre)
), s AS (
  SELECT p.depth, p.pre, count(*) FILTER (f.n_children = 0) AS n_leaves, CAST(sum((f.n_convs - 1) * f.words) AS BIGINT) AS saved_tokens
  FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY ALL
)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM f JOIN s USING (depth, pre) LEFT JOIN n u ON u.depth = f.depth - 1 AND u.pre = left(f.pre, -64)
"""
