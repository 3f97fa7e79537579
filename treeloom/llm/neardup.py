"""Jaccard join of documents on five-word shingles, by chosen paths.

Words are runs of characters other than ASCII white space. A document is the
set of its five-word shingles (of its words, if it has fewer); two documents
are linked if their sets have a Jaccard similarity of at least 0.8. The result
has one row for each document: its class, named by the smallest doc_id that
links connect it with, and how many documents it is linked with.

1.  Documents with equal sets are one *set* with a weight, so copies cost one
    row each from here on. A set is embedded as 64 tokens (coordinate, minimum
    hash), whose overlap follows the similarity.
2.  Chosen paths. In each run a set begins at the root and goes on with those
    of its tokens whose hash, drawn anew for each node of the path, is below
    1 / (0.8 * 64). Sets that share a chosen token meet in a bucket. Buckets far
    over ``bucket_limit`` are split again by freshly chosen tokens; small ones
    are compared by brute force on a byte of each token. What still is too large at the
    greatest depth is compared in blocks, so that no bucket is capped. A pair at
    the threshold meets in one run with a chance of 0.63 at the first depth and
    0.23 at the sixth; runs are repeated until the chance of meeting reaches
    ``recall``, and more often for the sets of a bucket that is split.
    Before a large bucket is split, each of its sets is held against a few of
    them, its leaders. A set with at most ``settled`` tokens other than a leader
    is settled: whatever looks like it differs from that leader by at most
    ``settled`` more, and everything as near as that is joined to the leader.
    So settled sets need no further split, and a large group of near copies is
    met in one pass instead of filling buckets at every depth. What is left of a
    bucket is compared, in pairs of blocks if it is over ``bucket_limit``, as
    long as that hands on no set more often than there are ``runs``. Only a
    bucket with more left is split: its sets then need further runs, of which
    each hands them on, too.
3.  Buckets don't give pairs but a spanning forest of what looks alike by a
    margin; its connected components are loose groups, supersets of classes.
4.  Inside each loose group all sets are compared exactly, groups over a size in
    pairs of blocks, one task each. That gives the links of each set, summed
    without writing pairs down, and spanning edges, whose components are the
    classes.

Defined results for odd input: texts without a word have equal, empty sets and
are copies of each other, linked with nothing else; a text of one to four words
has one shingle; very long texts are shingled whole; rows that repeat a doc_id
are documents of their own, linked like any others; a null doc_id names a class
only if all of its doc_ids are null; an empty table gives an empty result;
other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.llm.common import fresh, looked_up, released, table, tidy, written

WORDS = 5
THRESHOLD = 0.8
COORDINATES = 64


@dataclass(frozen=True)
class Plan:
    threshold: float = THRESHOLD
    recall: float = 0.9999
    bucket_limit: int = 1500
    max_depth: int = 6
    #: Share of equal tokens from which two sets look alike: four deviations below the threshold.
    alike: float = 0.6
    #: Sets of a large bucket that all others are held against, and the tokens by which a settled set may differ from one.
    leaders: int = 64
    settled: int = 14
    block_sets: int = 400
    block_shingles: int = 1_500_000
    seed: int = 11

    @property
    def n_leaders(self) -> int:
        """Leaders of a bucket: few against its sets."""
        return min(self.leaders, self.bucket_limit // 20)

    @property
    def runs(self) -> int:
        """Runs until a pair at the threshold has met with the wanted chance."""
        missed = math.exp(-1.0)  # no common token chosen, each with 1 / (threshold * tokens)
        return math.ceil(math.log(1 - self.recall) / math.log(missed))

    def missed(self, runs: int, depth: int) -> float:
        """The chance that a pair at the threshold doesn't meet in ``runs`` runs, all its buckets split down to ``depth``."""
        out, p = 0.0, 1 / (self.threshold * COORDINATES)
        for common in range(COORDINATES + 1):  # equal tokens, the same ones in all runs
            lost = 0.0
            for _ in range(depth):
                lost = (1 - p * (1 - lost)) ** common
            out += math.comb(COORDINATES, common) * self.threshold**common * (1 - self.threshold) ** (COORDINATES - common) * lost**runs
        return out

    @property
    def split_runs(self) -> int:
        """Runs of the sets that were in a split bucket, until a pair has met with the wanted chance at any depth.

        A pair is missed if the first ``runs`` runs choose none of its common
        tokens, so that it isn't seen whether their buckets are split, or if it
        is lost in all runs; both chances together must not exceed the wanted one.
        """
        left = max(1 - self.recall - self.missed(self.runs, 1), (1 - self.recall) / 10)
        runs = self.runs
        while self.max_depth > 1 and self.missed(runs, self.max_depth) > left:
            runs += 1
        return runs


# --- sets and their embedding ---

_hashes: dict[bytes, int] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    if len(_hashes) > 100_000:
        _hashes.clear()
    for w in words:
        if w not in _hashes:
            _hashes[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes) -> np.ndarray:
    """The sorted hashes of a text's shingles, each once."""
    h = word_hashes(text.split())
    if len(h) == 0:
        return h
    n = min(WORDS, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) + h[k : len(h) - n + 1 + k]
    return np.unique(mix64(out))


def multipliers(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
    return draw() | np.uint32(1), draw()


def tokens(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least hash of the set in each coordinate."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    short = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 4096):
        part = short[at : at + 4096]
        least = np.minimum(least, ((part[None, :] ^ b[:, None]) * a[:, None]).min(1))
    return least


SKETCH = "doc_id long, text_hash long, set_key binary, n_shingles long, tokens binary"


def sketched(docs: DataFrame) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text) with the key and tokens of its set."""

    @tidy
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = multipliers()
        for batch in batches:
            keys, sizes, found = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                s = shingles(text.as_py() or b"")
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sizes.append(len(s))
                found.append(tokens(s, a, b).tobytes())
            columns = [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SKETCH.split(", ")])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(sketch, SKETCH)


def sets_of(sketches: DataFrame) -> DataFrame:
    """(set, set_key, tokens, n_shingles, weight, least): each set once, and its first document."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash"))
    grouped = sketches.groupBy("set_key").agg(
        F.first("tokens").alias("tokens"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("weight"), first.alias("least")
    )
    return written(grouped.withColumn("set", F.monotonically_increasing_id()), "sets")


# --- chosen paths ---


def chosen(node: np.ndarray, found: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node) for the tokens that the sets in ``node`` go on with."""
    coordinate = mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64) << np.uint64(32))
    token = mix64(found.astype(np.uint64) ^ coordinate[None, :])
    h = mix64(token ^ node[:, None])
    limit = np.uint64(int(2.0**64 / (plan.threshold * COORDINATES)))
    rows, at = np.nonzero(h < limit)
    return rows, mix64(h[rows, at] ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def token_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def brief_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDINATES)


def briefs(sets: DataFrame) -> DataFrame:
    """(set, brief): a byte of each token, to compare by. Equal tokens have equal bytes, and others one time in 256."""

    @tidy
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ((token_matrix(batch.column(1)) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in found], pa.binary())], names=["set", "brief"])

    return sets.select("set", "tokens").mapInArrow(go, "set long, brief binary")


NODES = "node long, set long"


def node_batch(nodes: list[np.ndarray], sets: list[np.ndarray]) -> pa.RecordBatch:
    join = lambda parts, kind: np.concatenate(parts).view(np.int64) if parts else np.zeros(0, kind)
    return pa.RecordBatch.from_arrays([pa.array(join(nodes, np.int64)), pa.array(join(sets, np.int64))], names=["node", "set"])


def roots(sets: DataFrame, plan: Plan, runs: range) -> DataFrame:
    """The buckets of the first depth, for all ``runs``."""

    @tidy
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, nodes, owners = np.asarray(batch.column(0)), token_matrix(batch.column(1)), [], []
            for run in runs if len(ids) else ():
                root = np.full(len(ids), run + (plan.seed << 20), np.uint64)
                rows, child = chosen(mix64(root), found, plan)
                nodes.append(child)
                owners.append(ids[rows])
            yield node_batch(nodes, owners)

    return sets.select("set", "tokens").mapInArrow(go, NODES)


def deeper(rows: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The children of too large buckets."""

    @tidy
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, node = np.asarray(batch.column(0)), np.asarray(batch.column(1)).view(np.uint64)
                at, child = chosen(node, token_matrix(batch.column(2)), plan)
                yield node_batch([child], [ids[at]])

    return rows.join(sets.select("set", "tokens"), "set").select("set", "node", "tokens").mapInArrow(go, NODES)


def in_blocks(df: DataFrame, group: str, sizes: DataFrame) -> DataFrame:
    """Splits groups into pairs of blocks: each row goes to the pairs that its block is in.

    ``sizes`` has (group, blocks). Adds ``block`` and ``pair`` (a struct of two
    blocks); every two rows of a group meet in exactly one pair, in which they
    are in different blocks unless the pair is of one block.
    """
    split = df.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    other = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    return other.withColumn("pair", F.struct(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))).drop("other", "blocks")


def grouped_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows, sorted by the first column, as one batch each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and key[0] != held[-1].column(0)[0].as_py():
            yield whole(held)
            held = []
        for begin, end in zip([0, *cuts], [*cuts, len(key)], strict=True):
            part = batch.slice(begin, end - begin)
            held.append(part)
            if end < len(key):
                yield whole(held)
                held = []
    if held:
        yield whole(held)


def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


class Forest:
    """Union-find over 0..n-1; the least number of a tree is its root."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = int(self.parent[x])
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def join_matrix(self, linked: np.ndarray, offset: int = 0) -> None:
        """Joins row i + offset with every column that ``linked[i]`` marks."""
        for i, row in enumerate(linked):
            others = np.flatnonzero(row)
            if len(others):
                for r in np.unique(self.parent[others]):
                    self.join(i + offset, int(r))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        roots = np.array([self.root(i) for i in range(len(self.parent))])
        child = np.flatnonzero(roots != np.arange(len(roots)))
        return child, roots[child]


EDGES = "u long, v long"


def compare_tokens(rows: DataFrame, short: DataFrame, plan: Plan) -> DataFrame:
    """Edges of a spanning forest of what looks alike in each bucket (node, set)."""

    @tidy
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for group in grouped_runs(batches):
            ids, found = np.asarray(group.column(1)), brief_matrix(group.column(2))
            ids, at = np.unique(ids, return_index=True)
            found, n = found[at], len(ids)
            if n < 2:
                continue
            forest, need = Forest(n), math.ceil(plan.alike * COORDINATES)
            for begin in range(0, n, 64):
                part = found[begin : begin + 64]
                equal = np.zeros((len(part), n), np.uint8)
                for c in range(COORDINATES):
                    equal += part[:, c, None] == found[None, :, c]
                near = equal >= need
                near[np.arange(len(part)), begin + np.arange(len(part))] = False
                forest.join_matrix(near, begin)
            child, root = forest.edges()
            us.append(ids[child])
            vs.append(ids[root])
            if len(us) >= 5000:
                yield edge_batch(us, vs)
                us, vs = [], []
        yield edge_batch(us, vs)

    near = rows.join(short, "set").select("node", "set", "brief").repartition("node").sortWithinPartitions("node")
    return near.mapInArrow(go, EDGES)


def edge_batch(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(join(us), pa.int64()), pa.array(join(vs), pa.int64())], names=["u", "v"])


LED = "node long, set long, to long, settled boolean"


def led(rows: DataFrame, large: DataFrame, short: DataFrame, plan: Plan) -> DataFrame:
    """(node, set, to, settled) for the sets in ``large`` (node, n) buckets: the leaders that each leads to, or itself.

    A bucket is dealt into parts of at most about ``bucket_limit`` sets. Its
    leaders are the sets whose hash lies in the share that gives ``n_leaders``
    of them; they go to each part, ahead of its sets. Leaders that look alike
    count as one. Tokens differ where their bytes do, here as in buckets, so
    what a leader settles holds for whatever a bucket would have joined.
    """
    total = large.agg(F.sum("n")).first()[0] or 1
    inside = looked_up(rows, large.select("node", F.struct("n").alias("sized"), "n"), "node", "sized", "n", total, "set").where(F.col("sized").isNotNull())
    inside = inside.select("node", "set", F.col("sized.n").alias("n"), F.ceil(F.col("sized.n") / plan.bucket_limit).cast("long").alias("parts"))
    is_leader = F.pmod(F.xxhash64("set", F.lit(plan.seed)), F.lit(1 << 40)) < F.lit(plan.n_leaders * float(1 << 40)) / F.col("n")
    members = inside.select("node", F.pmod(F.xxhash64("set"), "parts").alias("part"), F.lit(1).alias("kind"), "set")
    leaders = inside.where(is_leader).select("node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "set")
    dealt = members.unionByName(leaders).join(short, "set").select(F.xxhash64("node", "part").alias("grp"), "kind", "node", "set", "brief")

    @tidy
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = COORDINATES - math.ceil(plan.alike * COORDINATES) + plan.settled
        for group in grouped_runs(batches):
            kind, node, ids, found = np.asarray(group.column(1)), np.asarray(group.column(2)), np.asarray(group.column(3)), brief_matrix(group.column(4))
            order = np.lexsort((ids, kind))
            first = order[np.r_[True, (np.diff(kind[order]) != 0) | (np.diff(ids[order]) != 0)]]  # a repeated row gives its set again
            kind, node, ids, found = kind[first], node[first], ids[first], found[first]
            heads, head_ids = found[kind == 0], ids[kind == 0]
            forest = Forest(len(heads))
            forest.join_matrix((heads[:, None, :] != heads[None, :, :]).sum(2) <= reach)
            root = np.array([forest.root(i) for i in range(len(heads))], np.int64)
            rows_, to, done = [], [], []
            for begin in range(0, len(ids), 512):
                part = np.flatnonzero(kind[begin : begin + 512] == 1) + begin
                apart = (found[part][:, None, :] != heads[None, :, :]).sum(2)
                near = np.zeros((len(part), len(heads)), bool)
                for r in np.unique(root):
                    near[:, r] = (apart[:, root == r] <= reach).any(1)
                at, head = np.nonzero(near)
                alone = np.flatnonzero(~near.any(1))
                settled = (apart <= plan.settled).any(1)
                rows_ += [part[at], part[alone]]
                to += [head_ids[head], ids[part[alone]]]
                done += [settled[at], settled[alone]]
            at = np.concatenate(rows_)
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(ids[at]), pa.array(np.concatenate(to)), pa.array(np.concatenate(done))], names=[x.split()[0] for x in LED.split(", ")])

    return dealt.repartition("grp").sortWithinPartitions("grp", "kind").mapInArrow(go, LED)


def met(sets: DataFrame, all_sets: DataFrame, plan: Plan, runs: range) -> tuple[list[DataFrame], DataFrame | None]:
    """(edges, split): what meets in ``runs`` and looks alike, and the sets of the buckets that were split, if any was large."""
    rows, short, out, split = written(roots(sets, plan, runs), "nodes"), written(briefs(sets), "briefs"), [], None
    sized = lambda df: df.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    fits = F.col("n") <= plan.bucket_limit
    blocks = F.when(fits, 1).otherwise(F.ceil(F.col("n") * 2 / plan.bucket_limit)).alias("blocks")
    for depth in range(1, plan.max_depth + 1):
        sizes = written(sized(rows), "node-sizes")
        large, n_over = sizes.where(~fits), 0
        compared, gone = rows.join(sizes.where(fits), "node", "left_semi"), [rows, sizes]
        if large.count():
            rest, left = rows.join(large, "node", "left_semi"), large
            if plan.n_leaders:
                heads = written(led(rows, large, short, plan), "led")
                out.append(heads.where("set <> to").select(F.col("set").alias("u"), F.col("to").alias("v")))
                rest = written(heads.where("NOT settled").select("node", "set").distinct(), "unsettled")
                left = written(sized(rest), "unsettled-sizes")
                gone += [rest, left]
            left = left.select("node", blocks)
            over = left.where(F.col("blocks") > (plan.runs if depth < plan.max_depth else math.inf))
            n_over, still = over.count(), rest.join(over, "node", "left_semi")
            paired = in_blocks(rest, "node", left.join(over, "node", "left_anti") if n_over else left)
            compared = compared.unionByName(paired.select(F.xxhash64("node", "pair.a", "pair.b").alias("node"), "set"))
            if depth == 1:
                split = written(still.select("set").distinct(), "split") if n_over else sets.select("set").limit(0)
        out.append(written(compare_tokens(compared, short, plan), "loose"))
        if n_over:
            rows = written(deeper(still, all_sets, plan), "nodes")
        released(*gone)
        if not n_over:
            break
    released(short)
    return out, split


def loose_edges(sets: DataFrame, plan: Plan) -> DataFrame:
    """Edges between sets that meet in a bucket of any depth and look alike."""
    out, split = met(sets, sets, plan, range(plan.runs))
    if split is not None and plan.split_runs > plan.runs:
        again = sets.join(split, "set", "left_semi")
        if again.limit(1).count():
            out += met(again, sets, plan, range(plan.runs, plan.split_runs))[0]
    edges = out[0]
    for more in out[1:]:
        edges = edges.unionByName(more)
    return written(edges.dropDuplicates(["u", "v"]), "loose-edges")


# --- connected components ---


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of ``edges`` (u, v) and the least node it is connected with.

    Rounds of large and small stars: a node hands its larger neighbours, then
    its smaller ones, to the least node it knows. Each round writes its edges;
    rounds end when every edge leads to its component.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").dropDuplicates(["u", "v"]), "edges")
    while not only_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        all_least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = with_least(both, all_least)
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").dropDuplicates(["u", "v"]), "large-star")
        released(now, all_least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")
        small = with_least(large, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").dropDuplicates(["u", "v"]), "small-star")
        released(large, least)
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())


def only_stars(edges: DataFrame) -> bool:
    """Whether distinct ``edges`` (u, v), u the greater, lead from every node at most once, and from none that another leads to."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("n")).where("out > 0 AND n > 1").isEmpty()


def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``edges`` (u, v) with ``m`` of ``least`` (u, m, n), where a node may have very many edges."""
    total = least.agg(F.sum("n")).first()[0] or 1
    return looked_up(edges, least, "u", "m", "n", total, "v")


# --- exact links inside loose groups ---


def intersections(sets: list[np.ndarray], left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the rows ``left``: (rows, how many elements each shares with every set)."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    begin = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    count = np.diff(np.r_[begin, len(values)])
    column = np.repeat(np.where(count > 1, np.cumsum(count > 1) - 1, -1), count)  # shared elements only
    owner, column = owner[column >= 0], column[column >= 0]
    n_columns = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, len(left), 2048):
        rows = left[at : at + 2048]
        place = np.full(len(sets), -1)
        place[rows] = np.arange(len(rows))
        shared = np.zeros((len(rows), len(sets)), np.float32)
        for c in range(0, n_columns, 2048):
            inside = slice(*np.searchsorted(column, [c, c + 2048]))
            dense = np.zeros((len(sets), min(2048, n_columns - c)), np.float32)
            dense[owner[inside], column[inside] - c] = 1
            shared += dense[rows] @ dense.T
        yield rows, shared


LINKS = "set long, links long, to long"


def link_groups(rows: DataFrame, plan: Plan) -> DataFrame:
    """Links and spanning edges in groups (grp, block, single, set, weight, elements)."""

    @tidy
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_runs(batches):
            block, ids, weight = (np.asarray(group.column(i)) for i in (1, 3, 4))
            ids, at = np.unique(ids, return_index=True)  # a repeated row gives its set again
            block, weight = block[at], weight[at]
            one_block = bool(group.column(2)[0].as_py())
            sets = [np.frombuffer(group.column(5)[int(i)].as_py(), np.uint64) for i in at]
            size = np.array([len(s) for s in sets], np.float64)
            links, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
            for mine, shared in intersections(sets, np.arange(len(ids))):
                union = size[mine, None] + size[None, :] - shared
                linked = (shared >= plan.threshold * union - 1e-6) & (shared > 0)
                linked[np.arange(len(mine)), mine] = False
                if not one_block:
                    linked &= block[mine, None] != block[None, :]
                links[mine] = linked @ weight
                forest.join_matrix(linked, int(mine[0]))
            roots = np.array([forest.root(i) for i in range(len(ids))])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(ids[roots])], names=["set", "links", "to"])

    near = rows.select("grp", "block", "single", "set", "weight", "elements").repartition("grp").sortWithinPartitions("grp")
    return near.mapInArrow(go, LINKS)


def with_elements(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (set, set_key, least, ...) with ``elements``: the shingles of the set's first document."""
    rest = [c for c in wanted.columns if c not in ("set_key", "least")]
    kinds = {f.name: f.dataType for f in wanted.schema.fields}
    schema = ", ".join(f"{c} {kinds[c].simpleString()}" for c in rest) + ", elements binary"

    @tidy
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, elements = [], []
            for i, (text, key) in enumerate(zip(batch.column("text").cast(pa.binary()), batch.column("set_key"), strict=True)):
                raw = shingles(text.as_py() or b"").tobytes()
                if hashlib.blake2b(raw, digest_size=16).digest() == key.as_py():
                    keep.append(i)
                    elements.append(raw)
            kept = batch.select(rest).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(elements, pa.binary())], names=[*rest, "elements"])

    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("__id"), F.xxhash64(text).alias("__h"), text.alias("text"))
    joined = source.join(wanted, (F.col("__h") == F.col("least.text_hash")) & F.col("__id").eqNullSafe(F.col("least.doc_id")))
    return joined.select("text", "set_key", *rest).mapInArrow(go, schema)


def classes(docs: DataFrame, plan: Plan = Plan()) -> tuple[DataFrame, DataFrame]:
    """(sketches, sets): a row for each document, and for each set with its component and links."""
    sketches = written(sketched(docs), "sketches")
    sets = sets_of(sketches)
    full = sets.where("n_shingles > 0")
    edges = loose_edges(full, plan)
    loose = written(components(edges).withColumnsRenamed({"node": "set", "component": "cluster"}), "clusters")
    released(edges)
    grouped = sets.select("set", "set_key", "least", "weight", "n_shingles").join(loose, "set")
    sizes = written(
        grouped.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
        .select("cluster", F.greatest(F.lit(1), F.when((F.col("n") > plan.block_sets) | (F.col("s") > plan.block_shingles), F.ceil(F.greatest(F.col("n") * 2 / plan.block_sets, F.col("s") * 2 / plan.block_shingles)))).alias("blocks")),
        "cluster-sizes",
    )
    elements = written(with_elements(docs, grouped.select("set", "set_key", "least", "weight", "cluster")), "elements")
    paired = in_blocks(elements, "cluster", sizes).withColumn("single", F.col("pair.a") == F.col("pair.b")).withColumn("grp", F.xxhash64("cluster", "pair.a", "pair.b"))
    found = written(link_groups(paired, plan), "links")
    released(elements, sizes, loose)
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    named = components(found.where("set <> to").select(F.col("set").alias("u"), F.col("to").alias("v"))).withColumnRenamed("node", "set")
    known = sets.join(links, "set", "left").join(named, "set", "left")
    known = written(known.select("set", "set_key", "weight", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "set").alias("component")), "known")
    first = known.groupBy("component").agg(F.min("least").alias("first"))
    named_sets = written(known.join(first, "component"), "classes")
    released(found, known, sets)
    return sketches, named_sets


def jaccard_classes(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of ``docs`` (doc_id, text)."""
    sketches, sets = classes(docs, plan)
    facts = sets.select("set_key", F.struct(F.col("first.doc_id").alias("class_id"), (F.col("links") + F.col("weight") - 1).alias("n_links")).alias("facts"), "weight")
    total = sketches.count() or 1
    found = looked_up(sketches.select("doc_id", "set_key"), facts, "set_key", "facts", "weight", total, "doc_id")
    return found.select("doc_id", "facts.class_id", "facts.n_links")


def one_of_each(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of ``docs`` that are the first of their class: smallest doc_id, and one of its repeats."""
    _, sets = classes(docs.select("doc_id", "text"), plan)
    null, id_, hash_, nth, b_null, b_id, b_hash, n = (fresh(f"first_{x}", docs) for x in ("null", "id", "hash", "nth", "null_b", "id_b", "hash_b", "n"))
    key = F.col("doc_id").cast("long")
    picked = sets.select(F.col("first.doc_id").isNull().alias(b_null), F.coalesce("first.doc_id", F.lit(0)).alias(b_id), F.col("first.text_hash").alias(b_hash))
    firsts = picked.groupBy(b_null, b_id, b_hash).agg(F.count(F.lit(1)).alias(n))
    keyed = docs.withColumns({null: key.isNull(), id_: F.coalesce(key, F.lit(0)), hash_: F.xxhash64(F.col("text").cast("string"))})
    on = (F.col(null) == F.col(b_null)) & (F.col(id_) == F.col(b_id)) & (F.col(hash_) == F.col(b_hash))
    order = Window.partitionBy(null, id_, hash_).orderBy(F.lit(0))  # rows that repeat one document
    joined = keyed.join(firsts, on).withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1)
    return joined.select(*[f"`{c}`" for c in docs.columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents", "doc_id", "text"))
