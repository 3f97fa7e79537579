"""Recursive operators over edges: ancestors, topological depth, reachability.

They go level by level, each level a join with the edges. Each level is
checkpointed, so that the next doesn't compute it again and a lost executor
loses none of it; levels that nothing needs any more are let go.
"""

from __future__ import annotations

import functools
import heapq
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructType

from treeloom.operators import sweeps

MAX_LEVELS = 32

#: So many rows of a search are broadcast at most.
NEAR = 50_000


class CycleError(ValueError):
    """The dependencies go in a circle."""


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and its lineage cut: a checkpoint in the folder that ``spark.checkpoint.dir`` or the caller has named.

    Without one, a temporary folder is made, but only in local mode; on a
    cluster each machine would write to a folder of its own, and that is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="treeloom-"))
    return df.checkpoint()


def unsized(df: DataFrame) -> DataFrame:
    """``df`` settled, and without the size that Spark estimates for it.

    A checkpoint keeps its plan's estimate, and that of a join is the product of
    both sides. Where a round joins a frame with itself it would square: after 24
    rounds it has hundreds of millions of digits, all of them on the driver.
    """
    spark, done = df.sparkSession, settled(df)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(done.toJavaRDD(), done.schema()), spark)


def shortened(ids: list, to: list, totals: list) -> None:
    """Pointers that stay among ``ids`` are followed until they leave, in place; circles stay as they are."""
    place, seen = {x: i for i, x in enumerate(ids)}, [False] * len(ids)
    for i in range(len(ids)):
        way, at, on = [], i, {}
        while at is not None and not seen[at]:
            seen[at], on[at] = True, len(way)
            way.append(at)
            at = place.get(to[at])
        if at in on:
            way = way[: on[at]]
        for k in reversed(way):
            if (ahead := place.get(to[k])) is not None:
                totals[k], to[k] = totals[k] + totals[ahead], to[ahead]


def contracted(now: DataFrame) -> DataFrame:
    """(id, to, total) with pointers followed as far as a batch of neighbouring ids knows them."""
    kind = now.schema

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda c: [tuple(x.values()) if isinstance(x, dict) else x for x in c]
        for b in batches:
            ids, to, totals = whole(b.column("id").to_pylist()), whole(b.column("to").to_pylist()), b.column("total").to_pylist()
            names = [f.name for f in b.schema.field("id").type] if pa.types.is_struct(b.schema.field("id").type) else None
            shortened(ids, to, totals)
            back = to if names is None else [x if x is None else dict(zip(names, x)) for x in to]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(back, b.schema.field("to").type), pa.array(totals, b.schema.field("total").type)], schema=b.schema)

    parts = int(now.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return now.repartitionByRange(parts, "id").sortWithinPartitions("id").mapInArrow(follow, kind)


def ancestor_sum(nodes: DataFrame, id_: str, parent: str, value: str) -> DataFrame:
    """(id, total): the sum of ``value`` over each node's ancestors, however many.

    Pointers are first followed within batches of neighbouring ids, so that only
    nodes to which a pointer leads from another batch remain. Among these
    pointers are doubled: after each round a node's pointer leads twice as far
    and its sum covers what lies between, so a depth of d takes log2(d) rounds.
    Raises :class:`CycleError` if pointers go in a circle.
    """
    up = nodes.select(F.col(id_).alias("id"), F.col(parent).alias("to"))
    own = nodes.select(F.col(id_).alias("to"), F.col(value).alias("v"), F.col(parent).alias("next"))
    one = settled(up.join(own, "to", "left").select("id", F.when(F.col("next").isNotNull(), F.col("to")).alias("to"), F.coalesce("v", F.lit(0)).alias("total")))
    every = settled(contracted(one))
    met = every.where("to is not null").select(F.col("to").alias("id")).distinct()
    now = settled(every.join(met, "id", "left_semi").select("id", "to", "total"))
    for _ in range(now.count().bit_length() + 1):
        if now.where("to is not null").isEmpty():
            rest = now.select(F.col("id").alias("to"), F.col("total").alias("more"))
            return every.join(rest, "to", "left").select(F.col("id").alias(id_), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"))
        ahead = now.select(F.col("id").alias("to"), F.col("to").alias("next"), F.col("total").alias("more"))
        now = unsized(now.join(ahead, "to", "left").select("id", F.col("next").alias("to"), (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")))
    raise CycleError("a circle of parents")


def ancestors(processes: DataFrame, id_: str, parent: str, starts: DataFrame, levels: int = MAX_LEVELS) -> DataFrame:
    """(start, id, steps): the chain above each start (start), at most ``levels`` steps, not past id 1."""
    edges = processes.select(F.col(id_).alias("__c"), F.col(parent).alias("__p"))
    front = starts.select("start", F.col("start").alias("id"), F.lit(0).cast("long").alias("steps"))
    out = front
    for _ in range(levels):
        front = settled(front.join(edges, front["id"] == edges["__c"]).where("__p > 1").select("start", F.col("__p").alias("id"), (F.col("steps") + 1).alias("steps")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def depths(items: DataFrame, edges: DataFrame, levels: int = MAX_LEVELS) -> DataFrame:
    """(item, depth): the longest path of dependencies below each item.

    ``edges`` has (item, needs); what an item needs of itself or of unknown
    items doesn't count. Raises :class:`CycleError`, naming an item, if there
    is a circle or a path longer than ``levels``.
    """
    known = items.select("item").distinct()
    live = settled(edges.where("item <> needs").join(known, "item", "left_semi").join(known.select(F.col("item").alias("needs")), "needs", "left_semi").distinct())
    front = known.select("item", F.lit(0).cast("long").alias("depth"))
    out = front
    for _ in range(levels):
        front = live.join(front.select(F.col("item").alias("needs"), "depth"), "needs").groupBy("item").agg((F.max("depth") + 1).alias("depth"))
        front = settled(front.select("item", "depth"))
        if front.isEmpty():
            return out.groupBy("item").agg(F.max("depth").alias("depth"))
        out = out.unionByName(front)
    raise CycleError(f"a circle of dependencies at {front.orderBy('item').first()['item']}")


def item_edges(items: DataFrame) -> DataFrame:
    """(item, needs) of items (item, keys, deps): a dependency names a key, and means every item that owns it."""
    owner = items.select(F.col("item").alias("needs"), F.explode("keys").alias("key"))
    return items.select("item", F.explode("deps").alias("key")).join(owner, "key").select("item", "needs").distinct()


def tree_of(parents: DataFrame) -> DataFrame:
    """(hash, up) for every commit of ``parents`` (hash, parent): one of its parents, the greatest, as the one above it in a tree."""
    known = parents.select("hash").unionByName(parents.select(F.col("parent").alias("hash"))).where("hash is not null").distinct()
    up = parents.where("parent is not null and not (parent <=> hash)").groupBy(F.col("hash").alias("of")).agg(F.max("parent").alias("up"))
    return known.join(up, F.col("hash") == F.col("of"), "left").select("hash", "up")


def labels(parents: DataFrame) -> DataFrame:
    """(hash, first, last, up): commits numbered so that those from ``first`` up to ``last`` are a commit's own subtree, itself the first.

    Of trees whose edges lead from parent to child: whether one commit lies above
    another there is a comparison of numbers. The way around the trees, down into
    a commit and up out of it, is a list; how many ways down follow each step is
    found by doubling, so n commits take log2(2n) rounds of 2n rows, however long
    the history. Raises :class:`CycleError` if parents go in a circle.
    """
    tree = settled(tree_of(parents))
    sibling = Window.partitionBy("up").orderBy("hash")
    placed = tree.withColumns({"next": F.lead("hash").over(sibling), "nth": F.row_number().over(sibling)})
    heirs = placed.where("nth = 1 and up is not null").select(F.col("up").alias("of"), F.col("hash").alias("heir"))
    linked = placed.join(heirs, F.col("hash") == F.col("of"), "left")
    step = lambda c, out: F.struct(c.alias("hash"), F.lit(out).alias("out"))
    into = linked.select(step(F.col("hash"), False).alias("id"), F.when(F.col("heir").isNotNull(), step(F.col("heir"), False)).otherwise(step(F.col("hash"), True)).alias("to"), F.lit(1).alias("way"))
    onward = F.when(F.col("next").isNotNull(), step(F.col("next"), False)).when(F.col("up").isNotNull(), step(F.col("up"), True))
    out = linked.select(step(F.col("hash"), True).alias("id"), onward.alias("to"), F.lit(0).alias("way"))
    total = tree.count()
    later = ancestor_sum(into.unionByName(out), "id", "to", "way")
    ends = [F.max(F.when(F.col("id.out") == o, F.col("total"))).alias(n) for o, n in ((False, "a"), (True, "b"))]
    numbers = later.groupBy(F.col("id.hash").alias("of")).agg(*ends).select("of", (F.lit(total - 1) - F.col("a")).cast("long").alias("first"), (F.lit(total) - F.col("b")).cast("long").alias("last"))
    return settled(tree.join(numbers, F.col("hash") == F.col("of")).select("hash", "first", "last", "up"))


def above(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(start, span.*) of ``points`` (start, first): the spans (hash, first, last, ...) that lie above any of a start's points, each once.

    In the order of numbers, what lies above a point and not above the one before
    begins after that one.
    """
    before = F.lag("first").over(Window.partitionBy("start").orderBy("first"))
    asked = points.select("start", "first").distinct().withColumn("before", F.coalesce(before, F.lit(-1).cast("long"))).withColumn("tree", F.lit(0))
    held = spans.withColumn("tree", F.lit(0))
    return sweeps.containing(asked, held, "tree", "first", "first", "last", after="before").select(F.col("row.start").alias("start"), *[F.col(f"span.{c}").alias(c) for c in spans.columns])


def side_edges(parents: DataFrame, labelled: DataFrame) -> DataFrame:
    """(hash, first, last, side, side_first): edges that aren't the tree's, with the numbers of both ends."""
    edges = parents.where("parent is not null").select(F.col("hash").alias("of"), F.col("parent").alias("side")).distinct()
    to = labelled.select(F.col("hash").alias("other"), F.col("first").alias("side_first"))
    made = labelled.join(edges, F.col("hash") == F.col("of")).where("not (side <=> up) and side <> hash")
    return made.join(to, F.col("side") == F.col("other")).select("hash", "first", "last", "side", "side_first")


def footholds(parents: DataFrame, labelled: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, hash, first): commits from which, straight up the trees, all that each start (start) descends from is found.

    A round goes up the trees from what the last one found and over the edges
    beside them, so rounds are as many as a way changes trees, not as it is long.
    """
    sides = settled(side_edges(parents, labelled))
    here = labelled.select("hash", "first")
    front = settled(starts.select("start", F.col("start").alias("at")).distinct().join(here, F.col("at") == F.col("hash")).select("start", "hash", "first"))
    known = front
    while True:
        crossed = above(front.select("start", "first"), sides).select("start", F.col("side").alias("hash"), F.col("side_first").alias("first")).distinct()
        front = settled(crossed.join(known.select("start", "hash"), ["start", "hash"], "left_anti"))
        if front.isEmpty():
            return known
        known = settled(known.unionByName(front))


def nearby(parents: DataFrame, starts: DataFrame, rounds: int = MAX_LEVELS) -> DataFrame | None:
    """(start, hash) as :func:`reachable` has it, found from parent to parent; None if that takes more than ``rounds`` steps.

    A round joins the edges with what the last one found; while that is at most
    ``NEAR`` rows it is broadcast, and the edges stay where they are.
    """
    edges = settled(parents.where("parent is not null").select(F.col("hash").alias("of"), "parent"))
    front = known = settled(starts.select("start", F.col("start").alias("hash")).distinct())
    n = front.count()
    for _ in range(rounds):
        asked = F.broadcast(front) if n <= NEAR else front
        up = edges.join(asked, F.col("of") == F.col("hash")).select("start", F.col("parent").alias("hash")).distinct()
        front = settled(up.join(known, ["start", "hash"], "left_anti"))
        n = front.count()
        if not n:
            return known
        known = known.unionByName(front)
    return None


def reachable(parents: DataFrame, starts: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(start, hash): commits that each start (start) descends from, itself included. ``parents`` has (hash, parent).

    What lies within some steps is found by going there (:func:`nearby`). If there
    is more, or with :func:`labels` given, each row is written once: what lies
    above one of a start's footholds. A start without edges reaches itself.
    """
    if labelled is None and (found := nearby(parents, starts)) is not None:
        return found
    labelled = labels(parents) if labelled is None else labelled
    found = above(footholds(parents, labelled, starts).select("start", "first"), labelled.select("hash", "first", "last"))
    alone = starts.select("start").distinct().join(labelled, F.col("start") == F.col("hash"), "left_anti").select("start", F.col("start").alias("hash"))
    return settled(found.select("start", "hash").unionByName(alone))


def levels(commits: DataFrame, parents: DataFrame, at: str) -> DataFrame:
    """(hash, level): ``at`` of each commit, raised where it isn't above that of every parent.

    For dates that is one round, and one more for each commit that in a row of
    commits is dated before its parent. Raises :class:`CycleError` if rounds
    outnumber the commits.
    """
    now = settled(commits.select("hash", F.col(at).cast("long").alias("level")))
    edges = parents.where("parent is not null")
    most = now.count()
    for _ in range(most + 1):
        lower = now.select(F.col("hash").alias("p"), F.col("level").alias("least"))
        needs = edges.join(lower, F.col("parent") == F.col("p")).groupBy(F.col("hash").alias("of")).agg((F.max("least") + 1).alias("least"))
        raised = now.join(needs, F.col("hash") == F.col("of"), "left").select("hash", F.greatest("level", "least").alias("level"), (F.col("least") > F.col("level")).alias("up"))
        now = unsized(raised)
        if now.where("up").isEmpty():
            return now.select("hash", "level")
        now = now.select("hash", "level")
    raise CycleError("a circle of parents")


def tallied(labelled: DataFrame, sides: DataFrame) -> DataFrame:
    """(place, landed, open) for each number of a tree: how many ``sides`` lead to it or to numbers before it, and how many begin at or above its commit.

    Sums run inside blocks of numbers, and over the blocks.
    """
    step = lambda at, landed, open_: F.struct(F.col(at).alias("place"), F.lit(landed).alias("landed"), F.lit(open_).alias("open"))
    steps = sides.select(F.explode(F.array(step("side_first", 1, 0), step("first", 0, 1), step("last", 0, -1))).alias("s")).select("s.*")
    every = labelled.select(F.col("first").alias("place"), F.lit(0).alias("landed"), F.lit(0).alias("open")).unionByName(steps)
    block = F.expr("place div 4096").alias("block")
    added = settled(every.groupBy("place").agg(F.sum("landed").alias("landed"), F.sum("open").alias("open")).select(block, "*"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    before = added.groupBy("block").agg(F.sum("landed").alias("landed"), F.sum("open").alias("open")).select(F.col("block").alias("b"), so_far("landed", earlier).alias("l"), so_far("open", earlier).alias("o"))
    inside = Window.partitionBy("block").orderBy("place")
    return added.join(before, F.col("block") == F.col("b")).select("place", (F.col("l") + F.sum("landed").over(inside)).alias("landed"), (F.col("o") + F.sum("open").over(inside)).alias("open"))


def descends(parents: DataFrame, pairs: DataFrame, labelled: DataFrame | None = None, levelled: DataFrame | None = None) -> DataFrame:
    """(of, from, descends) of distinct ``pairs`` (of, from): whether ``from`` is ``of`` or descends from it.

    Most answers are comparisons: ``of`` lies above ``from`` in the trees (yes),
    or its level isn't below (no). Only for the rest the edges beside the trees
    are searched, and of those none that leads outside the two levels: up from
    ``from``, or down from ``of`` where fewer of them end in its subtree.
    """
    labelled = labels(parents) if labelled is None else labelled
    levelled = labelled.select("hash", F.lit(0).cast("long").alias("level")) if levelled is None else levelled
    facts = settled(labelled.join(levelled.select(F.col("hash").alias("h"), "level"), F.col("hash") == F.col("h"), "left").select("hash", "first", "last", "level"))
    of = facts.select(F.col("hash").alias("of"), F.col("first").alias("of_first"), F.col("last").alias("of_last"), F.col("level").alias("of_level"))
    from_ = facts.select(F.col("hash").alias("from"), "first", F.col("level").alias("from_level"))
    asked = pairs.select("of", "from").distinct().join(of, "of", "left").join(from_, "from", "left")
    inside = (F.col("first") >= F.col("of_first")) & (F.col("first") < F.col("of_last"))
    above_it = F.col("of_level") >= F.col("from_level")
    told = F.when(F.col("of").eqNullSafe(F.col("from")), True).when(F.col("of_first").isNull() | F.col("first").isNull(), False).when(inside, True)
    uneven = facts.agg(F.max("level") > F.min("level")).first()[0]
    told = told.when(above_it, False) if uneven else told
    asked = settled(asked.withColumn("told", told))
    sides = side_edges(parents, labelled)
    end = facts.select(F.col("hash").alias("e"), F.col("level").alias("side_level"))
    begin = facts.select(F.col("hash").alias("b"), F.col("level").alias("own_level"))
    sides = settled(sides.join(end, F.col("side") == F.col("e")).join(begin, F.col("hash") == F.col("b")).drop("e", "b"))
    goal = F.struct("of", "from")
    goals = asked.where("told is null").select(goal.alias("start"), "of_first", "of_last", "of_level", "first", "from_level")
    sums = settled(tallied(labelled, sides))
    for name, at in (("up", F.col("first")), ("upto", F.col("of_last") - 1), ("below", F.col("of_first") - 1)):
        found = sums.select("place", F.col("open" if name == "up" else "landed").alias(name))
        goals = goals.join(found, at == F.col("place"), "left").drop("place")
    goals = settled(goals.withColumn("down", F.col("upto") - F.coalesce("below", F.lit(0))).where("up > 0 and down > 0"))
    met = upward(goals.where("up <= down"), sides) + downward(goals.where("up > down"), sides)
    yes = functools.reduce(DataFrame.unionByName, met).distinct().withColumn("yes", F.lit(True)) if met else goals.select("start").limit(0).withColumn("yes", F.lit(True))
    full = asked.withColumn("start", goal).join(yes, "start", "left").select("of", "from", F.coalesce("told", "yes", F.lit(False)).alias("descends"))
    return full


def upward(goals: DataFrame, sides: DataFrame) -> list[DataFrame]:
    """(start) of goals whose commit is found by going up from the other one, round by round."""
    front = known = settled(goals.select("start", "first"))
    bounds, met = goals.select("start", "of_first", "of_last", "of_level"), []
    while not front.isEmpty():
        crossed = above(front, sides).select("start", F.col("side_first").alias("first"), "side_level").join(bounds, "start").where("coalesce(side_level >= of_level, true)")
        hits = settled(crossed.where("first >= of_first and first < of_last").select("start").distinct())
        met.append(hits)
        front = settled(crossed.select("start", "first").distinct().join(known, ["start", "first"], "left_anti").join(hits, "start", "left_anti"))
        known = settled(known.unionByName(front))
    return met


def downward(goals: DataFrame, sides: DataFrame) -> list[DataFrame]:
    """(start) of goals found by going down: over the edges that end in a subtree, to the subtrees in which they begin."""
    front = settled(goals.select("start", F.col("of_first").alias("lo"), F.col("of_last").alias("hi")))
    known = front
    bounds, met = goals.select("start", F.col("first").alias("goal"), "from_level"), []
    ends = sides.select(F.lit(0).alias("tree"), "side_first", "first", "last", "own_level")
    outer = F.max("hi").over(Window.partitionBy("start").orderBy("lo", F.desc("hi")).rowsBetween(Window.unboundedPreceding, -1))
    while not front.isEmpty():
        crossed = sweeps.containing(ends, front.withColumn("tree", F.lit(0)), "tree", "side_first", "lo", "hi")
        crossed = crossed.select("span.start", F.col("row.first").alias("lo"), F.col("row.last").alias("hi"), "row.own_level").join(bounds, "start").where("coalesce(own_level <= from_level, true)")
        crossed = settled(crossed)
        hits = settled(crossed.where("goal >= lo and goal < hi").select("start").distinct())
        met.append(hits)
        fresh = crossed.select("start", "lo", "hi").distinct().withColumn("outer", outer).where("outer is null or outer < hi").drop("outer")
        front = settled(fresh.join(known, ["start", "lo", "hi"], "left_anti").join(hits, "start", "left_anti"))
        known = settled(known.unionByName(front))
    return met


def best_first(rows: list[tuple], heads: list, most: int) -> tuple[list, bool]:
    """The first ``most`` of rows (hash, at, parents) from ``heads``, newest first and none before a child, and whether a parent was missing."""
    known = {h: (at, parents) for h, at, parents in rows}
    ready = [(-known[h][0], h) for h in heads if h in known]
    heapq.heapify(ready)
    seen, out, missing = set(heads), [], any(h not in known for h in heads)
    while ready and len(out) < most:
        _, h = heapq.heappop(ready)
        out.append(h)
        for p in known[h][1]:
            if p not in seen:
                seen.add(p)
                if p in known:
                    heapq.heappush(ready, (-known[p][0], p))
                else:
                    missing = True
    return out, missing


def walked(commits: DataFrame, parents: DataFrame, heads: list, most: int) -> DataFrame:
    """(walk_idx, hash): the first ``most`` commits from ``heads``, the newest known one first (of equal dates the least hash); a parent only after a child.

    ``commits`` has (hash, at). Only the newest commits are looked at, twice
    ``most`` at first: what is older can't come before all of them that are ready.
    If the way leaves them too early, four times as many are taken, and from then
    on of those alone that the heads descend from. The walk itself is one task
    over that window, which ``most`` bounds.
    """
    spark = commits.sparkSession
    spark_heads = spark.createDataFrame([(h,) for h in heads], commits.select(F.col("hash").alias("start")).schema)
    kind, size, among = commits.schema["hash"].dataType, 2 * most, commits.select("hash", F.col("at").cast("long").alias("at"))
    edges = parents.where("parent is not null").select(F.col("hash").alias("of"), "parent")
    schema = StructType().add("walk_idx", LongType()).add("hash", kind).add("missing", BooleanType())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["hash"], r["at"], r["up"]) for b in batches for r in b.to_pylist()]
        out, missing = best_first(rows, heads, most)
        yield pa.RecordBatch.from_pydict({"walk_idx": list(range(len(out))), "hash": out, "missing": [missing] * len(out)}, schema=to_arrow_schema(schema))

    while True:
        newest = settled(among.orderBy(F.desc("at"), "hash").limit(size))
        up = newest.join(edges, F.col("hash") == F.col("of"), "left").groupBy("hash", "at").agg(F.array_sort(F.collect_set("parent")).alias("up"))
        found = settled(up.repartition(1).mapInArrow(walk, schema))
        n = found.count()
        if n >= most or newest.count() < size or (n and not found.first()["missing"]):
            return found.select("walk_idx", "hash")
        if size == 2 * most:
            among = among.join(reachable(parents, spark_heads).select("hash").distinct(), "hash", "left_semi")
        size *= 4


def ahead_behind(parents: DataFrame, local: str, upstream: str) -> DataFrame:
    """One row (ahead, behind): commits of one side that the other lacks."""
    spark = parents.sparkSession
    reach = reachable(parents, spark.createDataFrame([(local,), (upstream,)], "start string"))
    mine, theirs = (reach.where(F.col("start") == x).select("hash") for x in (local, upstream))
    ahead, behind = mine.exceptAll(theirs).agg(F.count(F.lit(1)).alias("ahead")), theirs.exceptAll(mine).agg(F.count(F.lit(1)).alias("behind"))
    return ahead.join(behind, F.lit(True))
