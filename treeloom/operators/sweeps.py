"""Which spans lie around a point: one sort and a sweep, however wide or nested the spans.

Points and spans are laid out by (key, place) and cut into parts of about equal
size at places that a sample names, so a busy key is spread over many parts and
one part is one partition. Inside a part its rows come in order of key and place,
and the spans still open wait in a heap.

A span that reaches beyond its part is written once more, for the part in which
it ends, and is open there from the start. Parts that lie wholly inside a span
need none of its rows: of all spans over a part only the best by rank can be an
answer, and that one is found over the parts alone. A span is listed under the
two runs of 2**k parts that make up what it covers, the best of each run goes to
the driver (runs are fewer than parts times their logarithm), and runs hand their
best down to their halves. So a span costs two rows, or three, whatever it covers.

Where all pairs are wanted (:func:`containing`), a span is written for every
part it crosses, each of which has a point or another span's beginning.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sampled places for each part.
SAMPLE = 20

FIXED = "part int, hash long, phase int, place long, kind int, until long"


def places(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Where parts begin, by rows (hash, place): at most ``parts - 1`` places, from a sample of fixed size.

    Each distinct place has the same chance: it is dealt to a bucket by one hash
    and stands for it if another is the least there.
    """
    bucket, order = F.pmod(F.xxhash64("hash", "place"), F.lit(parts * SAMPLE)), F.xxhash64("place", "hash")
    picked = rows.groupBy(bucket.alias("bucket")).agg(F.min_by(F.struct("hash", "place"), order).alias("p"))
    found = sorted((r["p"]["hash"], r["p"]["place"]) for r in picked.collect())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)} if found else [])


def part_of(cuts: list[tuple[int, int]], hash_: Column, place: Column) -> Column:
    """The part of a place; parts rise with places of one key."""
    if not cuts:
        return F.lit(0)

    def find(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for h, p in batches:
            yield pa.array([bisect_right(cuts, x) for x in zip(h.to_pylist(), p.to_pylist())], pa.int32())

    return F.arrow_udf(find, "int")(hash_, place)


def ranked(rank: dict | None) -> tuple:
    """A rank as Python compares it: nulls first, then by value."""
    return tuple((v is not None, v) for v in rank.values())


def best_over_parts(spans: DataFrame) -> list[tuple]:
    """(part, best) for each part that lies wholly inside a span: the best by rank of all such. ``spans`` has (first, last, rank, kept)."""
    size = F.col("last") - F.col("first") - 1
    level = F.floor(F.log2(size)).cast("int")
    runs = F.array_distinct(F.array(F.col("first") + 1, F.col("last") - F.pow(F.lit(2), level).cast("int")))
    listed = spans.where(size > 0).select(level.alias("level"), F.explode(runs).alias("run"), "rank", "kept")
    best = {(r["level"], r["run"]): (ranked(r["b"]["rank"].asDict()), r["b"]["kept"]) for r in listed.groupBy("level", "run").agg(F.min_by(F.struct("rank", "kept"), "rank").alias("b")).collect()}
    for n in range(max((n for n, _ in best), default=0), 0, -1):
        for (_, run), found in [x for x in best.items() if x[0][0] == n]:
            for half in (run, run + (1 << n - 1)):
                there = best.get((n - 1, half))
                best[n - 1, half] = found if there is None or found[0] < there[0] else there
    return [(run, found[1]) for (n, run), found in best.items() if n == 0]


def swept(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, rank: list[Column], every: bool, after: str | None = None) -> DataFrame:
    """(row, span): each point with the best span around it by ``rank``, least first, or with every one; both as structs. Other points have no row.

    With ``after``, only spans that begin after that place of the point count (for every one).
    """
    spark = points.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = F.xxhash64(key).alias("hash")
    p = points.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(hashed, F.col(key).alias("key"), F.col(at).cast("long").alias("place"), F.struct(*[F.col(c) for c in points.columns]).alias("row"))
    begin, until = F.col(start).cast("long"), F.col(end).cast("long")
    named = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)])
    s = spans.where(F.col(key).isNotNull() & (until > begin)).select(hashed, F.col(key).alias("key"), begin.alias("place"), until.alias("until"), named.alias("rank"), F.struct(*[F.col(c) for c in spans.columns]).alias("span"))
    cuts = places(p.select("hash", "place").unionByName(s.select("hash", "place")), parts)
    s = s.withColumns({"first": part_of(cuts, F.col("hash"), F.col("place")), "last": part_of(cuts, F.col("hash"), F.col("until") - 1)})
    none = {c: F.lit(None).cast(t) for c, t in (("row", p.schema["row"].dataType), ("rank", s.schema["rank"].dataType), ("span", s.schema["span"].dataType), ("until", "long"))}
    if after:
        p = p.withColumn("until", F.col(f"row.{after}").cast("long"))  # a point has no end; its column tells where spans may begin
    columns = ["part", "hash", "key", "phase", "place", "kind", "until", "rank", "row", "span"]
    asked = p.withColumns({"part": part_of(cuts, F.col("hash"), F.col("place")), "phase": F.lit(1), "kind": F.lit(1), "until": F.col("until") if after else none["until"], "rank": none["rank"], "span": none["span"]})
    opened = s.withColumns({"part": F.col("first"), "phase": F.lit(1), "kind": F.lit(0), "row": none["row"]})
    events = asked.select(*columns).unionByName(opened.select(*columns))
    if cuts:
        beyond = s.where("last > first").withColumns({"phase": F.lit(0), "kind": F.lit(0), "row": none["row"]})
        events = events.unionByName(beyond.withColumn("part", F.explode(F.sequence(F.col("first") + 1, F.col("last"))) if every else F.col("last")).select(*columns))
    if cuts and not every:
        kept = F.struct("hash", "key", "rank", "span").alias("kept")
        over = [(part, x["hash"], x["key"], 0, None, 0, None, x["rank"], None, x["span"]) for part, x in best_over_parts(s.select("first", "last", "rank", kept))]
        if over:
            events = events.unionByName(spark.createDataFrame(over, events.schema))
    order = ["part", "hash", "key", "phase", "place", "kind"]
    dealt = events.repartitionById(len(cuts) + 1, "part").sortWithinPartitions(*order)
    kinds = p.select("row").schema.add(s.schema["span"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, nth, room = None, [], 0, 0
        for batch in batches:
            part, key_, kind, place, until = (batch.column(c).to_pylist() for c in ("part", "key", "kind", "place", "until"))
            ranks, spans_ = batch.column("rank"), batch.column("span")
            at_, found = [], []
            for i, k in enumerate(kind):
                if (here := (part[i], key_[i])) != now:
                    now, open_, room = here, [], 0
                if k and every:  # in the order of their beginnings; ended ones go when they are last, or are many
                    while open_ and open_[-1][0] <= place[i]:
                        open_.pop()
                    if len(open_) > room:
                        open_ = [x for x in open_ if x[0] > place[i]]
                        room = 2 * len(open_) + 1000
                    for x in reversed(open_):
                        if after and x[1] <= until[i]:
                            break
                        if x[0] > place[i]:
                            at_.append(i)
                            found.append(x[2])
                elif k:
                    while open_ and open_[0][2] is not None and open_[0][2] <= place[i]:
                        heapq.heappop(open_)
                    if open_:
                        at_.append(i)
                        found.append(open_[0][3])
                elif every:
                    open_.append((until[i], place[i], spans_[i].as_py()))
                else:
                    nth += 1
                    heapq.heappush(open_, (ranked(ranks[i].as_py()), nth, until[i], spans_[i].as_py()))
            if at_:
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at_)), pa.array(found, spans_.type)], ["row", "span"])

    return dealt.mapInArrow(best, kinds)


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, *rank: Column) -> DataFrame:
    """(row, span, times): for each distinct point inside a half-open span, the span with the least ``rank``, and how often the point comes.

    Repeated points are put together before they are dealt out, since equal ones can't be parted.
    """
    times = "times"
    while times in points.columns:
        times += "_"
    once = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias(times))
    found = swept(once, spans, key, at, start, end, list(rank), every=False)
    return found.select(F.struct(*[f"row.{c}" for c in points.columns]).alias("row"), "span", F.col(f"row.{times}").alias("times"))


def containing(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, after: str | None = None) -> DataFrame:
    """(row, span): all pairs of points and half-open spans around them within ``key``; with ``after``, of spans that begin after that column of the point."""
    return swept(points, spans, key, at, start, end, [F.lit(0)], every=True, after=after)
