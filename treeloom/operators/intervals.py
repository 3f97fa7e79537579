"""Interval and nearest-row operators.

Intervals are two columns. Nothing here pairs all rows of a group: what lies
around a point is found by a sweep (:mod:`treeloom.operators.sweeps`), what lies
before or after it by sorting it among the places where the answer changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators import sweeps


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two inclusive ranges share a point."""
    return (a_start <= b_end) & (a_end >= b_start)


def clamp(df: DataFrame, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Rows whose inclusive range meets [low, high], cut to it."""
    inside = df.where(overlaps(F.col(start), F.col(end), low, high))
    return inside.withColumns({start: F.greatest(F.col(start), low), end: F.least(F.col(end), high)})


def deepest(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, depth: str, order: str) -> DataFrame:
    """For each point, repeated ones too, the deepest span around it, the first in order among equals. Points outside get none."""
    found = sweeps.innermost(points, spans, key, at, start, end, -F.col(depth), F.col(order))
    each = found.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return each.select("row.*", *[f"span.{c}" for c in spans.columns if c != key])


def as_of(points: DataFrame, starts: DataFrame, key: str, at: str, start: str, value: str) -> DataFrame:
    """For each point the ``value`` of the last start that isn't after it: one sort, no join."""
    a = points.select(F.col(key), F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*points.columns).alias("__row"), F.lit(None).cast(starts.schema[value].dataType).alias("__v"))
    b = starts.select(F.col(key), F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    before = Window.partitionBy(key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = a.unionByName(b).withColumn(value, F.last("__v", ignorenulls=True).over(before))
    return filled.where("__kind = 1").select("__row.*", value)


def nearest(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, name: str, order: str) -> DataFrame:
    """For each point, repeated ones too, the span with the nearest boundary; of equally near ones that before it, then the first in order.

    A span around the point is nearest of all. Points without a span in their
    group get no row. The last end before a point and the first start after it
    are looked up as of the point.
    """
    first = F.min_by(name, order)
    ends = spans.groupBy(key, F.col(end).alias("__e")).agg(F.struct(F.min(end).alias("e"), F.min(order).alias("o"), first.alias("n")).alias("__before"))
    starts = spans.groupBy(key, (-F.col(start)).alias("__s")).agg(F.struct(F.min(start).alias("s"), F.min(order).alias("o"), first.alias("n")).alias("__after"))
    numbered = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("__times")).withColumn("__back", -F.col(at) - 1)
    around = sweeps.innermost(points, spans.select(key, start, end, F.col(name).alias("__name"), F.col(order).alias("__order")), key, at, start, end, F.col("__order"))
    inside = around.select(*[F.col(f"row.{c}").alias(f"__in_{c}") for c in points.columns], F.col("span.__name").alias("__inside"), F.col("span.__order").alias("__io"))
    sided = as_of(as_of(numbered, ends, key, at, "__e", "__before"), starts, key, "__back", "__s", "__after")
    same = [F.col(c).eqNullSafe(F.col(f"__in_{c}")) for c in points.columns]
    joined = sided.join(inside, same, "left")
    choice = lambda there, d, after, o, n: F.when(there, F.struct(d.cast("long").alias("d"), F.lit(after).alias("after"), o.alias("o"), n.alias("n")))
    best = F.array_min(F.array_compact(F.array(
        choice(F.col("__io").isNotNull(), F.lit(0), 0, F.col("__io"), F.col("__inside")),
        choice(F.col("__before").isNotNull(), F.col(at) - F.col("__before.e") + 1, 0, F.col("__before.o"), F.col("__before.n")),
        choice(F.col("__after").isNotNull(), F.col("__after.s") - F.col(at), 1, F.col("__after.o"), F.col("__after.n")),
    )))
    found = joined.withColumn("__best", best).where(F.col("__best").isNotNull())
    return found.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times")))).select(*points.columns, F.col("__best.n").alias(name))


def nearest_event(left: DataFrame, right: DataFrame, key: str, at: str, id_: str) -> DataFrame:
    """``left`` with ``near``: the row of ``right`` nearest in ``at`` within ``key``, the earlier one on ties.

    Two windows over one sort find the last row before and the first after;
    groups are never multiplied out.
    """
    both = left.select(key, at, id_, F.lit(True).alias("__l")).unionByName(right.select(key, at, id_, F.lit(False).alias("__l")))
    hit = F.when(~F.col("__l"), F.struct(F.col(at).alias("t"), F.col(id_).alias("i")))
    order = Window.partitionBy(key).orderBy(at, "__l", id_)
    before = F.last(hit, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(hit, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumns({"__b": before, "__a": after}).where("__l")
    gap_b, gap_a = F.col(at) - F.col("__b.t"), F.col("__a.t") - F.col(at)
    near = F.when(F.col("__a").isNull() | (gap_b <= gap_a), F.col("__b.i")).otherwise(F.col("__a.i"))
    return found.select(id_, near.alias("near"))


def offset_map(regions: DataFrame, key: str, order: str, real: str, length: str) -> DataFrame:
    """Regions with ``virtual``, where each begins once they are put together."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return regions.withColumn("virtual", F.coalesce(F.sum(length).over(before), F.lit(0)))


def to_real(points: DataFrame, mapped: DataFrame, key: str, at: str, real: str) -> DataFrame:
    """Real places of virtual ones: the region that begins last before the point, and as far into it."""
    starts = mapped.select(key, F.col("virtual"), F.struct(F.col(real).alias("r"), F.col("virtual").alias("v")).alias("region"))
    return as_of(points, starts, key, at, "virtual", "region").withColumn("real", F.col("region.r") + F.col(at) - F.col("region.v")).drop("region")


def adjacent_conflicts(edits: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Edits that begin before their predecessor ends; only neighbours are compared, and two empty ones never clash."""
    order = Window.partitionBy(key).orderBy(start, F.col(end) > F.col(start), tie, end)
    last = edits.withColumns({"prev_start": F.lag(start).over(order), "prev_end": F.lag(end).over(order), "prev": F.lag(tie).over(order)})
    both_empty = (F.col("prev_start") == F.col("prev_end")) & (F.col(start) == F.col(end))
    return last.where((F.col("prev_end") > F.col(start)) & ~both_empty)


def in_changed_range(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Whether an inclusive range touches the half-open [low, high)."""
    return (start < high) & (end >= low)


def touching_commits(changes: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """Changes whose new lines meet a symbol's current lines; a hunk of no lines counts as one.

    A hunk meets a symbol if one lies around its first line, or if the next to
    begin after that does so before the hunk ends.
    """
    begin = F.col("hunk_new_start").cast("long")
    last = begin + F.greatest(F.col("hunk_new_lines"), F.lit(1)) - 1
    ends = symbols.select(key, F.col("start_line").cast("long").alias("__s"), (F.col("end_line") + 1).cast("long").alias("__e"))
    hunks = changes.where(F.col(key).isNotNull()).withColumns({"__at": begin, "__last": last, "__back": -begin})
    starts = ends.groupBy(key, (-F.col("__s")).alias("__s")).agg(F.min("__s").alias("__next"))
    sided = as_of(hunks, starts, key, "__back", "__s", "__next")
    places = hunks.select(F.col(key).alias("__key"), "__at").distinct()
    inside = sweeps.innermost(places, ends.withColumnRenamed(key, "__key"), "__key", "__at", "__s", "__e", F.col("__e")).select(F.col("row.__key").alias("__in_key"), F.col("row.__at").alias("__in_at"), F.lit(True).alias("__in"))
    met = sided.join(inside, (F.col(key) == F.col("__in_key")) & (F.col("__at") == F.col("__in_at")), "left")
    return met.where(F.col("__in") | (F.col("__next") <= F.col("__last"))).select(*changes.columns)
