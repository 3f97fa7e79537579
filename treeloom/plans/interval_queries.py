"""Interval operators over orders, events and documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from treeloom.functions import text
from treeloom.operators import intervals, sweeps
from treeloom.plans.registry import query, read
from treeloom.plans.text_queries import LINES


def hunks(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("start_line"), (F.col("l_linenumber") + F.floor("l_quantity")).alias("end_line")
    )


HUNKS = "(SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS start_line, l_linenumber + CAST(floor(l_quantity) AS BIGINT) AS end_line FROM lineitem)"


@query(f"SELECT l_orderkey, greatest(start_line, 2) AS start_line, least(end_line, 10) AS end_line FROM {HUNKS} WHERE start_line <= 10 AND end_line >= 2")
def interval_overlap_clamp(spark, sf_dir):
    """Hunks that meet lines 2 to 10, cut to them."""
    return intervals.clamp(hunks(spark, sf_dir), "start_line", "end_line", F.lit(2).cast("long"), F.lit(10).cast("long"))


@query(f"""
SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM {HUNKS} h WHERE h.l_orderkey = o.o_orderkey AND h.start_line <= 4 AND h.end_line >= 3)""")
def interval_semi(spark, sf_dir):
    """Orders with a hunk that meets lines 3 to 4."""
    changes = hunks(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    hit = changes.where(intervals.overlaps(F.col("s"), F.col("e"), F.lit(3), F.lit(4)))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(hit, "o_orderkey", "left_semi")


@query("SELECT doc_id, CAST(len(string_split(left(text, instr(text, ' ')), chr(10))) AS BIGINT) AS line_no FROM documents WHERE instr(text, ' ') > 0")
def offset_to_line(spark, sf_dir):
    """The line that holds a text's first space, looked up as of its offset."""
    docs = read(spark, sf_dir, "documents").where(F.instr("text", " ") > 0)
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).alias("begin"))
    probes = docs.select("doc_id", (F.instr("text", " ") - 1).cast("long").alias("at"))
    return intervals.as_of(probes, starts, "doc_id", "at", "begin", "line_no").select("doc_id", "line_no")


@query("""
WITH d AS (SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents),
s AS (SELECT doc_id, 0 AS depth, 0::BIGINT AS ord, 0::BIGINT AS a, n AS b, 'doc' AS name FROM d
  UNION ALL SELECT doc_id, 1, CAST(i AS BIGINT), n * i // 4, n * (i + 1) // 4, 'part' || i FROM d, unnest(range(4)) AS u(i)
  UNION ALL SELECT doc_id, 2, CAST(i AS BIGINT), n * i // 16, n * i // 16 + n // 40, 'line' || i FROM d, unnest(range(16)) AS u(i))
SELECT doc_id, "at", name FROM (SELECT d.doc_id, n // 3 AS "at", name, row_number() OVER (PARTITION BY d.doc_id ORDER BY depth DESC, ord) AS r
  FROM d JOIN s ON s.doc_id = d.doc_id AND n // 3 >= a AND n // 3 < b) WHERE r = 1""")
def deepest_containing(spark, sf_dir):
    """The deepest of nested windows around the place a third into each text."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    i = F.col("i")
    parts = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("doc_id", F.lit(1).alias("depth"), i.cast("long").alias("ord"), F.expr("n * i div 4").alias("a"), F.expr("n * (i + 1) div 4").alias("b"), F.concat(F.lit("part"), i.cast("string")).alias("name"))
    fine = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(15)))).select("doc_id", F.lit(2).alias("depth"), i.cast("long").alias("ord"), F.expr("n * i div 16").alias("a"), F.expr("n * i div 16 + n div 40").alias("b"), F.concat(F.lit("line"), i.cast("string")).alias("name"))
    whole = d.select("doc_id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ord"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), F.lit("doc").alias("name"))
    probes = d.select("doc_id", F.expr("n div 3").alias("at"))
    return intervals.deepest(probes, whole.unionByName(parts).unionByName(fine), "doc_id", "at", "a", "b", "depth", "ord").select("doc_id", "at", "name")


@query("""
SELECT event_id, near FROM (
 SELECT e.event_id, p.event_id AS near, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(epoch_us(e.ts) - epoch_us(p.ts)), epoch_us(p.ts) > epoch_us(e.ts), CASE WHEN epoch_us(p.ts) > epoch_us(e.ts) THEN p.event_id ELSE -p.event_id END) AS r
 FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' WHERE e.event_type = 'error') WHERE r = 1""")
def nearest_preceding_first(spark, sf_dir):
    """For each error the user's nearest purchase; the earlier one on ties."""
    events = read(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type")
    return intervals.nearest_event(events.where("event_type = 'error'"), events.where("event_type = 'purchase'"), "user_id", "at", "event_id")


@query("""
WITH l AS (SELECT doc_id, i, ls[i] AS line, CAST(coalesce(list_sum(list_transform(ls[1:i-1], lambda x: length(x) + 1)), 0) AS BIGINT) AS real
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)),
r AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS virtual FROM l WHERE i % 2 = 1),
p AS (SELECT doc_id, CAST(sum(length(line) + 1) AS BIGINT) // 2 AS "at" FROM r GROUP BY doc_id)
SELECT doc_id, "at", real + "at" - virtual AS real FROM (SELECT p.doc_id, p."at", r.real, r.virtual, row_number() OVER (PARTITION BY p.doc_id ORDER BY r.virtual DESC, r.i DESC) AS k
  FROM p JOIN r ON r.doc_id = p.doc_id AND r.virtual <= p."at") WHERE k = 1""")
def virtual_offset_map(spark, sf_dir):
    """Odd lines put together; the middle of what results, mapped back to the text."""
    parts = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    n = (F.length("line") + 1).cast("long")
    regions = parts.select("doc_id", "i", n.alias("n"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias("real")).where("i % 2 = 0")
    mapped = intervals.offset_map(regions, "doc_id", "i", "real", "n")
    probes = regions.groupBy("doc_id").agg(F.expr("sum(n) div 2").alias("at"))
    return intervals.to_real(probes, mapped, "doc_id", "at", "real")


@query("""
WITH e AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 50 AS BIGINT) AS a, CAST(l_partkey % 50 + CAST(floor(l_quantity) AS BIGINT) % 10 AS BIGINT) AS b FROM lineitem),
o AS (SELECT *, lag(a) OVER w AS prev_a, lag(b) OVER w AS prev_b, lag(l_linenumber) OVER w AS prev FROM e WINDOW w AS (PARTITION BY l_orderkey ORDER BY a, b > a, l_linenumber, b))
SELECT l_orderkey, l_linenumber, prev FROM o WHERE prev_b > a AND NOT (prev_a = prev_b AND a = b)""")
def adjacent_conflicts(spark, sf_dir):
    """Neighbouring edits of an order that overlap."""
    a = (F.col("l_partkey") % 50).cast("long")
    edits = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), (a + F.floor("l_quantity") % 10).alias("b"))
    return intervals.adjacent_conflicts(edits, "l_orderkey", "a", "b", "l_linenumber").select("l_orderkey", "l_linenumber", "prev")


@query("SELECT conv_id, turn FROM conversations WHERE turn >= conv_id % 3 AND turn < conv_id % 3 + 2")
def point_in_changed_range(spark, sf_dir):
    low = F.col("conv_id") % 3
    return read(spark, sf_dir, "conversations").where(intervals.in_changed_range(F.col("turn"), F.col("turn"), low, low + 2)).select("conv_id", "turn")


@query(f"""
WITH l AS (SELECT doc_id, CAST(i AS BIGINT) AS i FROM (SELECT doc_id, {LINES} AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)),
t AS (SELECT doc_id, max(i) AS last FROM l GROUP BY doc_id),
s AS (SELECT doc_id, 'doc' AS name, 1::BIGINT AS a, last + 1 AS b FROM t UNION ALL SELECT doc_id, 'half', 1, last // 2 + 1 FROM t UNION ALL SELECT doc_id, 'quarter', 1, last // 4 + 1 FROM t)
SELECT doc_id, i, name FROM (SELECT l.doc_id, l.i, s.name, row_number() OVER (PARTITION BY l.doc_id, l.i ORDER BY s.b - s.a, s.name DESC) AS r
  FROM l JOIN s ON s.doc_id = l.doc_id AND l.i >= s.a AND l.i < s.b) WHERE r = 1""")
def innermost_assignment(spark, sf_dir):
    """Each line to the smallest of the nested sections around it."""
    parts = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("p", "line"))
    rows = parts.select("doc_id", (F.col("p") + 1).cast("long").alias("i"))
    last = rows.groupBy("doc_id").agg(F.max("i").alias("last"))
    spans = last.select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("depth"), F.expr(f"last div {d} + 1").alias("b")) for k, (n, d) in enumerate((("doc", 1), ("half", 2), ("quarter", 4)))])).alias("s"))
    spans = spans.select("doc_id", "s.name", "s.depth", F.lit(1).cast("long").alias("a"), "s.b")
    return intervals.deepest(rows, spans, "doc_id", "i", "a", "b", "depth", "name").select("doc_id", "i", "name")


@query("""
WITH h AS (SELECT l_orderkey, l_linenumber, l_suppkey AS path, l_partkey % 1000 AS a, l_partkey % 1000 + greatest(CAST(floor(l_quantity) AS BIGINT), 1) - 1 AS b FROM lineitem),
s AS (SELECT s_suppkey AS path, i * 90 + s_nationkey AS a, i * 90 + s_nationkey + i * 3 AS b FROM supplier, unnest(range(11)) AS u(i))
SELECT l_orderkey, l_linenumber FROM h WHERE EXISTS (SELECT 1 FROM s WHERE s.path = h.path AND h.a <= s.b AND h.b >= s.a)""")
def touching_hunks(spark, sf_dir):
    """Hunks that meet one of a file's eleven symbols."""
    hunks_ = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("path"), (F.col("l_partkey") % 1000).alias("hunk_new_start"), F.floor("l_quantity").alias("hunk_new_lines"))
    begin = F.col("i") * 90 + F.col("s_nationkey")
    symbols = read(spark, sf_dir, "supplier").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(10)))).select(F.col("s_suppkey").alias("path"), begin.alias("start_line"), (begin + F.col("i") * 3).alias("end_line"))
    return intervals.touching_commits(hunks_, symbols, "path").select("l_orderkey", "l_linenumber")


@query("""
WITH p AS (SELECT c_custkey, c_nationkey AS k, CAST(floor(c_acctbal) AS BIGINT) AS "at" FROM customer),
s AS (SELECT s_suppkey, s_nationkey AS k, CAST(floor(s_acctbal) AS BIGINT) AS a, CAST(floor(s_acctbal) AS BIGINT) + s_suppkey % 7 * 500 AS b FROM supplier)
SELECT c_custkey, s_suppkey FROM p JOIN s ON p.k = s.k AND p."at" >= s.a AND p."at" < s.b""")
def spans_around(spark, sf_dir):
    """Every span of a supplier's balance around a customer's of the same nation."""
    points = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.floor("c_acctbal").alias("at"))
    spans = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.floor("s_acctbal").alias("a"), (F.floor("s_acctbal") + F.col("s_suppkey") % 7 * 500).alias("b"))
    return sweeps.containing(points, spans, "k", "at", "a", "b").select("row.c_custkey", "span.s_suppkey")
