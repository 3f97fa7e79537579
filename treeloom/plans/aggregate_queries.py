"""Grouped operators over orders, events, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeloom.operators import aggregates, graph, history
from treeloom.plans.registry import query, read


@query("""
SELECT o_custkey, count(*) AS commits FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500) GROUP BY o_custkey""")
def contributors(spark, sf_dir):
    """Orders by customer among the newest 500."""
    newest = aggregates.recent(read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 500)
    return aggregates.contributors(newest, "o_custkey")


@query("""
WITH w AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS walk_idx FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5000))
SELECT o_orderkey, o_custkey FROM w WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY walk_idx LIMIT 50""")
def contributors_examined_cap(spark, sf_dir):
    """The first 50 touching orders among the 5000 newest."""
    from pyspark.sql import Window

    newest = aggregates.recent(read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), [F.desc("o_orderdate"), F.asc("o_orderkey")], aggregates.EXAMINED)
    walk = newest.withColumn("walk_idx", F.row_number().over(Window.orderBy(F.desc("o_orderdate"), "o_orderkey")) - 1)  # of at most 5000 rows
    touching = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return aggregates.walked(walk.join(touching, "o_custkey", "left_semi"), F.lit(True), 50).select("o_orderkey", "o_custkey")


@query("""
SELECT coalesce((SELECT source FROM documents WHERE source <> 'src0' GROUP BY source ORDER BY count(*) DESC, source LIMIT 1), 'ext') AS source""")
def ext_dominant(spark, sf_dir):
    return aggregates.dominant(read(spark, sf_dir, "documents"), "source", "src0", "ext")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def ext_counts(spark, sf_dir):
    """Files by extension, where sources are the extensions."""
    index = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc."), "source").alias("path"))
    return history.extensions(index).withColumnRenamed("ext", "source")


@query("""
WITH m AS (SELECT user_id, event_type, event_id, count(*) OVER w AS n, min(event_id) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id, event_type))
SELECT user_id, event_type, event_id, CASE WHEN n < 3 THEN 1 ELSE n END AS n FROM m WHERE n < 3 OR event_id = f""")
def collapse_groups(spark, sf_dir):
    """Types with three or more rows become one; others stay."""
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return aggregates.collapsed(events, ["user_id"], "event_type", "event_id")


@query("""
SELECT v.t AS event_type, count(e.event_id) AS n, CAST(v.i AS INTEGER) AS nth FROM (VALUES ('error', 0), ('refund', 1), ('view', 2)) v(t, i) LEFT JOIN events e ON e.event_type = v.t GROUP BY v.t, v.i""")
def zero_bucket_counts(spark, sf_dir):
    """Counts of configured types, one of which has no rows."""
    return aggregates.bucketed(spark, read(spark, sf_dir, "events"), "event_type", ["error", "refund", "view"])


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS role FROM conversations GROUP BY conv_id")
def group_rows_per_key(spark, sf_dir):
    return aggregates.joined_rows(read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", ">")


@query("""
SELECT source, count(*) || CASE WHEN count(*) = 1 THEN ' block (' ELSE ' blocks (' END || array_to_string(list_sort(list(DISTINCT coalesce(CASE WHEN doc_id % 5 > 0 THEN lang END, 'txt'))), ', ') || ')' AS summary FROM documents GROUP BY source""")
def distinct_lang_summary(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(aggregates.block_summary(F.when(F.col("doc_id") % 5 > 0, F.col("lang"))).alias("summary"))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 5")
def count_thresholds(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n > 5")


@query("""
SELECT d.source, CASE WHEN bool_or(l.toxic = 1) THEN 'FAIL' WHEN count(l.doc_id) > 0 THEN 'PASS' END AS validation FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source""")
def validation_rollup(spark, sf_dir):
    """FAIL if a document of the source is toxic, PASS if labels know better, else nothing."""
    labels = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "fail").otherwise("pass").alias("outcome"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return docs.groupBy("source").agg(aggregates.validation(F.col("outcome")).alias("validation"))


@query("SELECT r_regionkey, CAST(count(CASE WHEN n_nationkey % 2 = 1 THEN 1 END) AS BIGINT) AS children FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def child_counts(spark, sf_dir):
    """Nations of a region, those with even keys left out."""
    nations = read(spark, sf_dir, "nation")
    pairs = read(spark, sf_dir, "region").join(nations, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return pairs.groupBy("r_regionkey").agg(F.count_if(F.col("n_nationkey") % 2 == 1).alias("children"))


@query("SELECT event_type, count(*) AS ops, count(DISTINCT user_id) AS files FROM events GROUP BY event_type")
def staged_counts(spark, sf_dir):
    return aggregates.staged_counts(read(spark, sf_dir, "events"), ["event_type"], "user_id")


@query("""
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS ahead, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS behind""")
def ahead_behind(spark, sf_dir):
    """Two branches whose commits merge the customers of open and of urgent orders; neither counts itself."""
    orders = read(spark, sf_dir, "orders")
    side = lambda name, which: orders.where(which).select(F.lit(name).alias("hash"), F.col("o_custkey").cast("string").alias("parent")).distinct()
    parents = side("local", F.col("o_orderstatus") == "O").unionByName(side("upstream", F.col("o_orderpriority") == "1-URGENT"))
    return graph.ahead_behind(parents, "local", "upstream").select((F.col("ahead") - 1).alias("ahead"), (F.col("behind") - 1).alias("behind"))


@query("""
WITH s AS (SELECT p_partkey, CAST(p_partkey * 37 % 4096 AS BIGINT) AS flags FROM part)
SELECT p_partkey, 'conflicted' AS bucket, 'conflicted' AS label FROM s WHERE flags & 2048 <> 0
UNION ALL SELECT p_partkey, 'staged', CASE WHEN flags & 1 <> 0 THEN 'new file' WHEN flags & 2 <> 0 THEN 'modified' WHEN flags & 4 <> 0 THEN 'deleted' WHEN flags & 8 <> 0 THEN 'renamed' ELSE 'typechange' END FROM s WHERE flags & 31 <> 0
UNION ALL SELECT p_partkey, 'modified', CASE WHEN flags & 64 <> 0 THEN 'modified' WHEN flags & 128 <> 0 THEN 'deleted' WHEN flags & 512 <> 0 THEN 'renamed' ELSE 'typechange' END FROM s WHERE flags & 704 <> 0 OR flags & 256 <> 0
UNION ALL SELECT p_partkey, 'untracked', 'untracked' FROM s WHERE flags & 32 <> 0""")
def status_buckets(spark, sf_dir):
    """Status flags as buckets; a row may be in several."""
    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 37 % 4096).alias("flags"))
    staged = {1: "new file", 2: "modified", 4: "deleted", 8: "renamed", 16: "typechange"}
    changed = {64: "modified", 128: "deleted", 512: "renamed", 256: "typechange"}
    return aggregates.classified(rows, "flags", staged, changed, 32, 2048).drop("flags")


@query("""
WITH b AS (SELECT DISTINCT 'team/' || lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN '/x' ELSE '' END AS branch FROM customer),
r AS (SELECT c_custkey, 'team/' || lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN '/x/src' WHEN c_custkey % 3 = 1 THEN '/lib' ELSE 'y' END AS request FROM customer)
SELECT DISTINCT request, (SELECT max_by(branch, length(branch)) FROM b WHERE request = branch OR starts_with(request, branch || '/')) AS branch FROM r""")
def longest_branch(spark, sf_dir):
    """The longest branch name that a path begins with."""
    c, segment = read(spark, sf_dir, "customer"), F.concat(F.lit("team/"), F.lower("c_mktsegment"))
    branches = c.select(F.concat(segment, F.when(F.col("c_custkey") % 2 == 0, "/x").otherwise("")).alias("branch")).distinct()
    tail = F.when(F.col("c_custkey") % 3 == 0, "/x/src").when(F.col("c_custkey") % 3 == 1, "/lib").otherwise("y")
    return aggregates.longest_prefix(c.select(F.concat(segment, tail).alias("request")).distinct(), branches, "request", "branch")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_registered(spark, sf_dir):
    """The last entry of each name."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return aggregates.last_writer(events.withColumn("at", F.col("event_id")), "user_id", "at").drop("at")
