"""Windows, order and dedup over orders, events, parts and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from treeloom.functions import paths, text
from treeloom.operators import aggregates, sequences
from treeloom.plans.registry import query, read
from treeloom.plans.text_queries import PATH_SQL, bounded, page_path


@query("""
SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || '-' || r END AS fs_name
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS r FROM (SELECT p_partkey, p_brand, split_part(p_name, ' ', 1) AS p_name FROM part))""")
def conflict_numbered(spark, sf_dir):
    """Names within a brand; repeats get -2, -3."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.substring_index("p_name", " ", 1).alias("p_name"))
    return sequences.numbered_names(p, ["p_brand"], "p_name", "p_partkey").select("p_partkey", "fs_name")


@query("""
SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '~' || p_type || CASE WHEN r > 1 THEN '-' || r ELSE '' END END AS fs_name
FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_name) AS n, row_number() OVER (PARTITION BY p_brand, p_name, p_type ORDER BY p_partkey) AS r
      FROM (SELECT p_partkey, p_brand, p_type, 'part' || (p_partkey % 40) AS p_name FROM part))""")
def conflict_kind_suffix(spark, sf_dir):
    """Clashing names get ~type, and repeats of a type a number."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.concat(F.lit("part"), (F.col("p_partkey") % 40).cast("string")).alias("p_name"))
    return sequences.kind_suffixed_names(p, ["p_brand"], "p_name", "p_type", "p_partkey").select("p_partkey", "fs_name")


@query("""
SELECT o_orderkey, printf('%03d_%s_%d_%s', CAST(r AS INTEGER), strftime(o_orderdate, '%Y-%m-%d'), o_orderkey, lower(trim(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g'), '-'))) AS name
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders)""")
def history_names(spark, sf_dir):
    """File names of a customer's orders, newest first."""
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey"))
    rows = read(spark, sf_dir, "orders").withColumn("nth", nth)
    slug = text.slug(F.lower("o_orderpriority"))
    return rows.select("o_orderkey", sequences.history_name(F.col("nth"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey").cast("string"), slug).alias("name"))


@query("""
SELECT conv_id, turn, role FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE m IS NULL OR turn > m""")
def rows_after_last_marker(spark, sf_dir):
    """What came after the last user turn."""
    return sequences.after_last(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "user")


@query("""
WITH i AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events),
r AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM i GROUP BY user_id, event_type, g HAVING count(*) >= 3)
SELECT user_id, event_type, n, first FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS k FROM r) WHERE k = 1""")
def longest_run(spark, sf_dir):
    """Each user's longest run of one event type, of at least three."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return sequences.longest_run(events, "user_id", "event_id", "event_type", 3)


@query("""
WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'u' ELSE 'o' END AS k FROM conversations),
i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) AS g FROM c),
b AS (SELECT conv_id, k, g, min(turn) AS first, max(turn) AS last FROM i GROUP BY ALL)
SELECT DISTINCT c.conv_id, c.turn, b.k, b.first, b.last FROM c JOIN b ON b.conv_id = c.conv_id AND c.turn BETWEEN b.first AND b.last""")
def island_containing(spark, sf_dir):
    """The run of like turns around each turn."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "u").otherwise("o").alias("k"))
    return sequences.island_around(c, "conv_id", "turn", "k", c.select("conv_id", "turn"), "turn")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type IN ('signup', 'purchase')),
w(user_id, k, stack, opener, closer, d) AS (
  SELECT user_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT, 0::BIGINT FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT w.user_id, e.k, CASE WHEN s = 1 THEN list_append(w.stack, e.event_id) WHEN len(w.stack) > 0 THEN w.stack[1:len(w.stack)-1] ELSE w.stack END,
    CASE WHEN s = -1 AND len(w.stack) > 0 THEN w.stack[len(w.stack)] END, CASE WHEN s = -1 AND len(w.stack) > 0 THEN e.event_id END, CAST(len(w.stack) AS BIGINT)
  FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT o.user_id, o.event_id, c.closer AS closed_by FROM e o LEFT JOIN w c ON c.user_id = o.user_id AND c.opener = o.event_id WHERE o.s = 1""")
def bracket_pairing(spark, sf_dir):
    """Each signup with the purchase that closes it, as brackets nest."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    kind = F.col("event_type")
    return sequences.paired(events, "user_id", "event_id", kind == "signup", kind == "purchase").select("user_id", "event_id", "closed_by")


@query("""
WITH RECURSIVE n AS (SELECT o_orderkey AS id, o_orderkey // 4 AS parent, o_orderstatus = 'O' AS counts FROM orders),
w(id, up, depth) AS (SELECT id, parent, 0::BIGINT FROM n UNION ALL SELECT w.id, n.parent, w.depth + CASE WHEN n.counts THEN 1 ELSE 0 END FROM w JOIN n ON n.id = w.up WHERE w.up > 0)
SELECT id, max(depth) AS nested FROM w GROUP BY id""")
def ancestor_depth(spark, sf_dir):
    """How many open orders are ancestors in a heap of orders (parent = key div 4)."""
    from treeloom.operators import graph

    n = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("nullif(o_orderkey div 4, 0)").alias("parent"), (F.col("o_orderstatus") == "O").cast("long").alias("counts"))
    return graph.ancestor_sum(n, "id", "parent", "counts").withColumnRenamed("total", "nested")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def recent_n(spark, sf_dir):
    return aggregates.recent(read(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 10).select("o_orderkey", "o_custkey")


PRIORITIES = ["2-HIGH", "1-URGENT", "5-LOW"]


@query("""
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(list_position(['2-HIGH', '1-URGENT', '5-LOW'], o_orderpriority), 4), o_orderkey) AS nth FROM orders""")
def priority_sort_rank(spark, sf_dir):
    """Orders of a customer by place in a list of priorities, unlisted ones last."""
    place = aggregates.priority(F.col("o_orderpriority"), PRIORITIES)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(place, "o_orderkey")).cast("long").alias("nth"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_type), 'e') ORDER BY p_name, p_partkey LIMIT 20")
def search_limit(spark, sf_dir):
    """The first 20 hits of a search that ignores case."""
    part = read(spark, sf_dir, "part")
    hits = part.where(F.contains(F.lower("p_name"), F.lit("a")) & F.contains(F.lower("p_type"), F.lit("e")))
    return aggregates.recent(hits, [F.asc("p_name"), F.asc("p_partkey")], 20).select("p_partkey", "p_name")


@query("""
WITH u AS (SELECT c_nationkey AS k, 1 AS src, c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS a, c_acctbal AS b FROM customer
 UNION ALL SELECT s_nationkey, 2, s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal END FROM supplier)
SELECT k, (list(a ORDER BY src, id) FILTER (WHERE a IS NOT NULL))[1] AS a, (list(b ORDER BY src, id) FILTER (WHERE b IS NOT NULL))[1] AS b FROM u GROUP BY k""")
def first_writer_wins(spark, sf_dir):
    """One row for each nation; each column from the first source that has it."""
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("a"), F.col("c_acctbal").alias("b"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("a"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_acctbal")).alias("b"))
    return aggregates.first_writer([c, s], "k", "id", ["a", "b"])


@query("SELECT user_id, event_type, min(event_id) AS first_seen FROM events GROUP BY ALL")
def distinct_first_seen(spark, sf_dir):
    return aggregates.first_seen(read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")


@query("SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL")
def dedup_matches(spark, sf_dir):
    return aggregates.first_seen(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"], "l_linenumber").withColumnRenamed("first_seen", "l_linenumber")


@query("""
WITH p AS (SELECT regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages), t AS (SELECT path[4:] AS tail FROM p WHERE starts_with(path, 'en/') AND length(path) > 3)
SELECT split_part(tail, '/', 1) AS segment, bool_or(NOT contains(tail, '/')) AS is_leaf FROM t GROUP BY 1""")
def next_segment(spark, sf_dir):
    """What comes next below a prefix, and whether a path ends there."""
    p = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"))
    return aggregates.next_segments(p, "path", "en/")


@query("""
SELECT p_partkey, printf('%02d-%s.diff', CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER), lower(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', '-', 'g'), '-'))) AS action FROM part WHERE p_size % 4 <> 0""")
def action_names(spark, sf_dir):
    """Numbered names of the actions that aren't disabled."""
    live = read(spark, sf_dir, "part").where("p_size % 4 <> 0")
    nth = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return live.select("p_partkey", F.format_string("%02d-%s.diff", nth, text.slug(F.lower("p_name"))).alias("action"))


@query(f"""
WITH p AS (SELECT page_id, {PATH_SQL} AS path FROM pages)
SELECT page_id, 'src/' || path || '@' AS companion, CASE WHEN ends_with(path, '.rs') AND length(path) > 3 THEN left(path, length(path) - 3) END AS stem, 'vfs/' || path AS mounted FROM p WHERE NOT ends_with(path, '/') AND path <> ''""")
def path_rewrites(spark, sf_dir):
    """Companion names, names without a suffix, and paths under another root."""
    p = read(spark, sf_dir, "pages").select("page_id", page_path().alias("path"))
    full = F.concat(F.lit("src/"), F.col("path"))
    made = p.where(~F.col("path").endswith("/") & (F.col("path") != "")).select("page_id", "path", paths.companion(F.concat(full, F.lit("@/symbols/x@"))).alias("c"))
    return made.select(
        "page_id", F.concat(F.col("c.source"), F.lit("@")).alias("companion"), paths.strip_suffix(F.col("path"), ".rs").alias("stem"),
        paths.rewritten(F.concat(F.lit("src/"), F.col("path")), "src", "vfs").alias("mounted"),
    )


@query(f"SELECT conv_id, turn, coalesce(nullif({bounded(chr(99)+'ut', 40)}, ''), 'unnamed') AS slug FROM (SELECT conv_id, turn, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \\t\\r\\x0b\\x0c')), lambda x: x <> '')[1], '') AS cut FROM conversations)")
def entry_slugs(spark, sf_dir):
    """Names of entries from their first lines."""
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.entry_slug(F.col("text")).alias("slug"))
