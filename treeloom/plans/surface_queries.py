"""Routes, providers, hooks, messages and caches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeloom.functions import paths, wire
from treeloom.operators import caches, hooks, routing
from treeloom.plans.registry import query, read


@query("""
WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> '') AS s FROM pages)
SELECT page_id, CASE WHEN len(s) = 0 THEN 'root' WHEN s[1] = 'en' THEN CASE len(s) WHEN 1 THEN 'english' WHEN 2 THEN 'english page' END WHEN s[1] = 'fr' THEN CASE len(s) WHEN 1 THEN 'french' END WHEN len(s) = 1 THEN 'language' ELSE 'page' END AS handler FROM p""")
def route_handlers(spark, sf_dir):
    """Which handler of a route tree a page's path goes to; null where it is passed on."""
    tree = routing.Route().add("", "root").add("en", "english").add("en/{page}", "english page").add("fr", "french").add("{lang}", "language").add("{lang}/{page..}", "page").add("{all..}", "never reached")
    segments = paths.segments(F.regexp_replace("url", "^[a-z]+://[^/]*", ""))
    return read(spark, sf_dir, "pages").select("page_id", routing.routed(tree, segments)["handler"].alias("handler"))


@query("""
WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> '') AS s FROM pages)
SELECT page_id, s[1] AS first, CASE WHEN len(s) > 1 THEN array_to_string(s[2:], '/') END AS rest FROM p WHERE len(s) > 0""")
def route_params(spark, sf_dir):
    """What a capture and a rest take of a page's path."""
    tree = routing.Route().add("{first}", "one").add("{first}/{rest..}", "more")
    segments = paths.segments(F.regexp_replace("url", "^[a-z]+://[^/]*", ""))
    found = read(spark, sf_dir, "pages").select("page_id", routing.routed(tree, segments).alias("r")).where("r is not null")
    return found.select("page_id", F.col("r.params")["first"].alias("first"), F.col("r.params")["rest"].alias("rest"))


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN 'guard' WHEN event_id % 3 = 0 THEN 'cache' WHEN event_type = 'click' THEN 'links' ELSE 'files' END AS provider,
  CASE WHEN event_type = 'error' THEN 'denied' WHEN event_id % 3 = 0 THEN 'held' WHEN event_type = 'click' THEN 'link' ELSE event_type END AS answer FROM events""")
def provider_chain(spark, sf_dir):
    """Which provider answers a request: by depth, priority and id, the terminal one last."""
    chain = [
        routing.Provider("files", F.lit(True), F.col("event_type"), terminal=True, priority=-9),
        routing.Provider("links", F.col("event_type") == "click", F.lit("link"), needs=("cache", "unknown")),
        routing.Provider("cache", F.col("event_id") % 3 == 0, F.lit("held")),
        routing.Provider("guard", F.col("event_type") == "error", F.lit("denied"), priority=-1),
    ]
    return read(spark, sf_dir, "events").select("event_id", routing.answered(chain).alias("r")).select("event_id", "r.*")


@query("""
WITH a AS (SELECT part.p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'provider.' || p_size || '.run' WHEN 1 THEN 'provider..run' WHEN 2 THEN 'a.b' ELSE 'a.b.c.d' END AS address FROM part)
SELECT p_partkey, address, p_partkey % 4 = 0 AS valid FROM a""")
def script_addresses(spark, sf_dir):
    """Whether an address is three parts that aren't empty."""
    k = F.col("p_partkey") % 4
    address = F.when(k == 0, F.concat(F.lit("provider."), F.col("p_size").cast("string"), F.lit(".run"))).when(k == 1, "provider..run").when(k == 2, "a.b").otherwise("a.b.c.d")
    return read(spark, sf_dir, "part").select("p_partkey", address.alias("address")).select("*", routing.script_address(F.col("address")).alias("valid"))


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'core' WHEN 1 THEN 'plugin' WHEN 5 THEN 'namespaces' ELSE 'error' END AS kind,
  CASE event_id % 6 WHEN 2 THEN 'unknown command: ' || event_type WHEN 3 THEN 'missing "type" field' WHEN 4 THEN 'not JSON' END AS error FROM events""")
def control_requests(spark, sf_dir):
    """What kind of request a line to the control server is."""
    k, type_ = F.col("event_id") % 6, lambda t: F.concat(F.lit('{"type":"'), t, F.lit('","pid":'), F.col("user_id").cast("string"), F.lit("}"))
    line = F.when(k == 0, type_(F.lit("Unregister"))).when(k == 1, type_(F.lit("SetVisibility"))).when(k == 2, type_(F.col("event_type"))).when(k == 3, F.lit('{"pid":1}')).when(k == 4, F.lit("{no")).otherwise(type_(F.lit("GetNamespaceFds")))
    rows = read(spark, sf_dir, "events").select("event_id", routing.control_request(line, ["SetVisibility"]).alias("r"))
    return rows.select("event_id", "r.kind", "r.error")


@query("""
SELECT event_id, 'Content-Length: ' || strlen(props) || chr(13) || chr(10) || chr(13) || chr(10) || props AS frame, [props, event_type] AS bodies FROM events""")
def framed_messages(spark, sf_dir):
    """Messages with their headers, and the bodies of two read back from one stream."""
    frame, second = wire.framed(F.col("props")), wire.framed(F.col("event_type"))
    return read(spark, sf_dir, "events").select("event_id", F.decode(frame, "utf-8").alias("frame"), wire.unframed(F.concat(frame, second)).cast("array<string>").alias("bodies"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS VARCHAR) END AS result, CASE o_orderkey % 4 WHEN 1 THEN -o_custkey WHEN 2 THEN 0 END AS code,
  CASE o_orderkey % 4 WHEN 1 THEN o_orderstatus WHEN 2 THEN 'unknown error' END AS error FROM orders""")
def response_results(spark, sf_dir):
    """Results and errors of a server's answers."""
    k, n = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    message = F.when(k == 0, F.concat(F.lit('{"id":1,"result":'), n, F.lit("}"))).when(k == 1, F.concat(F.lit('{"error":{"code":-'), n, F.lit(',"message":"'), F.col("o_orderstatus"), F.lit('"}}'))).when(k == 2, F.lit('{"error":{}}'))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", message.alias("message"))
    return rows.select("o_orderkey", wire.response(F.col("message")).alias("r")).select("o_orderkey", "r.*")


@query("""
WITH c AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '/x/' WHEN p_size % 3 = 1 THEN '/root/' ELSE '/root/a@/' END || p_brand AS place FROM part)
SELECT p_partkey, CASE WHEN place LIKE '/root/%' AND NOT contains(place, '@/') THEN [substr(place, 7), 'b/c'] ELSE ['b/c'] END AS paths FROM c""")
def command_paths(spark, sf_dir):
    """Paths below a root that commands name."""
    k = F.col("p_size") % 3
    place = F.concat(F.when(k == 0, "/x/").when(k == 1, "/root/").otherwise("/root/a@/"), F.replace(F.col("p_brand"), F.lit(" "), F.lit("_")))
    return read(spark, sf_dir, "part").select("p_partkey", hooks.mentioned_paths(F.concat(F.lit("cat "), place, F.lit(", /root/b/c;  /rooted/d")), F.lit("/root")).alias("paths"))


@query("""
SELECT event_id, CASE event_type WHEN 'click' THEN ['pre-tool-use-file-access'] WHEN 'view' THEN ['post-tool-use-vfs-reread', 'post-tool-use-diagnostics'] WHEN 'error' THEN ['post-tool-use-failure'] WHEN 'signup' THEN ['session-start'] ELSE [] END AS hooks FROM events""")
def due_hooks(spark, sf_dir):
    """Which hooks an event of a session runs, with one of them disabled."""
    t = F.col("event_type")
    event = F.when(t == "click", "PreToolUse").when(t == "view", "PostToolUse").when(t == "error", "PostToolUseFailure").when(t == "signup", "SessionStart").otherwise("Other")
    return read(spark, sf_dir, "events").select("event_id", hooks.due(event, F.lit("Edit"), ("post-tool-use-ssot",)).alias("hooks"))


@query("""
WITH e AS (SELECT user_id, event_id, floor(value) % 7 AS k, lag(event_id) OVER (PARTITION BY user_id, floor(value) % 7 ORDER BY event_id) AS p FROM events)
SELECT a.event_id, coalesce(a.p IS NOT NULL AND (SELECT count(DISTINCT coalesce(b.k, -1)) FROM e b WHERE b.user_id = a.user_id AND b.event_id > a.p AND b.event_id < a.event_id) < 3, false) AS hit FROM e a""")
def lru_hits(spark, sf_dir):
    """Whether a user's cache of three keys holds the next."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", F.coalesce((F.floor("value") % 7).cast("long"), F.lit(-1)).alias("k"))
    return caches.lru_hits(events, "user_id", "event_id", "k", 3).select("event_id", "hit")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, k, event_id, t AS since, false AS hit FROM e WHERE k = 1
 UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN e.t - w.since < 36000000000 THEN w.since ELSE e.t END, e.t - w.since < 36000000000 FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT event_id, hit FROM w""")
def timed_hits(spark, sf_dir):
    """Whether content is held for ten hours from when it was last fetched."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return caches.timed_hits(events, "user_id", "at", 36_000_000_000).select("event_id", "hit")


@query("""
WITH o AS (SELECT event_id, 'd' || user_id AS path, 'd' || (user_id // 2) AS target, CASE event_type WHEN 'view' THEN 'readdir' WHEN 'click' THEN 'readdir' WHEN 'signup' THEN 'rename' ELSE 'create' END AS kind FROM events),
x AS (SELECT event_id, path, kind FROM o UNION ALL SELECT event_id, target, kind FROM o WHERE kind = 'rename' AND target <> path),
l AS (SELECT *, lag(kind) OVER (PARTITION BY path ORDER BY event_id) AS last FROM x)
SELECT event_id AS at, path, coalesce(last = 'readdir', false) AS hit FROM l WHERE kind = 'readdir'""")
def listing_hits(spark, sf_dir):
    """Whether a folder's listing is held when it is read."""
    t = F.col("event_type")
    kind = F.when(t.isin("view", "click"), "readdir").when(t == "signup", "rename").otherwise("create")
    place = lambda c: F.concat(F.lit("d"), c.cast("string"))
    ops = read(spark, sf_dir, "events").select("event_id", kind.alias("kind"), place(F.col("user_id")).alias("path"), place(F.expr("user_id div 2")).alias("target"))
    return caches.listing_hits(ops, "event_id", "kind", "path", "target")


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'close' WHEN 'view' THEN 'access' WHEN 'click' THEN 'access' ELSE 'change' END AS kind, event_id % 5 <> 0 AS readable, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
w AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BIGINT AS v, NULL::VARCHAR AS sent FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT o.user_id, o.k, o.event_id,
  CASE WHEN o.kind = 'close' THEN NULL WHEN o.kind = 'access' THEN CASE WHEN w.v IS NULL AND o.readable THEN 0 ELSE w.v END ELSE CASE WHEN o.readable THEN w.v + 1 END END,
  CASE WHEN o.kind = 'access' THEN CASE WHEN w.v IS NULL AND o.readable THEN 'open' END WHEN w.v IS NULL THEN NULL WHEN o.kind = 'close' OR NOT o.readable THEN 'close' ELSE 'change' END
  FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT event_id, v IS NOT NULL AS open, v AS version, sent FROM w WHERE event_id IS NOT NULL""")
def documents_open(spark, sf_dir):
    """Which version of a document a server knows after each operation."""
    t = F.col("event_type")
    kind = F.when(t == "purchase", "close").when(t.isin("view", "click"), "access").otherwise("change")
    ops = read(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind"), (F.col("event_id") % 5 != 0).alias("readable"))
    return caches.documents_open(ops, "user_id", "event_id", "kind", "readable").select("event_id", "open", "version", "sent")


@query("""
WITH o AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'clear' WHEN 'view' THEN 'snapshot' ELSE 'write' END AS kind FROM events),
s AS (SELECT *, max(CASE WHEN kind = 'snapshot' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS snap FROM o)
SELECT a.user_id, a.event_id, (SELECT count(*) FROM s b WHERE b.user_id = a.user_id AND b.kind = 'write' AND b.event_id < a.event_id AND b.event_id > coalesce(a.snap, -1)) AS writes,
 a.snap IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s b WHERE b.user_id = a.user_id AND b.kind = 'write' AND b.event_id < a.event_id AND b.event_id > a.snap) AS cleared FROM s a WHERE a.kind = 'clear'""")
def buffer_flushes(spark, sf_dir):
    """Whether a flush leaves a buffer clean."""
    t = F.col("event_type")
    kind = F.when(t == "purchase", "clear").when(t == "view", "snapshot").otherwise("write")
    ops = read(spark, sf_dir, "events").select("user_id", "event_id", kind.alias("kind"))
    return caches.flushes(ops, "user_id", "event_id", "kind")
