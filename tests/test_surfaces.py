"""Routes, providers, plugins, hooks, messages and caches that follow their rows in order, against plain Python."""

import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from treeloom.functions import paths, text, wire
from treeloom.operators import caches, edges, graph, history, hooks, routing


def column(spark, values, type_, made):
    """``made`` of each value, in their order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {type_}")
    return [r["y"] for r in df.select("i", made(F.col("x")).alias("y")).orderBy("i").collect()]


TREE = [("branches", "list"), ("branches/{name}", "one"), ("branches/{name}/files/{path..}", "file"), ("{any..}", "rest"), ("{late}", "late"), ("tags/{tag}", "tag"), ("branches/{name}/log", "log")]


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("", None), ("branches", ("list", {})), ("branches/a", ("one", {"name": "a"})), ("branches/a/files/x/y", ("file", {"name": "a", "path": "x/y"})), ("branches/a/files", None), ("tags", None),
        ("tags/v", ("tag", {"tag": "v"})), ("zz", ("rest", {"any": "zz"})), ("zz/q", ("rest", {"any": "zz/q"})), ("branches/a/log", ("log", {"name": "a"})), ("branches/a/zz", None),
    ],
)
def test_routes(spark, path, want):
    tree = routing.Route()
    for pattern, handler in TREE:
        tree.add(pattern, handler)
    got = column(spark, [path], "string", lambda x: routing.routed(tree, paths.segments(x)))[0]
    assert (None if got is None else (got["handler"], got["params"])) == want


def test_provider_order():
    of = lambda id_, needs=(), priority=0, terminal=False: routing.Provider(id_, None, None, needs, priority, terminal)
    chain = [of("fs", priority=-9, terminal=True), of("z"), of("b", ("a", "fs", "gone")), of("a"), of("late", priority=-5, needs=("b",)), of("first", priority=-1)]
    assert [p.id for p in routing.in_order(chain)] == ["first", "a", "z", "b", "late", "fs"]
    with pytest.raises(graph.CycleError):
        routing.in_order([of("a", ("b",)), of("b", ("a",))])


def test_scripts(spark):
    one, two = routing.Plugin("p", scripts={"up": bytes.upper}, commands=frozenset({"Go"}), config={"n": 1}), routing.Plugin("q", scripts={"rev": lambda b: b[::-1]})
    active = routing.activate([one, two])
    assert (sorted(active.scripts), active.commands, active.config["p"]) == (["provider.p.up", "provider.q.rev"], {"Go"}, {"n": 1})
    df = spark.createDataFrame([("provider.p.up", b"ab"), ("provider.q.rev", b"ab"), ("provider.p.no", b"ab"), ("provider.p.up", None)], "a string, b binary")
    got = [r[0] for r in df.select(routing.run_scripts(active, F.col("a"), F.col("b"))).collect()]
    assert [None if g is None else bytes(g) for g in got] == [b"AB", b"ba", None, b""]
    with pytest.raises(ValueError, match="three parts"):
        routing.activate([routing.Plugin("p", scripts={"a.b": bytes.upper})])


def test_control_requests(spark):
    lines = ['{"type":"Exec","address":"a.b.c","stdin":""}', '{"type":"Exec"}', '{"type":"Go"}', "{}", "x", '{"type":3}', '{"type":"GetNamespaceFds"}', '{"type":"Register","pid":3,"command":"x"}', '{"type":"Register","pid":"3","command":"x"}', '{"type":"ListProcesses"}', '{"type":"zz"}']
    got = column(spark, lines, "string", lambda x: routing.control_request(x, ["Go"]))
    assert [g["kind"] for g in got] == ["core", "error", "plugin", "error", "error", "error", "namespaces", "core", "error", "core", "error"]
    assert [got[i]["error"] for i in (1, 3, 10)] == ["unknown command: Exec", 'missing "type" field', "unknown command: zz"]


def test_messages(spark):
    bodies = ['{"a":"é"}', "", "Content-Length: 3\r\n\r\nabc", "𝄞\r\n"]
    raw = b"".join(b"X: y\r\nContent-Length: %d\r\n\r\n%s" % (len(b.encode()), b.encode()) for b in bodies)
    assert [[bytes(b).decode() for b in g] for g in column(spark, [raw, raw + b"Content-Length: 9\r\n\r\nabc", b"X: 1\r\n\r\nabc", b""], "binary", wire.unframed)] == [bodies, bodies, [], []]
    assert [bytes(b) for b in column(spark, bodies[:2], "string", wire.framed)] == ["Content-Length: 10\r\n\r\n{\"a\":\"é\"}".encode(), b"Content-Length: 0\r\n\r\n"]
    answers = ['{"error":{"code":-32,"message":"no"},"result":1}', '{"error":{"code":"x","message":2}}', '{"error":null}', '{"result":{"a":1}}', "{}"]
    assert [tuple(r) for r in column(spark, answers, "string", wire.response)] == [(None, -32, "no"), (None, 0, "unknown error"), (None, 0, "unknown error"), ('{"a":1}', None, None), (None, None, None)]


def test_hooks(spark):
    commands = ["cat /r/a.rs, /r/b.rs@/lines: /x/c; /r/d /rx/e", "", "  ls"]
    assert column(spark, commands, "string", lambda c: hooks.mentioned_paths(c, F.lit("/r"))) == [["a.rs", "d"], [], []]
    given = ['{"file_path":"/r/a.rs@/symbols/X@/body.rs"}', '{"file_path":"/r/b.rs"}', '{"file_path":"/x/b.rs"}', "{}"]
    assert column(spark, given, "string", lambda g: hooks.source_path(F.lit("Read"), g, F.lit("/r"))) == ["a.rs", "b.rs", None, None]
    assert column(spark, given[:1], "string", lambda g: hooks.source_path(F.lit("Bash"), g, F.lit("/r"))) == [None]
    assert column(spark, given, "string", lambda g: hooks.symbol_moved(F.lit("Edit"), g, F.lit("ENOENT: gone"))) == [True, False, False, False]
    assert column(spark, ["PreToolUse", "Stop", "Other"], "string", lambda e: hooks.due(e, F.lit("Grep"))) == [["pre-tool-use-grep-symbol"], ["stop"], []]
    assert sum(map(len, hooks.HOOKS.values())) == 11
    said = column(spark, [None, "main"], "string", lambda b: hooks.session_context(F.lit("d"), F.lit("/r"), b, F.lit("/h"), F.lit("linux"), F.lit(None).cast("string")))
    assert [s.split("\n")[2] for s in said] == ["Branch: (no repo)", "Branch: main"]


def test_names_of_processes(spark):
    assert column(spark, ["bash", "very_long_process_name", "abcdefghijklmno香", "abcdefghijklm香", "é" * 9, ""], "string", text.comm) == ["bash", "very_long_proce", "abcdefghijklmno", "abcdefghijklm", "é" * 7, ""]


@pytest.mark.parametrize("capacity", [1, 3, 50])
def test_lru(spark, capacity):
    rng = random.Random(capacity)
    rows = [(rng.randrange(3), i, rng.choice([None, *range(8)])) for i in range(300)]
    held, want = {c: OrderedDict() for c in range(3)}, {}
    for c, i, k in rows:
        want[i] = k in held[c]
        held[c].pop(k, None)
        held[c][k] = 1
        if len(held[c]) > capacity:
            held[c].popitem(last=False)
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # states must last from batch to batch
    try:
        got = {r["i"]: r["hit"] for r in caches.lru_hits(spark.createDataFrame([(c, i, None if k is None else str(k)) for c, i, k in rows], "c int, i int, k string"), "c", "i", "k", capacity).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_timed_and_bound(spark):
    reads = spark.createDataFrame([("a", t) for t in (0, 5, 9, 10, 19, 21)] + [("b", 3)], "n string, t long")
    got = lambda df: {(r["n"], r["t"]) for r in df.where("hit").collect()}
    assert got(caches.timed_hits(reads, "n", "t", 10)) == {("a", 5), ("a", 9), ("a", 19)}
    assert got(caches.timed_hits(reads, "n", "t", None)) == {("a", t) for t in (5, 9, 10, 19, 21)}
    assert got(caches.timed_hits(reads, "n", "t", 0)) == set()
    ops = [(0, "touch"), (1, "lookup"), (2, "bind"), (12, "lookup"), (14, "touch"), (24, "lookup"), (25, "lookup"), (26, "touch"), (27, "lookup"), (30, "bind"), (45, "touch"), (46, "lookup")]
    rows = caches.bound_hits(spark.createDataFrame([(1, t, k) for t, k in ops], "n int, t long, k string"), "n", "t", "k", 10).collect()
    assert {r["t"]: r["hit"] for r in rows if r["k"] == "lookup"} == {1: False, 12: True, 24: True, 25: False, 27: False, 46: True}
    assert all(r["hit"] is None for r in rows if r["k"] != "lookup")


def test_followed_empty(spark):
    assert caches.lru_hits(spark.createDataFrame([], "c int, i int, k int"), "c", "i", "k").collect() == []


def test_listings(spark):
    ops = [(1, "readdir", "d", None), (2, "readdir", "d", None), (3, "rename", "e", "d"), (4, "readdir", "d", None), (5, "change", "d/x", None), (6, "readdir", "d", None), (7, "lookup", "d", None), (8, "readdir", "d", None), (9, "create", "d", None), (10, "readdir", "d", None)]
    got = caches.listing_hits(spark.createDataFrame(ops, "at long, kind string, path string, target string"), "at", "kind", "path", "target")
    assert {r["at"]: r["hit"] for r in got.collect()} == {1: False, 2: True, 4: False, 6: False, 8: True, 10: False}


def test_documents(spark):
    ops = [(1, "change", True), (2, "access", False), (3, "access", True), (4, "access", True), (5, "change", True), (6, "change", True), (7, "change", False), (8, "change", True), (9, "access", True), (10, "close", True), (11, "close", True)]
    rows = caches.documents_open(spark.createDataFrame([("p", *o) for o in ops], "path string, at long, kind string, readable boolean"), "path", "at", "kind", "readable").collect()
    assert {r["at"]: (r["version"], r["sent"]) for r in rows} == {
        1: (None, None), 2: (None, None), 3: (0, "open"), 4: (0, None), 5: (1, "change"), 6: (2, "change"), 7: (None, "close"), 8: (None, None), 9: (0, "open"), 10: (None, "close"), 11: (None, None),
    }
    assert all(r["open"] == (r["version"] is not None) for r in rows)


def test_flushes(spark):
    ops = [(1, "write"), (2, "clear"), (3, "snapshot"), (4, "clear"), (5, "write"), (6, "snapshot"), (7, "write"), (8, "clear"), (9, "snapshot"), (10, "clear")]
    got = caches.flushes(spark.createDataFrame([(1, *o) for o in ops], "h int, at long, kind string"), "h", "at", "kind")
    assert {r["at"]: (r["writes"], r["cleared"]) for r in got.collect()} == {2: (1, False), 4: (0, True), 8: (1, False), 10: (0, True)}


def test_branches(spark):
    branches = spark.createDataFrame([("main", "c3", True), ("feat/old", "c2", False), ("feat/new", "c9", False)], "name string, target string, is_head boolean")
    reach = spark.createDataFrame([("c3", h) for h in ("c3", "c2", "c1")], "start string, hash string")
    asked = spark.createDataFrame([("feat/old", "new"), ("feat/old", "x"), ("feat/old", None), ("feat/new", None), ("main", None), ("no", "y")], "name string, leaf string")
    got = {(r["name"], r["leaf"]): (r["new_name"], r["outcome"]) for r in history.branch_changes(branches, reach, asked).collect()}
    assert got == {
        ("feat/old", "new"): ("feat/new", "already-exists"), ("feat/old", "x"): ("feat/x", "done"), ("feat/old", None): (None, "done"),
        ("feat/new", None): (None, "unmerged"), ("main", None): (None, "unmerged"), ("no", "y"): ("y", "not-found"),
    }
    index, renames = spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("a", "c"), ("z", "b")], "path string, new_path string")
    assert sorted(r["path"] for r in history.index_renamed(index, renames).collect()) == ["b", "c"]


def test_blame_of_commits_that_begin_alike(spark):
    commits = spark.createDataFrame([(h, "A", 0, m, 0) for h, m in (("abcdefg1", "one"), ("abcdefg2", "two"))], "hash string, author string, epoch_secs long, message string, walk_idx long")
    rows = spark.createDataFrame([("p", 1, 2, "abcdefg1"), ("p", 3, 3, "abcdefg2")], "path string, start_line long, end_line long, hash string")
    assert sorted((r["start_line"], r["hash"], r["message"]) for r in history.blame(rows, commits).collect()) == [(1, "abcdefg", "one"), (3, "abcdefg", "two")]


def test_links_of_repeated_rows(spark):
    rows = spark.createDataFrame([("r/a", 5, "f"), ("r/a", 5, "f"), ("r/a", 5, "g"), ("x/a", 5, "f")], "file string, line long, name string")
    symbols = spark.createDataFrame([("r/a", 1, 9, 0, 0, "S")], "file string, start long, stop long, depth int, ord int, fs_name string")
    assert sorted((r["link"], r["target"]) for r in edges.linked(rows, symbols, "r/").collect()) == [("f-a:5", "r/a@/symbols/S@"), ("g-a:5", "r/a@/symbols/S@")]
