"""Edits, tagged comments, and streams against their batch form."""

import random

import pytest
from pyspark.sql import functions as F

from treeloom.operators import caches, edits, todos
from treeloom.streaming import jobs


def test_edit_kinds(spark):
    body = "fn a() {\n    x();\n}\n\n\nfn b() {}\n"
    ops = [("replace", 0, 19, "fn c() {}"), ("delete", 0, 19, None), ("insert_before", 4, 19, "// hi"), ("insert_after", 0, 19, "fn d() {}"), ("append", 0, 19, "y();")]
    rows = spark.createDataFrame([(k, body, kind, a, b, new, 1) for k, (kind, a, b, new) in enumerate(ops)], "id long, body string, kind string, a int, b int, new string, seq int")
    done = edits.applied(edits.resolve(rows, F.col("body"), F.col("a"), F.col("b"), F.lit(None).cast("long"), F.col("kind"), F.col("new")), ["id"], "body")
    got = {r["id"]: r["result"] for r in done.collect()}
    assert got[0] == "fn c() {}\n\n\nfn b() {}\n"
    assert got[1] == "fn b() {}\n"
    assert got[2] == "// hi\n" + body
    assert got[3] == "fn a() {\n    x();\n}\nfn d() {}\n\n\nfn b() {}\n"
    assert got[4] == "fn a() {\n    x();\n\ny();}\n\n\nfn b() {}\n"


def test_many_edits_and_conflicts(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(30):
        body = "".join(rng.choice("abc\né") for _ in range(80))
        cuts = sorted(rng.sample(range(81), 6))
        spans = [(cuts[0], cuts[1]), (cuts[2], cuts[2]), (cuts[3], cuts[4])]
        out, at = "", 0
        for i, (a, b) in enumerate(spans):
            rows.append((k, body, a, b, f"<{i}>", i))
            out, at = out + body[at:a] + f"<{i}>", b
        want[k] = out + body[at:]
    df = spark.createDataFrame(rows, "id long, body string, edit_start long, edit_end long, edit_text string, seq int")
    assert {r["id"]: r["result"] for r in edits.applied(df, ["id"], "body").collect()} == want
    clash = spark.createDataFrame([(1, 0, 5, 0), (1, 4, 6, 1), (2, 3, 3, 0), (2, 3, 3, 1), (2, 3, 9, 2), (3, 0, 9, 0), (3, 1, 2, 1), (3, 3, 4, 2)], "id long, edit_start long, edit_end long, seq int")
    assert {(r["id"], r["prev_seq"], r["seq"]) for r in edits.conflicts(clash, ["id"]).collect()} == {(1, 0, 1), (3, 0, 1)}


def test_splices(spark):
    df = spark.createDataFrame([("a\nb\nc\n",)], "t string")
    assert df.select(edits.splice_lines(F.col("t"), 2, 2, F.lit("x\ny")).alias("r")).first()["r"] == "a\nx\ny\nc\n"
    assert df.select(edits.spliced(F.col("t"), F.lit(0), F.lit(99), F.lit("x")).alias("r")).first()["r"] is None
    assert df.select(edits.spliced(F.col("t"), F.lit(5), F.lit(6), F.lit("")).alias("r")).first()["r"] == "a\nb\nc\n"
    v = spark.createDataFrame([(False, True, False), (True, True, False), (True, False, False), (True, True, True)], "c boolean, b boolean, a boolean")
    assert [r["v"] for r in v.select(edits.splice_verdict(F.col("c"), F.col("b"), F.col("a")).alias("v")).collect()] == ["unchanged", "rejected", "written", "written"]
    results = spark.createDataFrame([(1, "pass"), (1, "fail"), (2, "pass"), (2, None)], "g int, validation string")
    assert {r["g"] for r in edits.unless_any_fails(results, ["g"]).collect()} == {2}


def test_layers(spark):
    base = spark.createDataFrame([(1, "a", ["x"], {"k": 1, "m": 1}), (2, "b", ["y"], None)], "id long, s string, l array<string>, m map<string,int>")
    over = spark.createDataFrame([(1, None, ["z"], {"k": 2}), (3, "c", None, {"q": 3})], "id long, s string, l array<string>, m map<string,int>")
    got = {r["id"]: (r["s"], r["l"], r["m"]) for r in edits.layered([base, over], "id", ["s"], ["l"], ["m"]).collect()}
    assert got == {1: ("a", ["x", "z"], {"k": 2, "m": 1}), 2: ("b", ["y"], None), 3: ("c", [], {"q": 3})}


SOURCE = """fn a() {} // TODO: inline one
// FIXME(me): first line
// goes on
fn b() {}
let s = "TODO: not a comment";
# todo: lower case
/* HACK: block */
// TODO - no colon
"""


def test_todos(spark):
    df = spark.createDataFrame([("a.rs", SOURCE), ("b.rs", "nothing here")], "path string, text string")
    got = [(r["line_no"], r["tag"], r["text"], r["entry"]) for r in todos.entries(df, "path", "text").orderBy("line_no").collect()]
    assert got == [
        (1, "TODO", "inline one", "inline-one"), (2, "FIXME", "first line\ngoes on", "first-line"), (6, "TODO", "lower case", "lower-case"), (7, "HACK", "block */", "block"),
    ]
    index = {r["tag"]: r["n"] for r in todos.index(spark, todos.entries(df, "path", "text")).collect()}
    assert index == {"FIXME": 1, "TODO": 2, "HACK": 1, "XXX": 0, "SAFETY": 0, "NOTE": 0}
    order = [(r["line_no"]) for r in todos.overview(todos.entries(df, "path", "text"), "path").collect()]
    assert order == [2, 1, 6, 7]


def streamed(spark, tmp_path, job, batches, schema, mode):
    """What a job gives for batches that arrive one after another."""
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        for part in (tmp_path / f"b{i}").glob("*.parquet"):
            part.rename(source / f"{i:03d}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    name = f"out_{tmp_path.name.replace('-', '_')}"
    q = job(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


BASE = 1_700_000_000_000_000


def stamp(us):
    from datetime import datetime, timedelta, timezone

    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


def test_debounce_stream(spark, tmp_path):
    rng, at, events = random.Random(8), BASE, []
    for _ in range(120):
        at += rng.choice([1_000, 20_000, 49_000, 60_000, 300_000])
        events.append((rng.choice("ab"), at, rng.choice(["p", "q", "r"])))
    batches = [[(k, stamp(t), i) for k, t, i in events[n : n + 20]] for n in range(0, 120, 20)]
    batches += [[("z", stamp(at + 10_000_000), "end")], [("z", stamp(at + 20_000_000), "end")]]
    got = streamed(spark, tmp_path, jobs.debounced, batches, "key string, ts timestamp, item string", "append")
    want = caches.debounced(spark.createDataFrame(events, "key string, at long, item string"), "key", "at", "item").collect()
    assert sorted((r["key"], r["batch_start"], tuple(r["items"])) for r in got if r["key"] != "z") == sorted((r["key"], r["batch_start"], tuple(r["items"])) for r in want)


def test_echo_stream(spark, tmp_path):
    rng, at, events = random.Random(4), BASE, []
    for _ in range(80):
        at += rng.choice([500_000, 1_900_000, 2_100_000])
        events.append((rng.choice("ab"), at, rng.random() < 0.4))
    batches = [[(k, stamp(t), w) for k, t, w in events[n : n + 16]] for n in range(0, 80, 16)]
    got = streamed(spark, tmp_path, jobs.without_echoes, batches, "key string, ts timestamp, is_write boolean", "append")
    want = caches.without_echoes(spark.createDataFrame(events, "key string, at long, w boolean"), "key", "at", F.col("w"), "at").collect()
    assert sorted((r["key"], r["at"]) for r in got) == sorted((r["key"], r["at"]) for r in want)


def test_diagnostics_stream(spark, tmp_path):
    events = [("a", 1, "publish", "x"), ("a", 3, "mark", None), ("b", 2, "mark", None), ("a", 5, "publish", "y"), ("c", 1, "publish", "z"), ("c", 9, "mark", None)]
    batches = [[(k, stamp(BASE + t), kind, v) for k, t, kind, v in events[:3]], [(k, stamp(BASE + t), kind, v) for k, t, kind, v in events[3:]]]
    got = streamed(spark, tmp_path, jobs.diagnostics, batches, "key string, ts timestamp, kind string, value string", "update")
    last = {r["key"]: (r["value"], r["dirty"]) for r in got}
    df = spark.createDataFrame(events, "key string, at long, kind string, value string")
    want = {r["key"]: (r["value"], r["dirty"]) for r in caches.latest(df.where("kind = 'publish'"), df.where("kind = 'mark'"), "key", "at", "value").collect()}
    assert last == want == {"a": ("y", False), "b": (None, True), "c": ("z", True)}


def test_indexing_stream(spark, tmp_path):
    s = 1_000_000
    events = [("a", 0, "t", True), ("a", 2 * s, "t", False), ("a", 2 * s + 100, "u", True), ("a", 4 * s, "u", False), ("a", 4 * s + 10, "gone", False), ("b", 0, "t", True), ("b", 9 * s, "v", True)]
    batches = [[(k, stamp(BASE + t), n, b) for k, t, n, b in events[:4]], [(k, stamp(BASE + t), n, b) for k, t, n, b in events[4:]], [("z", stamp(BASE + 60 * s), "t", True)], [("z", stamp(BASE + 90 * s), "t", False)]]
    got = streamed(spark, tmp_path, lambda d: jobs.indexing(d, s), batches, "key string, ts timestamp, token string, begins boolean", "append")
    assert {(r["key"], r["ready_at"]) for r in got if r["key"] != "z"} == {("a", BASE + 5 * s)}
    df = spark.createDataFrame([(k, BASE + t, n, b) for k, t, n, b in events] + [("a", BASE + 60 * s, "end", True)], "key string, at long, token string, b boolean")
    ready = {r["key"]: r["ready_at"] for r in caches.ready_times(df, "key", "at", "token", F.col("b"), s).collect()}
    assert ready == {"a": BASE + 5 * s, "b": None}
    states = caches.indexing_states([(t, n, b) for k, t, n, b in events if k == "a"], s, 120 * s)
    assert states[-1][1] == "quiescent"


def test_indexing_is_forced_after_its_timeout(spark, tmp_path):
    s = 1_000_000
    events = [("a", 0, "t", True), ("a", 4 * s, "u", True), ("a", 12 * s, "u", False), ("b", s, "t", True), ("b", 2 * s, "t", False), ("c", 0, "t", True)]
    row = lambda k, t, n, b: (k, stamp(BASE + t), n, b)
    batches = [[row(*e) for e in events], [row("z", 60 * s, "t", True)], [row("z", 61 * s, "t", True)]]
    got = streamed(spark, tmp_path, lambda d: jobs.indexing(d, s, 10 * s), batches, "key string, ts timestamp, token string, begins boolean", "append")
    assert sorted((r["key"], r["ready_at"] - BASE) for r in got if r["key"] != "z") == [("a", 10 * s), ("b", 3 * s), ("c", 10 * s)]
    for key, at in (("a", 10 * s), ("b", 3 * s)):
        states = caches.indexing_states([(t, n, b) for k, t, n, b in [*events, (key, 30 * s, "end", True)] if k == key], s, 10 * s)
        assert (at, "ready") in states


def test_generation_stream_and_propagation(spark, tmp_path):
    batches = [[("src/a.rs",), ("src/b.rs",)], [("src/a.rs",), ("top",)]]
    got = streamed(spark, tmp_path, jobs.generations, batches, "path string", "complete")
    now = {r["path"]: r["generation"] for r in got}
    assert now == {"src/a.rs": 2, "src/b.rs": 1, "src": 3, "top": 1, "": 1}
    entries = spark.createDataFrame([("src/a.rs", 2), ("src/b.rs", 0), ("new", 0)], "path string, g long")
    current = spark.createDataFrame(list(now.items()), "path string, generation long")
    assert {r["path"] for r in caches.valid(entries, current, "path", "g").collect()} == {"src/a.rs", "new"}
    seen = []
    stream = spark.readStream.schema("path string").parquet(str(tmp_path / "in"))
    q = jobs.propagate(stream, [lambda d: d, lambda d: d.select(F.concat("path", F.lit("@")).alias("path"))], lambda d, e: seen.extend(r["path"] for r in d.collect()), str(tmp_path / "cp2"))
    q.processAllAvailable()
    q.stop()
    assert set(seen) == {p + s for p in ("src/a.rs", "src/b.rs", "top") for s in ("", "@")}


@pytest.mark.parametrize(("kind", "want"), [("create", True), ("metadata", False), ("modify", True), ("access", False)])
def test_relevant(spark, kind, want):
    assert spark.createDataFrame([(kind,)], "kind string").select(jobs.relevant().alias("r")).first()["r"] is want
