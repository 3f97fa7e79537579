"""Operators on small inputs against plain Python: naming, places in spans, edits, graphs, parsing once."""

import random

import pytest

from treeloom.analysis import rules
from treeloom.operators import caches, edges, edits, graph, intervals, policies, sequences
from treeloom.parse import tables
from treeloom.sources import files


def free(names):
    taken, out = set(), []
    for n in names:
        got, k = n, 2
        while got in taken:
            got, k = f"{n}-{k}", k + 1
        taken.add(got)
        out.append(got)
    return out


@pytest.mark.parametrize("names", [["a", "a", "a-2"], ["a-2", "a", "a"], ["a", "a", "a", "a-2", "a-2", "b", "a-2-2", "a-2"], ["claude", "claude", "x"], []])
def test_free_names(spark, names):
    df = spark.createDataFrame(list(enumerate(names)), "o long, n string")
    got = {r["o"]: r["free"] for r in sequences.free_names(df, "n", "o").collect()}
    assert [got[i] for i in range(len(names))] == free(names)
    assert len(set(got.values())) == len(names)


def test_free_names_of_many(spark):
    rng = random.Random(1)
    names = [f"{rng.choice('ab')}{rng.choice(['', '-2', '-3', '-2-2'])}" for _ in range(200)] + [None]
    df = spark.createDataFrame(list(enumerate(names)), "o long, n string")
    got = {r["o"]: r["free"] for r in sequences.free_names(df, "n", "o").collect()}
    assert [got[i] for i in range(201)] == [*free(names[:-1]), None]


def spans_and_points(seed, n=60):
    rng = random.Random(seed)
    spans = []
    for i in range(n):
        a = rng.randrange(0, 900)
        spans.append((f"f{i % 3}", a, a + rng.randint(1, 400), rng.randrange(4), i, f"s{i}"))
    points = [(f"f{rng.randrange(4)}", rng.randrange(-20, 1400)) for _ in range(150)]
    return spans, points + points[:20]


@pytest.mark.parametrize("seed", range(3))
def test_deepest_keeps_repeated_points(spark, seed):
    spans, points = spans_and_points(seed)
    want = []
    for f, p in points:
        around = [(-d, o, n) for g, a, b, d, o, n in spans if g == f and a <= p < b]
        if around:
            want.append((f, p, min(around)[2]))
    s = spark.createDataFrame(spans, "file string, a long, b long, depth long, ord long, name string")
    p = spark.createDataFrame(points, "file string, at long")
    got = intervals.deepest(p, s, "file", "at", "a", "b", "depth", "ord").select("file", "at", "name").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_nearest_keeps_repeated_points(spark, seed):
    spans, points = spans_and_points(seed, 12)
    want = []
    for f, p in points:
        every = [((a - p if p < a else p - b + 1 if p >= b else 0), p < a, o, n) for g, a, b, _, o, n in spans if g == f]
        if every:
            want.append((f, p, min(every)[3]))
    s = spark.createDataFrame(spans, "file string, a long, b long, depth long, ord long, name string")
    p = spark.createDataFrame(points, "file string, at long")
    got = intervals.nearest(p, s, "file", "at", "a", "b", "name", "ord").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_island_around(spark):
    rows = [("g", i, v) for i, v in enumerate("aabbbacc")] + [("h", 0, "z")]
    probes = [("g", 3), ("g", 3), ("g", 0), ("g", 9), ("h", 0), ("k", 1)]
    df = spark.createDataFrame(rows, "grp string, ord long, v string")
    got = sequences.island_around(df, "grp", "ord", "v", spark.createDataFrame(probes, "grp string, at long"), "at")
    assert sorted(map(tuple, got.collect())) == [("g", 0, "a", 0, 1), ("g", 3, "b", 2, 4), ("g", 3, "b", 2, 4), ("h", 0, "z", 0, 0)]


def test_changed_range(spark):
    scopes = [("p", 0, 500, "all"), ("p", 10, 30, "inner"), ("p", 12, 14, "short"), ("p", 11, 20, None)]
    e = spark.createDataFrame([("p", 12, 13), ("p", 300, 310), ("q", 1, 2)], "path string, row_start long, row_end long")
    got = policies.changed_range(e, spark.createDataFrame(scopes, "path string, row_start long, row_end long, name string"))
    assert sorted(map(tuple, got.collect())) == [("p", 1, 502), ("p", 11, 32), ("q", 2, 4)]


def test_overlapping_edits_are_refused(spark):
    rows = [(1, "abcdef", 0, 3, "X", 1), (1, "abcdef", 2, 4, "Y", 2), (2, "abcdef", 0, 2, "X", 1), (2, "abcdef", 2, 2, "-", 2), (2, "abcdef", 2, 4, "Y", 3), (3, "abc", 0, 3, "", 1)]
    df = spark.createDataFrame(rows, "doc long, body string, edit_start long, edit_end long, edit_text string, seq long")
    got = {r["doc"]: r["result"] for r in edits.applied(df, ["doc"], "body").collect()}
    assert got == {1: None, 2: "X-Yef", 3: ""}
    assert [(r["doc"], r["seq"], r["prev_seq"]) for r in edits.conflicts(df, ["doc"]).collect()] == [(1, 2, 1)]


def test_reachable_in_a_long_history(spark):
    parents = [(i, i - 1) for i in range(1, 80)] + [(100, 60), (100, 101), (101, 102)]
    edges = spark.createDataFrame(parents, "hash long, parent long")
    got = graph.reachable(edges, spark.createDataFrame([(79,), (100,), (500,)], "start long")).collect()
    want = {(79, i) for i in range(80)} | {(100, i) for i in [*range(61), 100, 101, 102]} | {(500, 500)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_ancestor_sum_of_any_depth(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, 1) for i in range(100)], "id long, up long, v long")
    got = {r["id"]: r["total"] for r in graph.ancestor_sum(nodes, "id", "up", "v").collect()}
    assert got == {i: i for i in range(100)}


def test_servers_by_root_marker_and_override(spark):
    servers = spark.createDataFrame(
        [("deno", 0, "ts", ["ts"], ["deno.json"], True), ("tsserver", 1, "ts", ["ts"], ["package.json", "tsconfig.json"], True), ("ruff", 2, "py", ["py"], [], True), ("pyright", 3, "py", ["py"], None, True), ("off", 4, "py", ["py"], [], False)],
        "server string, ord int, language string, exts array<string>, markers array<string>, enabled boolean",
    )
    parsers = spark.createDataFrame([("ts",), ("py",)], "ext string")
    here = edges.applicable(servers, spark.createDataFrame([("package.json",), ("src",)], "name string"))
    assert sorted(r["server"] for r in here.collect()) == ["off", "pyright", "ruff", "tsserver"]
    found = lambda **kw: {r["ext"]: r["server"] for r in edges.server_index(here, parsers, **kw).collect()}
    assert found() == {"ts": "tsserver", "py": "ruff"}
    wanted = spark.createDataFrame([("py", "pyright"), ("ts", "off")], "ext string, server string")
    assert found(overrides=wanted) == {"ts": "tsserver", "py": "pyright"}


def test_pulled_before_published(spark):
    pulled = spark.createDataFrame([("a", "full", "new"), ("b", "unchanged", "old"), ("c", "full", None)], "file string, kind string, rows string")
    store = spark.createDataFrame([("a", "stale"), ("b", "kept"), ("d", "pushed")], "file string, rows string")
    got = {r["file"]: r["rows"] for r in caches.pulled_or_published(pulled, store, "file", "rows").collect()}
    assert got == {"a": "new", "b": None, "c": None, "d": "pushed"}


def test_files_are_written_whole(spark, tmp_path):
    df = spark.createDataFrame([("a.rs", "fn f() {}"), ("dir/sub/é.md", "# ü\n"), ("empty", ""), ("none", None)], "path string, text string")
    got = {r["path"]: r["n_bytes"] for r in files.materialise(df, str(tmp_path)).collect()}
    assert got == {"a.rs": 9, "dir/sub/é.md": 5, "empty": 0}
    assert {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()} == {"a.rs": "fn f() {}", "dir/sub/é.md": "# ü\n", "empty": ""}
    for bad in ("../x", "/etc/x", "a//b", "a/../b"):
        with pytest.raises(Exception, match="not a path below"):
            files.materialise(spark.createDataFrame([(bad, "x")], "path string, text string"), str(tmp_path)).collect()


def test_sliced_rows(spark):
    df = spark.createDataFrame([("g", i) for i in range(1, 7)] + [("h", 1)], "g string, i long")
    got = lambda spec: sorted((r["g"], r["i"], r["nth"]) for r in sequences.sliced_rows(df, ["g"], ["i"], spec).collect())
    assert got("-2") == [("g", 5, 5), ("g", 6, 6), ("h", 1, 1)]
    assert got("2") == [("g", 2, 2)] and got("5-100") == [("g", 5, 5), ("g", 6, 6)]
    for bad in ("0", "4-2", "x", "-0", "", "1-"):
        with pytest.raises(ValueError, match="not a slice"):
            sequences.sliced_rows(df, ["g"], ["i"], bad)


def test_analyse_parses_each_file_once(spark):
    """The rules read nodes that are settled; no rule goes back to the parser."""
    seen = spark.sparkContext.accumulator(0)

    def counting(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    files = spark.createDataFrame([("a.rs", "fn f(on: bool) { if !a { b(); } else { c(); } }"), ("b.rs", "// TODO: x\nfn g() {}")], "path string, text string")
    nodes = tables.nodes(files)
    total = nodes.count()
    hits = rules.analyse(nodes.mapInArrow(counting, nodes.schema), rules.enabled([])).collect()
    assert {r["rule_id"] for r in hits} >= {"boolean-parameter", "negated-condition", "todo-fixme"}
    assert seen.value == total
