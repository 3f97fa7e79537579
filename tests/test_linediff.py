"""Edit scripts and line origins against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from treeloom.operators import linediff
from treeloom.operators.linediff import blamed, hunks, line_map, matched, origins, patch_applied, patched, rising, script, unified


def common(a, b):
    """The length of the longest common subsequence, by the whole table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def test_shortest_edits():
    words = [list(w) for n in range(5) for w in itertools.product("ab", repeat=n)] + [list(w) for w in itertools.product("abc", repeat=4)]
    rng = random.Random(1)
    cases = list(itertools.product(words, words))
    cases += [([rng.randrange(k) for _ in range(rng.randrange(40))], [rng.randrange(k) for _ in range(rng.randrange(40))]) for k in (2, 3, 8, 30) for _ in range(150)]
    for a, b in cases:
        found = matched(a, b)
        assert all(a[i] == b[j] for i, j in found) and len(found) == common(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(found))


def test_rising():
    rng = random.Random(2)
    for n in range(60):
        js = rng.sample(range(100), n)
        got = rising(list(enumerate(js)))
        assert all(p[1] < q[1] for p, q in itertools.pairwise(got)) and len(got) == common(js, sorted(js))


def texts(rng, n):
    """Pairs of texts: edits, moves, repeated lines, missing last line feeds, nulls."""
    out = [(None, None), (None, "a\n"), ("a", None), ("", ""), ("a", "a\n"), ("a\nb\n", "a\nb\n"), ("a\n" * 30, "a\n" * 7), ("x\ny\nz", "z\ny\nx"), ("a\r\nb\r\n", "a\nb\r\n"), ("\n\n\n", "\n"), ("-- a\n", "++ b\n"), ("@@ x\n \n", "\\ y\n")]
    while len(out) < n:
        a = [f"l{rng.randrange(60)}" if rng.random() < 0.7 else "" for _ in range(rng.randrange(80))]
        b = list(a)
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(b) + 1)
            match rng.randrange(4):
                case 0:
                    b[at:at] = [f"n{rng.randrange(9)}"]
                case 1:
                    del b[at : at + rng.randrange(4)]
                case 2:
                    b[at : at + 1] = ["changed"]
                case 3:
                    block, b = b[at : at + 5], b[:at] + b[at + 5 :]
                    b[:0] = block
        out.append(("\n".join(a), "\n".join(b) + "\n" * rng.randrange(2)))
    return out


def cut(text):
    *whole, last = (text or "").split("\n")
    return [x + "\n" for x in whole] + [last] * bool(last)


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(texts(random.Random(4), 120))]
    return rows, spark.createDataFrame(rows, "id int, old string, new string")


def test_line_maps(pairs):
    rows, df = pairs
    kept = {}
    for r in line_map(df, "id", "old", "new").collect():
        kept.setdefault(r["id"], []).append((r["i"], r["j"]))
    held = most = 0
    for i, a, b in rows:
        a, b, got = cut(a), cut(b), sorted(kept.get(i, []))
        assert all(a[x] == b[y] for x, y in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(got))
        held, most = held + len(got), most + common(a, b)
    assert held >= 0.9 * most  # anchors may cost some repeated lines


def test_lines_that_only_go_or_come(spark):
    """Where one text is the other with lines taken out, all of its lines are kept."""
    rng, rows = random.Random(5), []
    for i in range(60):
        a = [f"l{rng.randrange(25)}" for _ in range(rng.randrange(60))]
        b = [x for x in a if rng.random() < 0.7]
        rows.append((i, *(("\n".join(x) + "\n" if x else "") for x in ((a, b) if i % 2 else (b, a))), len(b)))
    df = spark.createDataFrame(rows, "id int, old string, new string, n int")
    got = {r["id"]: r["count"] for r in line_map(df, "id", "old", "new").groupBy("id").count().collect()}
    assert got == {i: n for i, *_, n in rows if n}


def test_scripts(pairs):
    rows, df = pairs
    found = {}
    for r in script(df, "id", "old", "new").collect():
        found.setdefault(r["id"], []).append(r)
    for i, a, b in rows:
        lines = sorted(found.get(i, []), key=lambda r: r["pos"])
        assert [r["pos"] for r in lines] == list(range(1, len(lines) + 1))
        assert [r["line"] for r in lines if r["sign"] != "+"] == cut(a) and [r["line"] for r in lines if r["sign"] != "-"] == cut(b)


def plain_diff(rows, path, context=3):
    """A diff from a script's rows, by a plain loop."""
    changed = [n for n, r in enumerate(rows) if r["sign"] != " "]
    if not changed:
        return ""
    shown = sorted({n for c in changed for n in range(max(0, c - context), min(len(rows), c + context + 1))})
    out = f"--- a/{path}\n+++ b/{path}\n"
    for _, run in itertools.groupby(enumerate(shown), key=lambda x: x[1] - x[0]):
        part = [rows[n] for _, n in run]
        head = []
        for other, before in (("+", part[0]["i"]), ("-", part[0]["j"])):
            n = sum(r["sign"] != other for r in part)
            head.append(f"{before + (n > 0)}" + ("" if n == 1 else f",{n}"))
        out += f"@@ -{head[0]} +{head[1]} @@\n"
        out += "".join(r["sign"] + r["line"] + ("" if r["line"].endswith("\n") else "\n\\ No newline at end of file\n") for r in part)
    return out


def test_diffs(pairs):
    rows, df = pairs
    lines = {}
    for r in script(df, "id", "old", "new").collect():
        lines.setdefault(r["id"], []).append(r)
    made = unified(df, "id", "old", "new", F.concat(F.lit("/f/"), F.col("id").cast("string")))
    got = {r["id"]: (r["diff"], r["back"]) for r in made.join(df, "id").select("id", "diff", patched(F.col("old"), F.col("diff")).alias("back")).collect()}
    assert len(got) == len(rows)
    for i, a, b in rows:
        diff, back = got[i]
        assert diff == plain_diff(sorted(lines.get(i, []), key=lambda r: r["pos"]), f"f/{i}")
        assert back == (b or "")


def test_known_diffs(spark):
    rows = [("a\nb\nc\n", "a\nx\nc\n"), ("same", "same"), ("a", "b\n"), ("", "x\n"), ("x\n", "")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id int, old string, new string")
    got = [r["diff"] for r in unified(df, "id", "old", "new", F.lit("f.rs")).orderBy("id").collect()]
    head = "--- a/f.rs\n+++ b/f.rs\n"
    assert got == [head + "@@ -1,3 +1,3 @@\n a\n-b\n+x\n c\n", "", head + "@@ -1 +1 @@\n-a\n\\ No newline at end of file\n+b\n", head + "@@ -0,0 +1 @@\n+x\n", head + "@@ -1 +0,0 @@\n-x\n"]
    assert [tuple(r)[1:6] for r in hunks(script(df, "id", "old", "new"), "id").where("id = 3").collect()] == [(1, 0, 0, 1, 1)]


def test_patches_that_do_not_fit():
    assert patch_applied("a\nz\n", "--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n a\n-b\n+x\n") is None
    assert patch_applied("a\n", "@@ -1,2 +1,2 @@\n a\n-b\n+x\n") is None
    assert patch_applied("a\nb\n", "") == "a\nb\n"


def history(rng, files):
    out = []
    for f in range(files):
        lines, fresh = [f"{f}:{k}" for k in range(rng.randrange(12))], itertools.count(100)
        for v in range(rng.randrange(1, 14)):
            out.append((f"f{f}", v * 10 + rng.randrange(9), "\n".join(lines) if rng.random() < 0.9 else "\n".join(lines) + "\n"))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(lines) + 1)
                match rng.randrange(3):
                    case 0:
                        lines[at:at] = [f"{f}:{next(fresh)}" if rng.random() < 0.8 else "}"]
                    case 1:
                        del lines[at : at + 2]
                    case 2:
                        block, lines = lines[at : at + 3], lines[:at] + lines[at + 3 :]
                        lines += block
    return out


def test_origins_against_a_loop(spark):
    rows = history(random.Random(6), 9) + [("null", 1, None), ("null", 2, "a\n"), ("null", 3, None), ("null", 4, "a\n"), ("one", 5, "x\ny")]
    by_file = {}
    for f, v, t in sorted(rows, key=lambda r: (r[0], r[1])):
        by_file.setdefault(f, []).append((v, t))
    steps = [(f"{f}/{v}", old, new) for f, vs in by_file.items() for (_, old), (v, new) in itertools.pairwise(vs)]
    kept = {}
    for r in line_map(spark.createDataFrame(steps, "id string, old string, new string"), "id", "old", "new").collect():
        kept.setdefault(r["id"], {})[r["j"]] = r["i"]
    want = []
    for f, vs in by_file.items():
        last = []
        for v, t in vs:
            now = []
            for j, _ in enumerate(cut(t)):
                i = kept.get(f"{f}/{v}", {}).get(j)
                now.append(last[i] if i is not None else (v, j + 1))
            want += [(f, v, j + 1, *o) for j, o in enumerate(now)]
            last = now
    got = origins(spark.createDataFrame(rows, "file string, version int, body string"), "file", "version", "body")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    runs = [(f, v, a, b, o) for (f, v), ls in itertools.groupby(sorted(want), key=lambda r: r[:2]) for o, a, b in grouped([(r[2], r[3]) for r in ls])]
    assert sorted(map(tuple, blamed(got, "file", "version").collect())) == sorted(runs)


def grouped(lines):
    for o, run in itertools.groupby(lines, key=lambda x: x[1]):
        run = [n for n, _ in run]
        yield o, run[0], run[-1]


def test_long_history(spark, monkeypatch):
    """A line that stays through 70 versions is found in seven rounds."""
    rounds = []
    settled = linediff.graph.settled
    monkeypatch.setattr(linediff.graph, "settled", lambda df: rounds.append(1) or settled(df))
    rows = [("f", v, "stays\n" + f"new {v}\n" + "goes\n" * (v < 3)) for v in range(70)]
    got = {(r["version"], r["line_no"]): (r["origin"], r["origin_line"]) for r in origins(spark.createDataFrame(rows, "file string, version int, body string"), "file", "version", "body").collect()}
    assert all(got[v, 1] == (0, 1) and got[v, 2] == (v, 2) for v in range(70)) and got[2, 3] == (0, 3) and (3, 3) not in got
    assert len(rounds) <= 2 + 8


def test_a_script_deals_its_lines_once(spark):
    """Lines and the marks of kept ones meet in one exchange by key; no join carries lines."""
    pairs = spark.createDataFrame([(1, "a\nb\nc\n", "a\nc\nd"), (2, None, "x")], "id long, old string, new string")
    made = linediff.script(pairs, "id", "old", "new")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = sorted((r["id"], r["pos"], r["sign"], r["i"], r["j"], r["line"]) for r in made.collect())
    assert got == [(1, 1, " ", 0, 0, "a\n"), (1, 2, "-", 1, 1, "b\n"), (1, 3, " ", 2, 1, "c\n"), (1, 4, "+", 3, 2, "d"), (2, 1, "+", 0, 0, "x")]


def test_a_search_reads_each_pair_once(spark):
    """Kept lines are found without an exchange or a join, and by one search."""
    pairs = spark.createDataFrame([(1, "a\nb\nc\n", "a\nc\nd"), (1, "a\na\n", "a"), (None, "x\n", "x\n"), (None, None, "")], "id long, old string, new string")
    made = line_map(pairs, "id", "old", "new")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    assert sorted(map(repr, map(tuple, made.collect()))) == ["(1, 0, 0)", "(1, 2, 1)", "(None, 0, 0)"]
    assert script(pairs, "id", "old", "new")._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_lines_that_only_go_are_found_without_a_search(monkeypatch):
    """Where one side is the other with lines taken out, time grows with the lines."""
    rng = random.Random(7)
    a = [rng.randrange(5) for _ in range(20_000)]
    b = [x for i, x in enumerate(a) if i % 3 != 2]
    monkeypatch.setattr(linediff, "meeting", None)
    for one, two in ((a, b), (b, a)):
        found = matched(one, two)
        assert len(found) == len(b) and all(one[i] == two[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(found))


def test_texts_that_are_no_text(spark):
    """Bytes that are no UTF-8 count as the sign that stands for them, on both sides."""
    pairs = spark.range(1).selectExpr("id", "cast(X'61ff0a62' as string) AS old", "'a�\nb\n' AS new")
    assert [tuple(r) for r in line_map(pairs, "id", "old", "new").collect()] == [(0, 0, 0)]
