"""Points in spans by a sweep, against all pairs: wide, nested, crossing and empty spans, busy keys."""

import random

import pytest
from pyspark.sql import functions as F

from treeloom.operators import intervals, sweeps, todos

SPANS = "k string, id long, s long, e long, depth long"


@pytest.fixture
def many_parts(spark):
    """More parts than the session's few, so that spans cross them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def made(spark, points, spans):
    return spark.createDataFrame(points, "k string, at long"), spark.createDataFrame(spans, SPANS)


def best(points, spans):
    out = []
    for k, p in points:
        around = [(-d, i) for g, i, s, e, d in spans if None not in (g, s, e, k, p) and g == k and s <= p < e]
        if around:
            out.append((k, p, min(around)[1]))
    return sorted(out)


def random_case(seed, n_spans, n_points, width):
    rng = random.Random(seed)
    spans = [(rng.choice(["a", "a", "a", "b", "c"]), i, s, s + rng.randrange(-1, width), rng.randrange(6)) for i in range(n_spans) for s in [rng.randrange(-50, 1000)]]
    points = [(rng.choice("abd"), rng.randrange(-100, 1200)) for _ in range(n_points)]
    return points + points[:30] + [(None, 5), ("a", None)], spans + [(None, 999, 0, 2000, 9), ("a", 998, None, 5, 9), ("a", 997, 5, None, 9)]


@pytest.mark.parametrize("seed,n,width", [(1, 80, 60), (2, 300, 5), (3, 60, 2000), (4, 40, 10**9), (5, 1, 3)])
def test_against_all_pairs(spark, many_parts, seed, n, width):
    points, spans = random_case(seed, n, 400, width)
    p, s = made(spark, points, spans)
    got = intervals.deepest(p, s, "k", "at", "s", "e", "depth", "id").select("k", "at", "id").collect()
    assert sorted(map(tuple, got)) == best(points, spans)
    pairs = sweeps.containing(p, s, "k", "at", "s", "e").select("row.*", "span.id").collect()
    assert sorted(map(tuple, pairs)) == sorted((k, x, i) for k, x in points for g, i, a, b, _ in spans if None not in (g, a, b, k, x) and g == k and a <= x < b)


def test_a_wide_span_costs_no_rows(spark, many_parts):
    """Three points in a span of two thousand million places: as many rows go to the sweep as there are points and spans, and a few."""
    points, spans = [("a", 5), ("a", 10**9), ("a", 2 * 10**9 - 1), ("a", 2 * 10**9)], [("a", 1, 0, 2 * 10**9, 0)]
    p, s = made(spark, points, spans)
    found = sweeps.innermost(p, s, "k", "at", "s", "e", F.col("id"))
    assert sorted((r["row"]["at"], r["span"]["id"]) for r in found.collect()) == [(5, 1), (10**9, 1), (2 * 10**9 - 1, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower()


def nest(levels, copies):
    """``copies`` nests beside each other in one key, each ``levels`` deep."""
    spans, step = [], 2 * levels + 2
    for c in range(copies):
        for d in range(levels):
            spans.append(("x", c * levels + d, c * step + d, c * step + step - 1 - d, d))
    return spans, step


def test_deep_nests_in_one_key(spark, many_parts):
    """100,000 spans, nested 1,000 deep, in one key; the answer is known by arithmetic and, for some, by all pairs."""
    levels, copies = 1000, 100
    spans, step = nest(levels, copies)
    rng = random.Random(1)
    points = [("x", rng.randrange(-5, copies * step + 5)) for _ in range(3000)]

    def known(at):
        c, x = divmod(at, step)
        depth = min(x, step - 2 - x, levels - 1)
        return c * levels + depth if 0 <= c < copies and depth >= 0 else None

    p, s = made(spark, points, spans)
    got = sorted((r["at"], r["id"]) for r in intervals.deepest(p, s, "k", "at", "s", "e", "depth", "id").collect())
    assert got == sorted((at, known(at)) for _, at in points if known(at) is not None)
    assert best(points[:40], spans) == sorted(("x", at, known(at)) for _, at in points[:40] if known(at) is not None)


def test_spans_over_many_parts(spark, many_parts):
    """Wide spans whose best differs from part to part."""
    rng = random.Random(9)
    points = [("a", x) for x in range(0, 2600, 2)]
    spans = [("a", i, s, s + rng.randrange(400, 2500), rng.randrange(3)) for i in range(40) for s in [rng.randrange(2000)]]
    p, s = made(spark, points, spans)
    got = intervals.deepest(p, s, "k", "at", "s", "e", "depth", "id").select("k", "at", "id").collect()
    assert sorted(map(tuple, got)) == best(points, spans)


def test_empty_tables(spark):
    p, s = made(spark, [("a", 1)], [("a", 1, 0, 5, 0)])
    none_p, none_s = p.limit(0), s.limit(0)
    for points, spans in ((none_p, s), (p, none_s), (none_p, none_s)):
        assert intervals.deepest(points, spans, "k", "at", "s", "e", "depth", "id").count() == 0
        assert intervals.nearest(points, spans, "k", "at", "s", "e", "id", "id").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_nearest_over_parts(spark, many_parts, seed):
    points, spans = random_case(seed, 25, 300, 90)
    spans = [x for x in spans if None not in x and x[3] > x[2]]
    points = [x for x in points if None not in x]
    want = []
    for k, at in points:
        every = [((s - at if at < s else at - e + 1 if at >= e else 0), at < s, i) for g, i, s, e, _ in spans if g == k]
        if every:
            want.append((k, at, min(every)[2]))
    p, s = made(spark, points, spans)
    assert sorted(map(tuple, intervals.nearest(p, s, "k", "at", "s", "e", "id", "id").collect())) == sorted(want)


def test_touching_commits(spark, many_parts):
    rng = random.Random(3)
    hunks = [(f"h{i}", rng.choice("ab"), rng.randrange(1, 300), rng.randrange(0, 9)) for i in range(300)] + [("n", None, 1, 1)]
    symbols = [(rng.choice("abc"), a, a + rng.randrange(0, 6)) for a in rng.sample(range(1, 300), 25)]
    changes = spark.createDataFrame(hunks, "hash string, path string, hunk_new_start int, hunk_new_lines int")
    spans = spark.createDataFrame(symbols, "path string, start_line int, end_line int")
    want = [h for h in hunks if any(p == h[1] and h[2] <= e and h[2] + max(h[3], 1) - 1 >= s for p, s, e in symbols)]
    assert sorted(map(tuple, intervals.touching_commits(changes, spans, "path").collect())) == sorted(want)


def test_entries_run_to_the_end_of_their_block(spark):
    text = "x\n// TODO: a\n// b\n// NOTE: c\n\n// later\n# FIXME: d\n# e\ncode // TODO: alone\n// next"
    rows = todos.entries(spark.createDataFrame([("f", text)], "path string, body string"), "path", "body").collect()
    assert sorted((r["line_no"], r["tag"], r["text"]) for r in rows) == [(2, "TODO", "a\nb\nNOTE: c"), (4, "NOTE", "c"), (7, "FIXME", "d\ne"), (9, "TODO", "alone")]
