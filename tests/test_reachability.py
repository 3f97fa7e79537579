"""Labels, ancestor tests and reachable sets on histories with merges, against plain Python."""

import random
import re
from collections import defaultdict

import pytest

from treeloom.operators import graph


def history(rng, n, near, merges):
    """Commits 1 to n, each with a parent before it, some with more."""
    out = []
    for k in range(2, n + 1):
        if rng.random() < 0.97:
            out.append((k, rng.randrange(max(1, k - near), k)))
            out += [(k, rng.randrange(1, k)) for _ in range(2) if rng.random() < merges]
    return sorted(set(out))


def ancestors(edges):
    up = defaultdict(set)
    for h, p in edges:
        up[h].add(p)
    reach = {}
    for k in sorted({x for e in edges for x in e}):
        reach[k] = {k}.union(*(reach[p] for p in up[k]))
    return reach


@pytest.mark.parametrize("seed,n,near,merges", [(1, 60, 3, 0.3), (2, 100, 50, 0.05)])
def test_against_sets(spark, seed, n, near, merges):
    rng = random.Random(seed)
    edges = history(rng, n, near, merges)
    reach = ancestors(edges)
    parents = spark.createDataFrame(edges, "hash long, parent long")
    labelled = graph.labels(parents)
    rows = {r["hash"]: r for r in labelled.collect()}
    assert sorted(r["first"] for r in rows.values()) == list(range(len(reach)))
    for r in rows.values():
        if r["up"] is not None:
            assert rows[r["up"]]["first"] < r["first"] < r["last"] <= rows[r["up"]]["last"]
    starts = rng.sample(sorted(reach), 6) + [10**6]
    got = graph.reachable(parents, spark.createDataFrame([(s,) for s in starts], "start long"), labelled).collect()
    assert sorted(map(tuple, got)) == sorted((s, h) for s in starts for h in reach.get(s, {s}))
    pairs = [(rng.choice(sorted(reach)), rng.choice(sorted(reach))) for _ in range(300)] + [(10**6, 1), (1, 10**6), (10**6, 10**6)]
    asked = spark.createDataFrame(pairs, "of long, from long")
    want = sorted({(a, b, a in reach.get(b, {b})) for a, b in pairs})
    dates = spark.createDataFrame([(k, k // 3) for k in reach], "hash long, at long")
    for levelled in (None, graph.levels(dates, parents, "at")):
        assert sorted(map(tuple, graph.descends(parents, asked, labelled, levelled).collect())) == want


def test_levels_rise(spark):
    edges = [(2, 1), (3, 2), (4, 3), (5, 4), (5, 1), (6, None)]
    dates = [(1, 100), (2, 50), (3, 51), (4, 200), (5, 7), (6, 1)]
    got = dict(map(tuple, graph.levels(spark.createDataFrame(dates, "hash long, at long"), spark.createDataFrame(edges, "hash long, parent long"), "at").collect()))
    assert got == {1: 100, 2: 101, 3: 102, 4: 200, 5: 201, 6: 1}


def test_circles_are_errors(spark):
    circle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "hash long, parent long")
    with pytest.raises(graph.CycleError):
        graph.labels(circle)
    with pytest.raises(graph.CycleError):
        graph.levels(spark.createDataFrame([(k, 0) for k in (1, 2, 3, 4)], "hash long, at long"), circle, "at")


def test_no_commits(spark):
    none = spark.createDataFrame([], "hash long, parent long")
    assert graph.labels(none).count() == 0
    assert [tuple(r) for r in graph.reachable(none, spark.createDataFrame([(7,)], "start long")).collect()] == [(7, 7)]
    assert graph.descends(none, spark.createDataFrame([], "of long, from long")).count() == 0


def test_depth_of_ten_thousand(spark, monkeypatch):
    """Two lanes of 10,000 commits that merge into each other: rounds follow the doubling, not the depth."""
    n, rounds = 20_000, []
    settled = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: rounds.append(1) or settled(df))
    edges = [(k, k - 2) for k in range(2, n)] + [(k, k - 101) for k in range(1000, n, 1000)]  # even commits merge odd ones
    parents = spark.createDataFrame(edges, "hash long, parent long")
    labelled = graph.labels(parents)
    assert len(rounds) <= 4 + 18
    pairs = [(1, n - 1), (0, n - 1), (1, n - 2), (n - 1, 1), (899, 1000), (901, 1000), (18_899, 19_000), (18_901, 19_998), (18_899, 18_999), (17_899, 19_998)]
    want = [(a, b, (a % 2 == b % 2 and a <= b) or (a % 2 == 1 and b % 2 == 0 and b >= 1000 and a <= b // 1000 * 1000 - 101)) for a, b in pairs]
    got = graph.descends(parents, spark.createDataFrame(pairs, "of long, from long"), labelled, graph.levels(parents.select("hash").union(spark.createDataFrame([(0,), (1,)], "hash long")).distinct().withColumn("at", graph.F.col("hash")), parents, "at"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    reach = graph.reachable(parents, spark.createDataFrame([(n - 2,), (n - 1,)], "start long"), labelled)
    assert dict(map(tuple, reach.groupBy("start").count().collect())) == {n - 2: n // 2 + (19_000 - 101 + 1) // 2, n - 1: n // 2}
    assert len(rounds) < 60


def plain_walk(edges, dates, heads, most):
    """A list that is searched whole for the newest commit at every step."""
    up = defaultdict(set)
    for h, p in edges:
        up[h].add(p)
    ready, seen, out = set(heads) & set(dates), set(heads), []
    while ready and len(out) < most:
        h = min(ready, key=lambda x: (-dates[x], x))
        ready.remove(h)
        out.append(h)
        fresh = up[h] - seen
        seen |= fresh
        ready |= fresh & set(dates)
    return out


@pytest.mark.parametrize("seed,most,skew", [(1, 20, 5), (2, 15, 1000), (3, 500, 40)])
def test_walks(spark, seed, most, skew):
    rng = random.Random(seed)
    edges = history(rng, 300, 4, 0.2)
    dates = {k: 10 * k + rng.randrange(10 * skew) for k in range(1, 301)}
    heads = [200, 203] if seed != 2 else [60]
    parents = spark.createDataFrame(edges, "hash long, parent long")
    commits = spark.createDataFrame(list(dates.items()), "hash long, at long")
    got = [r["hash"] for r in graph.walked(commits, parents, heads, most).orderBy("walk_idx").collect()]
    assert got == plain_walk(edges, dates, heads, most)
    place = {h: i for i, h in enumerate(got)}
    children = defaultdict(list)
    for h, p in edges:
        children[p].append(h)
    assert all(h in heads or any(place.get(c, most) < i for c in children[h]) for h, i in place.items())


def test_a_walk_looks_at_the_newest_alone(spark, monkeypatch):
    """A long history and a short walk: no labels are made, and the window is twice the walk."""
    monkeypatch.setattr(graph, "reachable", None)
    parents = spark.range(1, 50_000).selectExpr("id as hash", "id - 1 as parent")
    commits = spark.range(50_000).selectExpr("id as hash", "id * 10 as at")
    assert [r["hash"] for r in graph.walked(commits, parents, [49_990], 12).orderBy("walk_idx").collect()] == list(range(49_990, 49_978, -1))


def test_what_is_near_is_found_step_by_step(spark, tmp_path, monkeypatch):
    """Halves and thirds of numbers: twenty steps reach everything, and no labels are made."""
    from treeloom.plans import catalog

    monkeypatch.setattr(graph, "labels", None)
    spark.range(3000).selectExpr("id as o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    want, todo = set(), [(2999, 2999), (2998, 2998)]
    while todo:
        start, k = todo.pop()
        want.add((start, k))
        todo += [(start, p) for p in (k // 2, k // 3 if k % 5 == 0 else 0) if p > 0]
    got = catalog.queries()["commit_reachability"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("most", [0, 50_000])
def test_what_is_far_is_found_by_labels(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "NEAR", most)
    edges = [(k, k - 1) for k in range(1, 90)] + [(100, 30), (100, 20)]
    parents = spark.createDataFrame(edges, "hash long, parent long")
    got = graph.reachable(parents, spark.createDataFrame([(89,), (100,), (7,)], "start long")).collect()
    assert sorted(map(tuple, got)) == sorted([(89, k) for k in range(90)] + [(100, k) for k in [*range(31), 100]] + [(7, k) for k in range(8)])


def test_sides_are_counted_without_labels(spark, tmp_path, monkeypatch):
    from treeloom.plans import catalog

    monkeypatch.setattr(graph, "labels", None)
    rows = [(1, "O", "1-URGENT"), (2, "O", "2-HIGH"), (2, "F", "2-HIGH"), (3, "O", "5-LOW"), (4, "F", "1-URGENT")]
    spark.createDataFrame(rows, "o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in catalog.queries()["ahead_behind"](spark, str(tmp_path)).collect()] == [(2, 1)]


def test_rounds_do_not_square_estimated_sizes(spark, monkeypatch):
    """Deep sides, ids far off their parents': the driver holds no estimate of more than a few hundred digits."""
    digits, settled = [], graph.settled

    def seen(df):
        out = settled(df)
        size = out._jdf.queryExecution().optimizedPlan().stats().simpleString()
        digits.append(int(found[1]) if (found := re.search(r"E\+(\d+)", size)) else 0)
        return out

    monkeypatch.setattr(graph, "settled", seen)
    monkeypatch.setattr(graph, "nearby", lambda *_: None)
    far = lambda k: str(k * 7919 % 4001)
    edges = [(far(k), far(k - 1)) for k in range(1, 1500)] + [(far(2000 + k), far(1999 + k) if k else far(1000)) for k in range(300)]
    parents = spark.createDataFrame(edges, "hash string, parent string")
    assert tuple(graph.ahead_behind(parents, far(1499), far(2299)).first()) == (499, 300)
    rounds = len(digits)
    chain = spark.range(1, 12).selectExpr("id as hash", "id - 1 as parent")
    got = graph.levels(spark.range(12).selectExpr("id as hash", "100 - id as at"), chain, "at").collect()
    assert sorted(map(tuple, got)) == [(k, 100 + k) for k in range(12)]
    assert rounds > 15 and len(digits) > rounds + 10 and max(digits) < 1000


def test_few_edges_are_looked_at_where_few_end_below(spark, tmp_path, monkeypatch):
    """All pairs of the lanes: rows that the sweeps give grow with the pairs, not with pairs times merges."""
    from treeloom.plans import catalog

    met, containing = [], graph.sweeps.containing

    def counted(*args, **named):
        met.append(containing(*args, **named).count())
        return containing(*args, **named)

    monkeypatch.setattr(graph.sweeps, "containing", counted)
    spark.range(4000).selectExpr("id as o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.queries()["ancestor_tests"](spark, str(tmp_path)).collect()
    assert len(got) == 3998 and sum(met) < 4000
    up = {k: [p for p in (k - 10 if k % 10 == 0 else k - 2 if k % 10 == 1 else k - 1, k - 7 if k % 50 == 7 else k - 1 if k % 200 == 0 else 0) if p > 0] for k in range(4000)}
    above = [0] * 4000
    for k in range(4000):
        above[k] = 1 << k
        for p in up[k]:
            above[k] |= above[p]
    assert all(r["descends"] == bool(above[r["from"]] >> r["of"] & 1) for r in got)


def test_pointers_are_followed_among_neighbours():
    ids, to, totals = [1, 2, 3, 4, 5, 6, 7], [None, 1, 2, 9, 4, 7, 6], [0, 1, 1, 5, 1, 1, 1]
    graph.shortened(ids, to, totals)
    assert to == [None, None, None, 9, 9, 7, 6] and totals == [0, 1, 2, 5, 6, 1, 1]
