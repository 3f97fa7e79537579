"""The Jaccard join against all pairs in plain Python, and the pipeline's stages."""

import random

import numpy as np
import pytest

import corpus_pipeline
from treeloom.llm.neardup import COORDINATES, Plan, components, jaccard_classes, loose_edges, met, one_of_each, only_stars, shingles


def plain(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().split()
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if n else frozenset())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] == sets[b] or shared and shared >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, least.get(root(i)), links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=1, groups=25, others=60):
    rng = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(5, 200))]
        for _ in range(rng.randint(2, 7)):
            rows.append((i, edited(base, rng, rng.randint(0, 4))))
            i += 1
    for _ in range(others):
        rows.append((i, " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(1, 80)))))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \n"), (i + 3, "one two"), (i + 4, "one  two"), (3, rows[3][1]), (3, "another row of three here"), (None, rows[5][1]), (None, "no id at all in here")]
    rows.append((i + 5, "long " + " ".join(f"v{k}" for k in range(30_000))))
    rows.append((i + 6, "longer " + " ".join(f"v{k}" for k in range(30_000))))
    rng.shuffle(rows)
    return rows


def run(spark, rows, plan=Plan()):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    return sorted(map(tuple, jaccard_classes(docs.select("doc_id", "text"), plan).collect()), key=repr)


def test_all_pairs(spark):
    rows = corpus()
    assert run(spark, rows) == plain(rows)


def test_deep_buckets_and_blocks(spark):
    """Small limits send every group through splitting, and through pairs of blocks."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = [(i, edited(base, rng, rng.randint(0, 4))) for i in range(150)] + [(1000 + i, edited(base, rng, 60)) for i in range(40)]
    want = plain(rows)
    assert run(spark, rows, Plan(bucket_limit=30, max_depth=2, block_sets=40)) == want
    assert run(spark, rows, Plan(bucket_limit=60, max_depth=4, block_sets=50)) == want


def test_empty(spark):
    assert run(spark, []) == []
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert one_of_each(docs).collect() == []


def test_runs_reach_the_recall():
    assert 1 - np.exp(-1.0) ** Plan().runs >= Plan().recall


def test_pairs_in_split_buckets_meet(spark):
    """Pairs whose buckets are split at every depth, and which no third set connects."""
    rng, n = np.random.default_rng(4), 300
    first = rng.integers(0, 3, (n, COORDINATES)).astype(np.uint32)  # three tokens a coordinate: buckets of many
    second = first.copy()
    for row in second:
        row[rng.choice(COORDINATES, COORDINATES - 51, replace=False)] += 3
    sets = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate([*first, *second])], "set long, tokens binary")
    found = {frozenset(e) for e in loose_edges(sets, Plan(bucket_limit=2)).collect()}
    assert sum(frozenset((i, n + i)) not in found for i in range(n)) <= 1


def test_leaders_keep_every_pair_together(spark):
    """What looks alike in a large bucket is connected by its leaders, and hardly anything is split."""
    rng, n = np.random.default_rng(5), 900
    base = rng.integers(0, 1 << 31, COORDINATES).astype(np.uint32)
    tokens = np.repeat(base[None], n, 0)
    for i, row in enumerate(tokens):
        row[rng.choice(COORDINATES, int(rng.integers(0, 8)), replace=False)] = i + 1
    other = rng.integers(0, 1 << 31, (200, COORDINATES)).astype(np.uint32)
    other[:, :12] = base[:12]  # in the same buckets, but not alike
    every = np.concatenate([tokens, other])
    sets = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(every)], "set long, tokens binary")
    plan = Plan(bucket_limit=200)
    edges, split = met(sets, sets, plan, range(plan.runs))
    assert split.count() <= 200
    component = {r["node"]: r["component"] for r in components(loose_edges(sets, plan)).collect()}
    alike = (every[:, None, :] == every[None, :, :]).sum(2) >= 39
    assert all(component[int(i)] == component[int(j)] for i, j in zip(*np.nonzero(alike), strict=True) if i != j)
    assert len(set(component.get(i, i) for i in range(n, n + 200))) == 200


def test_a_common_passage_splits_only_what_is_far_over_the_limit(spark):
    """Texts with a passage in common fill large buckets, and no leader settles them."""
    rng, n = np.random.default_rng(6), 260
    every = rng.integers(0, 1 << 31, (2 * n, COORDINATES)).astype(np.uint32)
    every[:, :14] = every[0, :14]
    every[n:, 14:45] = every[:n, 14:45]  # each is like one other, in 45 tokens
    sets = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(every)], "set long, tokens binary")
    for limit, splits in ((200, False), (20, True)):
        plan = Plan(bucket_limit=limit)
        edges, split = met(sets, sets, plan, range(plan.runs))
        assert (split.count() > 0) == splits
        component = {r["node"]: r["component"] for r in components(loose_edges(sets, plan)).collect()}
        assert sum(component.get(i) != i or component.get(n + i) != i for i in range(n)) <= 1


def test_only_stars(spark):
    for edges, told in (([], True), ([(5, 1), (6, 1), (7, 2)], True), ([(5, 1), (1, 0)], False), ([(5, 1), (5, 2)], False)):
        assert only_stars(spark.createDataFrame(edges, "u long, v long")) == told


def test_a_large_group_of_near_copies(spark):
    """The whole operator on a group far over its limits, against all pairs."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    rows = [(i, edited(base, rng, rng.randint(0, 3))) for i in range(420)] + [(1000 + i, edited(base, rng, rng.randint(6, 40))) for i in range(60)]
    assert run(spark, rows, Plan(bucket_limit=100, block_sets=150)) == plain(rows)


def test_split_runs_reach_the_recall():
    plan = Plan()
    assert all(plan.missed(plan.split_runs, d) + plan.missed(plan.runs, 1) <= 1 - plan.recall for d in range(2, plan.max_depth + 1))


def test_one_of_each(spark):
    rows = corpus(2)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, first_id string")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    kept = [tuple(r) for r in kept.collect()]
    classes = {}
    for (doc_id, text), _ in zip(rows, rows, strict=True):
        classes.setdefault((doc_id, text), 0)
    # as many rows as classes, no two of which are linked
    pairs = plain([(d, t) for d, t, _ in kept])
    assert all(links == 0 for _, _, links in pairs)
    linked = {}
    sets = {t: frozenset(shingles((t or "").encode()).tolist()) for _, t in rows}
    for _, text in rows:
        s = sets[text]
        linked[text] = any(s == (k := sets[t]) or len(s & k) >= 0.5 * len(s | k) for _, t, _ in kept)
    assert all(linked.values())


@pytest.mark.parametrize("n", [1, 2, 50])
def test_components(spark, n):
    rng = random.Random(n)
    edges = [(rng.randrange(5 * n), rng.randrange(5 * n)) for _ in range(4 * n)] + [(k, k + 1) for k in range(1000, 1000 + 2 * n)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def test_pipeline_keeps_columns_and_clean_documents(spark):
    rng = random.Random(6)
    clean = [(i, " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(900)}" for _ in range(120)), "en", f"s{i % 3}", 0) for i in range(40)]
    junk = [(100, "too short", "en", "s0", 0), (101, "spam spam spam " * 100, "en", "s0", 0), (102, None, None, None, None)]
    near = [(200, clean[0][1] + " tail", "en", "s1", 0)]
    docs = spark.createDataFrame(clean + junk + near, "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        if name != names[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert kept[0] == kept[1] == {*range(40), 200}
    assert kept[2] == set(range(40))
    assert kept[3] <= kept[2] and kept[4] == kept[3]
