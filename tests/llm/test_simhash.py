"""SimHash against plain Python: fingerprints, neighbours by id, pairs within a radius."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from treeloom.llm import simhash
from treeloom.llm.common import written
from treeloom.llm.simhash import Tables, closed, fingerprint_of, followed, likeness, near_prints, op12, within

M = (1 << 64) - 1
TEXTS = [None, "", " \n\t", "one", "One", "one two", "a b c d e f g a b c d e f g", "é ü \x85 x", "x" * 3_000_000, "word " * 70_000, " ".join(f"w{i * 7919 % 5003}" for i in range(200_000))]


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_print(text):
    words = [xxh3_64_intdigest(w) for w in (text or "").lower().encode().split()]
    sums, terms = [0.0] * 64, Counter()
    for width in (2, 5):
        width = min(width, len(words))
        for i in range(len(words) - width + 1 if words else 0):
            h = 0
            for w in words[i : i + width]:
                h = mixed(h * 0x9E3779B97F4A7C15 + w & M)
            terms[h] += 1
    for h, n in terms.items():
        for bit in range(64):
            sums[bit] += (1 + math.log(n)) * (1 if h >> bit & 1 else -1)
    return sum(1 << bit for bit in range(64) if sums[bit] > 1e-9)


def alike(a, b):
    apart = (a ^ b).bit_count()
    return 1.0 if not apart else 0.0 if apart >= 32 else math.cos(math.pi * apart / 64)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints():
    for text in TEXTS[:-1]:
        assert fingerprint_of(text) == plain_print(text), repr(text)[:40]
    assert fingerprint_of(None) == fingerprint_of(" ") == 0


def test_pieces(monkeypatch):
    whole = fingerprint_of(TEXTS[-1])
    monkeypatch.setattr(simhash, "PIECE", 1000)
    assert fingerprint_of(TEXTS[-1]) == whole


def near_by_all_pairs(prints, radius):
    out = {}
    for a, (n, _) in prints.items():
        others = [b for b in prints if b != a and (a ^ b).bit_count() <= radius]
        if others:
            out[signed(a)] = (sum(prints[b][0] for b in others), min((prints[b][1] for b in others if prints[b][1] is not None), default=None))
    return out


def clustered(rng, groups, size, flips):
    out = {}
    for _ in range(groups):
        middle = rng.getrandbits(64)
        for _ in range(size):
            x = middle
            for _ in range(rng.randrange(flips + 1)):
                x ^= 1 << rng.randrange(64)
            out[x] = (rng.randrange(1, 5), rng.randrange(10**17) if rng.random() < 0.9 else None)
    return out


@pytest.mark.parametrize("plan", [Tables(), Tables(blocks=4), Tables(radius=6, blocks=8), Tables(radius=0, blocks=2), Tables(bucket_limit=7)])
def test_within(spark, plan):
    prints = clustered(random.Random(5), 40, 25, 3) | {x: (1, 1) for x in (0, M, 1, 3, 7, 15, 1 << 63)}
    rows = spark.createDataFrame([(signed(p), n, i) for p, (n, i) in prints.items()], "fingerprint long, n long, first_id long")
    got = {r["fingerprint"]: (r["n_near"], r["near_id"]) for r in within(rows, plan).collect()}
    assert got == near_by_all_pairs(prints, plan.radius)


def test_one_large_group(spark):
    rng = random.Random(8)
    middle = rng.getrandbits(64)
    prints = {middle ^ (1 << a | 1 << b): (1, k) for k, (a, b) in enumerate((a, b) for a in range(64) for b in range(a, 64))}
    rows = spark.createDataFrame([(signed(p), n, i) for p, (n, i) in prints.items()], "fingerprint long, n long, first_id long")
    got = {r["fingerprint"]: (r["n_near"], r["near_id"]) for r in within(rows, Tables(bucket_limit=100)).collect()}
    assert got == near_by_all_pairs(prints, 3)


def test_plans_that_cannot_be():
    for bad in ((3, 3), (-1, 4), (3, 65), (10, 40)):
        with pytest.raises(ValueError):
            Tables(*bad)


def test_near_documents(spark):
    prints = [5, 5, 5, 7, 1 << 40, signed(M), None, 5]
    docs = spark.createDataFrame([(i, p, "x") for i, p in zip((4, 3, None, 1, 9, 2, 8, 6), prints)], "doc_id long, fp long, n_near_ string")
    got = {r["doc_id"]: (r["n_near"], r["near_id"]) for r in near_prints(docs.where("fp is not null"), "fp", "doc_id").collect()}
    assert got == {4: (5, 1), 3: (5, 1), None: (5, 1), 6: (5, 1), 1: (4, 1), 9: (4, 3), 2: (0, 2)}


def plain_next(rows):
    distinct = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0], hashlib.sha256(r[1].encode()).hexdigest()))
    after = dict(zip(distinct, distinct[1:] + distinct[:1]))
    return sorted(((i, t, *after[i, t]) for i, t in rows), key=repr)


@pytest.mark.parametrize("rows", [
    [], [(1, "a")], [(1, "a")] * 5, [(2, "b"), (1, "a")], [(i * 7 % 101, f"t{i}") for i in range(101)],
    [(None, "x"), (None, "y"), (None, "x"), (3, "p"), (3, "q"), (3, "p"), (-1, ""), (10**15, "é")], [(i // 40, f"t{i % 3}") for i in range(400)],
])
def test_followed(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = closed(written(followed(docs, "doc_id", "text"), "t"))
    got = [tuple(r) for r in pairs.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*", "next.*").collect()]
    assert sorted(got, key=repr) == plain_next(rows)


def plain_op12(rows):
    prints = {(i, t): plain_print(t) for i, t in set(rows)}
    out = []
    for i, t, j, u in plain_next(rows):
        k = len(t) // 4
        edited = t[: len(t) - k] + u[:k]
        own, changed = prints[i, t], plain_print(edited)
        near = [a for a, b in rows if (prints[a, b] ^ own).bit_count() <= 3]
        ids = [a for a in near if a is not None]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{own:016x}", f"{changed:016x}", round(alike(own, changed), 9), round(alike(own, prints[j, u]), 9), len(near) - 1, min(ids, default=None)))
    return sorted(out, key=repr)


def test_op12(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    rows = [(i, t or "") for i, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in op12(spark, sf).collect()]
    assert sorted(got, key=repr) == plain_op12(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(5, "a b c d e f g h"), (5, "a b c d e f g h"), (None, "a b c d e f g h"), (None, None), (2, ""), (7, "x y"), (3, "same text of some words here"), (4, "same text of some words here")]])
def test_odd_documents(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, `next` int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in op12(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == plain_op12([(i, t or "") for i, t in rows])


def test_likeness(spark):
    df = spark.createDataFrame([(0, (1 << k) - 1 if k < 64 else -1) for k in range(0, 65, 4) if k != 64] + [(0, -1)], "a long, b long").select(likeness(F.col("a"), F.col("b")).alias("l"), "b")
    assert all(abs(r["l"] - alike(0, r["b"] & M)) < 1e-12 for r in df.collect())


def test_numpy_and_plain_mixing():
    xs = [random.Random(1).getrandbits(64) for _ in range(100)]
    with np.errstate(over="ignore"):
        assert simhash.mixed(np.array(xs, np.uint64)).tolist() == [mixed(x) for x in xs]
