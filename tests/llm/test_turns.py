"""The trie of conversations against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from treeloom.llm.turns import carried, numbered, op13, peeled, sorted_parts, trie


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), sha(f"{len(role.encode())}:{role}{text}"), role, text))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members = defaultdict(list)
    for c, mine in turns.items():
        rest = c - (abs(c) // 20 * 20) * (1 if c > 0 else -1)
        h = zlib.crc32(str(c).encode()) % 4
        made = mine if not rest else turns.get(c - rest, [])[:h] + mine[h:]
        for d in range(len(made) + 1):
            members[tuple(made[:d])].append((c, len(made) == d))
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        saved[node] = sum(saved[k] for k in children[node]) + (len(members[node]) - 1) * words
    name = {node: min(c for c, _ in m) for node, m in members.items()}
    return sorted(
        ((name[n], len(n), name[n[:-1]] if n else None, len(m), len(children[n]), leaves[n], saved[n], sha(",".join(map(str, sorted(c for c, last in m if last))))) for n, m in members.items()),
        key=repr,
    )


def made(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(1)).withColumn("digest", F.lit("x"))
    return sorted(map(tuple, trie(turns).collect()), key=repr)


def talk(rng, convs, most, words):
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for c in convs for t in range(rng.randrange(most + 1))]


ODD = [
    (None, 1, "user", "lost"), (1, None, "user", "first"), (1, 5, None, None), (1, 5, None, None), (1, 5, "b", "a"), (0, 2, "user", "a b"), (0, 1, "user", "c\x0bd"),
    (3, 0, "user", "c\x0bd"), (-3, 1, "x", "one"), (-3, 2, "x", "two"), (-3, 3, "x", "three"), (-20, 1, "y", "head"), (-25, 1, "y", "z"), (45, 1, "user", "no base"), (45, 2, "", "é ü"),
    (21, 1, "ab", "c"), (22, 1, "a", "bc"), (10**15 + 7, 1, "user", "w " * 100_000), (7, None, None, None), (7, None, None, None),
]


def test_odd_turns(spark):
    assert made(spark, ODD) == plain_trie(ODD)
    assert made(spark, ODD * 2) == plain_trie(ODD * 2)


def test_no_turns(spark):
    assert made(spark, []) == [] and made(spark, [(None, 1, "a", "b")]) == []


def test_only_a_root(spark):
    rows = [(c, 1, "u", "x") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    got = made(spark, rows)
    assert got == plain_trie(rows) and len(got) == 1 and got[0][5] == 1


def test_random_turns(spark):
    rng = random.Random(4)
    rows = talk(rng, range(-45, 130), 7, ["a", "b c", "", None])
    rng.shuffle(rows)
    assert made(spark, rows) == plain_trie(rows)


def test_one_long_conversation_and_copies(spark):
    """A third of all turns in one conversation, a third in copies of another; both span partitions."""
    rows = [(60, t, "user", f"t {t}") for t in range(900)] + [(100 * k, t, "user", f"same {t}") for k in range(1, 91) for t in range(10)] + [(60 + 20 * k, t, "user", f"t {t}") for k in range(1, 30) for t in range(0, 30 * k, 1)][:900]
    assert made(spark, rows) == plain_trie(rows)


def test_units_above_each_other(spark):
    """Each conversation leaves the one before one turn later, so units stand high above each other."""
    rows = [(20 * c, t, "u", f"{min(t, c)}") for c in range(12) for t in range(c + 2)]
    assert made(spark, rows) == plain_trie(rows)


def test_places_over_partitions(spark):
    rows = [(c, t, bytes([t % 7, c % 5]), t) for c in (1, 2, 3) for t in range(400)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, digest binary, words long")
    got = sorted((r["conv_id"], r["nth"], r["words"]) for r in numbered(turns).collect())
    assert got == [(c, t + 1, t) for c in (1, 2, 3) for t in range(400)]


def test_carried_sums(spark):
    """A running sum over all partitions, as the plainest use of carried reading."""
    rows = sorted_parts(spark.range(1000).select("id"), "id")
    sums = lambda state, after, each: ((r["id"], total) for total, r in running(state or 0, each))

    def running(total, each):
        for r in each:
            total += r["id"]
            yield total, r

    got = carried(rows, lambda each: sum(r["id"] for r in each), lambda state, n: (state or 0) + n, sums, {"id": "long", "total": "long"}).collect()
    assert {r["id"]: r["total"] for r in got} == {i: i * (i + 1) // 2 for i in range(1000)}


def test_peeling(spark):
    rng = random.Random(2)
    up = {i: rng.randrange(i) if i else None for i in range(120)}
    kids = defaultdict(list)
    for i, u in up.items():
        kids[u].append(i)
    totals = lambda i: (sum(totals(k)[0] for k in kids[i]) or 1, i + sum(totals(k)[1] for k in kids[i]))
    units = spark.createDataFrame([(i, u, len(kids[i]), int(not kids[i]), i) for i, u in up.items()], "id long, up long, waiting long, leaves long, saved long")
    assert {r["id"]: (r["leaves"], r["saved"]) for r in peeled(units).collect()} == {i: totals(i) for i in up}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_op13(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op13(spark, f"/root/testdata/{sf}").collect()), key=repr) == plain_trie(rows)
