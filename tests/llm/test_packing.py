"""Packing: ids, cuts, places and how many sequences are needed."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from treeloom.llm.packing import best_fit, checked, complete, cuts, encoder, fewest, fillings, pack, token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "Hello world", "é ü ß 漢字 \U0001f600‍", "tabs\t\tand  spaces \n\n end ", "a<|endoftext|>b", "'s 're 123 4567", "x" * 30_000, "word " * 5000, "Hello world"]


def test_ids_are_the_tokenizers():
    reference = Tokenizer.from_file(PATH)
    for text in TEXTS:
        assert token_ids(encoder(PATH), text or "")[:-1].tolist() == reference.encode(text or "", add_special_tokens=False).ids


@given(st.text())
@settings(max_examples=200, deadline=None)
def test_ids_of_any_text(text):
    reference = Tokenizer.from_file(PATH)
    assert token_ids(encoder(PATH), text)[:-1].tolist() == reference.encode(text, add_special_tokens=False).ids


def test_pack(spark):
    rows = list(enumerate(TEXTS)) + [(3, "again three"), (3, "again three"), (None, "no id")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sequence_id string")
    got = pack(docs, PATH).collect()
    reference = Tokenizer.from_file(PATH)
    want = []
    for i, text in rows:
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want += [(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts(len(ids), 1024))]
    key = lambda r: tuple(-1 if x is None else x for x in r[:5])
    assert sorted((tuple(r[:5]) for r in got), key=key) == sorted(want, key=key)
    filled = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 1024
    counts = {}
    for r in want:
        counts[r[3]] = counts.get(r[3], 0) + 1
    assert len(filled) == sum(n for _, n in complete(counts, 1024))
    assert pack(docs.limit(0), PATH).collect() == []


def exact(items, capacity):
    """The fewest bins, by trying all ways."""
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[k] += items[i]
            go(i + 1, bins)
            bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_search_finds_the_fewest(seed):
    rng = random.Random(seed)
    items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 11))), reverse=True)
    counts = {x: items.count(x) for x in items}
    plan = complete(counts, 20)
    packed = {}
    for chosen, bins in plan:
        assert sum(chosen) <= 20
        for x in chosen:
            packed[x] = packed.get(x, 0) + bins
    assert packed == counts
    assert fewest(counts, 20) <= sum(n for _, n in plan) == exact(items, 20)


def test_search_beats_its_incumbent():
    rng = random.Random(5)
    counts = {}
    for _ in range(100_000):
        x = min(1024, max(1, int(rng.lognormvariate(5, 0.9))))
        counts[x] = counts.get(x, 0) + 1
    found = sum(n for _, n in complete(counts, 1024))
    assert found <= sum(n for _, n in best_fit(counts, 1024))
    assert found == fewest(counts, 1024)


def drawn(rng, n, low, high):
    counts = {}
    for _ in range(n):
        x = rng.randint(low, high)
        counts[x] = counts.get(x, 0) + 1
    return counts


@pytest.mark.parametrize("low,high,each", [(342, 511, 2), (257, 341, 3), (513, 1024, 1), (205, 256, 4), (512, 512, 2)])
@pytest.mark.parametrize("n", [600, 5000])
def test_the_bound_sees_how_many_share_a_bin(monkeypatch, low, high, each, n):
    """Where no more than ``each`` pieces fit and best fit puts in as many, that is known to be best at once."""
    counts = drawn(random.Random(n), n, low, high)
    assert fewest(counts, 1024) == -(-n // each)
    monkeypatch.setattr("treeloom.llm.packing.fillings", None)  # no node is searched
    assert sum(k for _, k in complete(counts, 1024)) == -(-n // each)


@pytest.mark.parametrize("seed", range(60))
def test_the_bound_is_below_the_fewest(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 10, 12, 24, 31])
    low = rng.choice([1, 1, capacity // 5 + 1, capacity // 3])
    items = sorted((rng.randint(low, capacity) for _ in range(rng.randint(1, 10))), reverse=True)
    counts = {x: items.count(x) for x in items}
    assert -(-sum(items) // capacity) <= fewest(counts, capacity) <= exact(items, capacity)


def test_large_and_small_pieces():
    """Pieces that fill a bin but for little, and small ones that don't go in there."""
    assert fewest({900: 100, 200: 100}, 1024) == 120
    assert fewest({600: 50, 430: 50}, 1024) == 75
    assert fewest({}, 1024) == 0 and fewest({1: 1}, 1024) == 1


def offered(lengths, counts, room, waste, order="least"):
    return [x for x in fillings(lengths, counts, room, waste, order) if x is not None]


def test_dominated_fillings_are_not_offered():
    assert offered([6, 4, 3], {6: 1, 4: 1, 3: 1}, 10, 10) == [(0, (6, 4))]
    assert offered([5, 2], {5: 1, 2: 3}, 5, 5) == [(0, (5,))]  # (2, 2) wastes 1, and 5 could stand for both
    assert offered([3, 2], {3: 0, 2: 3}, 5, 5) == [(1, (2, 2))]
    assert offered([], {}, 5, 5) == [(5, ())]


def all_fillings(items, room):
    """Each multiset of ``items`` that fits, by trying all."""
    found = {()}
    for x in items:
        found |= {tuple(sorted((*f, x), reverse=True)) for f in found if sum(f) + x <= room}
    return found


def dominates(a, b):
    """Whether the pieces of ``b`` can be dealt into bins of the sizes of ``a``."""
    if not b:
        return True
    return any(x >= b[0] and dominates(a[:i] + (x - b[0],) + a[i + 1 :], b[1:]) for i, x in enumerate(a))


@pytest.mark.parametrize("seed", range(30))
def test_offered_fillings_are_the_undominated_ones(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 12) for _ in range(rng.randint(0, 8))]
    room = rng.randint(1, 16)
    counts = {x: items.count(x) for x in items}
    every = all_fillings(items, room)
    best = {f for f in every if not any(g != f and dominates(g, f) for g in every)}
    for order in ("least", "large", "greedy"):
        got = offered(sorted(counts, reverse=True), counts, room, room, order)
        assert all(sum(f) + w == room for w, f in got)
        assert order == "greedy" or [w for w, _ in got] == sorted(w for w, _ in got)
        assert {f for _, f in got} == best and len(got) == len(best)
        few = offered(sorted(counts, reverse=True), counts, room, 2, order)
        assert {f for _, f in few} == {f for f in best if room - sum(f) <= 2}


def test_every_checked_text_is_held_against_the_library(monkeypatch):
    monkeypatch.setattr("treeloom.llm.packing.token_ids", lambda enc, text: np.array([1, 2]))
    with pytest.raises(ValueError, match="disagree"):
        checked(PATH, "Hello world, a whole text")
