"""Quality rules and mixing against plain Python."""

import hashlib
import os
import re

import pytest

from treeloom.llm.mixing import MOST, SEED, WEIGHTS, mix, rated
from treeloom.llm.quality import Bands, quality_filter, quality_signals, repeated_words, word_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")

TEXTS = [
    None, "", " \t\n", "word", "a b c a b c", "one two three four " * 40, "é ü x y " * 20, "x" * 300_000,
    "\n".join(f"line {i % 5}" for i in range(60)) + "\n \n \n", "# $ % a|b <c> & * $$" * 10,
    " ".join(f"w{i * 7919 % 1009}" for i in range(400)), os.urandom(40_000).hex(), "ab " * 20_000,
    "\x1c\x1d w\x85v " * 30,
]


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    inside = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
    lines, n_dup, earlier = text.split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            n_dup += line in earlier
            earlier.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), n_dup, len(inside), failed


def signals(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality_signals(docs["text"]).alias("s")).collect()}


def test_counts(spark):
    got = signals(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        s = got[i]
        assert (s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"], s["base_failed"]) == plain_counts(text), repr(text)[:60]


def test_verdict(spark):
    import zstandard

    squeeze, bands = zstandard.ZstdCompressor(level=3).compress, Bands()
    for i, s in signals(spark, TEXTS).items():
        raw = (TEXTS[i] or "").encode()
        if not raw:
            assert not s["kept"] and s["whole_ratio"] is None
            continue
        chunks = [raw[a : a + 4096] for a in range(0, len(raw), 4096)]
        n_out = sum(bands.outside(len(c), len(squeeze(c)) / len(c)) for c in chunks)
        whole = len(squeeze(raw)) / len(raw)
        assert s["whole_ratio"] == whole and (s["n_chunks"], s["n_chunks_outside"]) == (len(chunks), n_out)
        assert s["kept"] == (not s["base_failed"] and not bands.outside(len(raw), whole) and n_out <= 0.5 * len(chunks))


def test_many_distinct_words():
    ids = word_ids([b"%d" % i for i in range(50)] * 2)
    assert repeated_words(ids) == 100
    assert repeated_words(ids + (1 << 21)) == 100  # numbers that don't fit three to a key


def test_filter_keeps_clashing_columns(spark):
    good = " ".join(f"word{i * 31 % 211} and{i}" for i in range(80))
    docs = spark.createDataFrame([(1, good, "a", "b"), (2, "short", "c", "d")], "doc_id long, text string, signals string, kept string")
    assert [tuple(r) for r in quality_filter(docs).collect()] == [(1, good, "a", "b")]
    assert quality_filter(docs.limit(0)).collect() == []


def plain_mix(rows):
    """rows: (doc_id, text, source). Returns (size, source_size, target, taken) in order."""
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    totals = {}
    for (_, _, s), n in zip(rows, sizes, strict=True):
        totals[s] = totals.get(s, 0) + n
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes))
    while open_:  # share out, cut, share the excess out again
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole >= MOST * totals[s]}
        if not over:
            target |= {s: left * weight[s] / whole for s in open_}
            break
        target |= {s: MOST * totals[s] for s in over}
        left -= sum(MOST * totals[s] for s in over)
        open_ -= over
    out = []
    for (i, _, s), n in zip(rows, sizes, strict=True):
        rate = target[s] / totals[s] if totals[s] else 0.0
        u = int(hashlib.md5(f"{SEED}:{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / 2.0**52
        out.append((n, totals[s], pytest.approx(target[s]), n * (int(rate) + (u < rate - int(rate)))))
    return out


MIX = [
    *[(i, "w " * (1 + i % 13), "hot") for i in range(300)],
    *[(1000 + i, "one two", "b") for i in range(5)],
    (2000, "a b c d", "Z"), (2001, None, "Z"), (2002, "", None), (2003, "x y", None), (None, "n o", None),
    (2004, "é   z", "ä"), (2005, "", "empty"), (7, "again seven", "b"), (7, "again seven", "b"), (3000, "v " * 50_000, "long"),
]


def test_mix(spark):
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(MIX)], "doc_id long, text string, source string, size int")
    got = {r["size"]: r["mix_"] for r in rated(docs).collect()}
    for k, want in enumerate(plain_mix(MIX)):
        m = got[k]
        assert (m["size"], m["source_size"], m["target"], m["size"] * m["copies"]) == want, MIX[k]
        assert m["copies"] <= 3


def test_mix_emits_copies(spark):
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(MIX)], "doc_id long, text string, source string, size int")
    copies = {r["size"]: r["mix_"]["copies"] for r in rated(docs).collect()}
    out = mix(docs)
    assert out.columns == docs.columns
    counted = {r["size"]: r["count"] for r in out.groupBy("size").count().collect()}
    assert counted == {k: n for k, n in copies.items() if n}
    assert mix(docs.limit(0)).collect() == []
