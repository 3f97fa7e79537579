"""Fill-in-the-middle against plain Python: cuts, forms, lists and what grouping does."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.llm.infill import Infill, count_of, elias_fano, infilled, line_ends, op11, restored, select

TEXTS = [
    None, "", "one", "one\n", "\n", "\n\n\n", "a\nb", "a\n\nb\n", "é\nü\n\U0001f600 x\ny", "with <P> in it\nx", "<S>", "x\n<M>\ny", "x<\nS>\ny", "a\r\nb\rc\x0b\x85d",
    "x" * 300_000, "\n".join(f"line {i} é" for i in range(5000)), "<", "<S\n<P\n", "a\nb", "a\nb",
]


def plain(doc_id, text, plan=Infill()):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{plan.seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= plan.percent:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < plan.spm_percent else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h4 % 100 < plan.spm_percent else "psm", len(p), len(m), out


def rows_of(made, plan=Infill()):
    made = made.select("*", restored(F.col("output"), F.col("form"), plan).alias("back")).collect()
    assert all(r["back"] == r["text"] for r in made)
    return sorted(((r["doc_id"], r["n"], r["form"], None if r["prefix"] is None else len(r["prefix"]), None if r["middle"] is None else len(r["middle"]), r["output"]) for r in made), key=repr)


def test_lists():
    rng = random.Random(3)
    for values in [[], [1], [5], [1, 2, 3], list(range(1, 400)), [10**6], sorted(rng.sample(range(1, 10**7), 3000)), sorted(rng.sample(range(1, 5000), 4000))]:
        listed = elias_fano(np.array(values, np.int64))
        assert count_of(listed) == len(values) and [select(listed, k) for k in range(len(values))] == values
    assert len(elias_fano(np.arange(100, 100 * 10_001, 100))) < 10_000 * (2 + 7) / 8 + 20


def test_line_ends():
    for text in TEXTS:
        units, ends = re.findall(r"[^\n]*\n|[^\n]+", text or ""), line_ends(text or "")
        assert list(ends) == list(np.cumsum([len(u) for u in units], dtype=int))


@pytest.mark.parametrize("plan", [Infill(), Infill(seed="x", percent=60, spm_percent=20)])
def test_against_plain(spark, plan):
    rows = [(i, t) for k in range(6) for i, t in enumerate(TEXTS, 100 * k)] + [(None, "a\nb"), (None, None), (3, "one\n"), (3, "one\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("digest", F.lit("x"))
    for parts in (2, 1000):
        assert rows_of(infilled(docs, plan, parts=parts), plan) == sorted((plain(i, t, plan) for i, t in rows), key=repr)


def test_hot_copies(spark):
    rows = [(i, "a\nb\nc\n") for i in range(3000)] + [(i, f"text {i}\nof its own") for i in range(3000, 3500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(infilled(docs, parts=10)) == sorted((plain(i, t) for i, t in rows), key=repr)


def test_empty_table_and_shared_digest(spark):
    assert infilled(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "ab"), (2, "cd")], "doc_id long, text string")
    with pytest.raises(Exception, match="share the digest"):
        infilled(docs, parts=1, digest=lambda t: F.length(t).cast("string")).collect()


def test_sentinels():
    for marks in [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("xa", "ay", "<M>")]:
        with pytest.raises(ValueError):
            Infill("7", *marks)


def test_op11(spark):
    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((i, n, form, p, m, sha(out), sha(t or "")) for i, t in texts for _, n, form, p, m, out in [plain(i, t)])
    assert sorted(map(tuple, op11(spark, sf).collect())) == want
