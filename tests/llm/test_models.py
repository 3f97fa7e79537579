"""Language, toxicity and licences: training, odd input, held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pytest

from treeloom.llm import langid, toxicity
from treeloom.llm.licences import RULES, SENTENCES, Found, Phrases, identified, licences, recognised

PARTS = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "ver", "ig"], "cc": ["eau", "que", "oi", "ment"]}


def made(lang, rng, n=60):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language(spark):
    rng = random.Random(1)
    rows = [(i, made(lang, rng), lang) for i in range(400) for lang in [rng.choice(list(PARTS))]]
    odd = [(1000, None, "aa"), (1001, "123 ²½ !?", "bb"), (1002, "", None), (1003, made("cc", rng, 40_000), None), (None, made("aa", rng), "aa")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, lang_pred string")
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in docs.select("doc_id", "lang", langid.held_out(docs["doc_id"]).alias("h"), langid.language(docs["text"], model, spark).alias("p")).collect()}
    held = [r for r in got.values() if r["h"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert held and all(r["p"]["lang_pred"] == r["lang"] for r in held)
    assert [got[i]["p"]["lang_pred"] for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "cc", "aa"]
    assert all(0 <= r["p"]["score"] <= 1 for r in got.values())
    assert not got[1000]["p"]["accepted"]
    again = langid.fit(docs)
    assert np.array_equal(again.table, model.table)
    nothing = langid.fit(docs.limit(0))
    assert nothing.predict("any text") == ("und", 0.0)


def test_words_add_up():
    rng = random.Random(2)
    model = langid.train([(made(lang, rng).split(), lang) for lang in PARTS for _ in range(30)])
    text = made("aa", rng) + " " + made("bb", rng, 20)
    ids, _ = langid.features(text.split(), model.settings)
    direct = model.table[ids].astype(float).mean(0) + model.bias
    assert np.allclose(model.logits(text), direct, atol=1e-5)


SMALL = toxicity.Shape(window=5, stride=3, hidden=3, attention=4, word_dim=3, gram_dim=2, word_buckets=64, gram_buckets=64)


def test_gradients():
    net, rng = toxicity.Network(SMALL), np.random.default_rng(0)
    for k in net.w:
        net.w[k] = net.w[k] + 0.1 * rng.standard_normal(net.w[k].shape)
    x, mask, doc, y = rng.standard_normal((5, 4, 5)), np.ones((5, 4), bool), np.array([0, 0, 1, 1]), np.array([1, 0])
    mask[3:, 1] = False
    loss = lambda z: toxicity.smoothed_max_loss(z, doc, y, 2.0)
    _, g, dx = net.gradients(x, mask, loss)
    for array, grad in [*((net.w[k], g[k]) for k in g), (x, dx)]:
        flat, slope = array.reshape(-1), grad.reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old, step = flat[i], 1e-3
            flat[i] = old + step
            up = net.gradients(x, mask, loss)[0]
            flat[i] = old - step
            down = net.gradients(x, mask, loss)[0]
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(slope[i], abs=2e-4)


def test_windows_cover_all():
    for n in range(0, 200):
        at = toxicity.starts(n, toxicity.Shape())
        covered = {i for s in at for i in range(s, min(n, s + 32))}
        assert covered == set(range(n))
        assert all(b - a <= 16 for a, b in zip(at[:-1], at[1:], strict=True))


def toxic_rows(n, rng):
    plain = [made(rng.choice(["aa", "cc"]), rng, rng.randint(5, 150)).split() for _ in range(n)]
    rows = []
    for i, words in enumerate(plain):
        y = rng.random() < 0.3
        if y:
            words[rng.randrange(len(words))] = rng.choice(["vile", "scumbag", "rotten"])
        rows.append((i, " ".join(words), int(y)))
    return rows


def test_toxicity(spark):
    rng = random.Random(4)
    rows = toxic_rows(700, rng)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    out = docs.select("doc_id", toxicity.held_out(docs["doc_id"]).alias("h"), toxicity.toxicity(docs["text"], model, spark).alias("s")).collect()
    held = [(r["s"] >= 0.5, rows[r["doc_id"]][2]) for r in out if r["h"]]
    assert np.mean([a == b for a, b in held]) > 0.95
    # scores don't depend on what else is in the batch, nor on the cache
    texts = [t for _, t, _ in rows[:60]] + [None, "", "word", made("aa", rng, 30_000) + " vile"]
    together = model.score(texts)
    small = toxicity.Toxicity(toxicity.Shape(cache=50, slice=3), model.net, model.prior)
    assert np.allclose(small.score(texts), together, atol=1e-5)
    assert np.allclose([model.score([t])[0] for t in texts], together, atol=1e-5)
    assert together[-1] > 0.5 and all((0 <= together) & (together <= 1))


def test_training_windows_hold_every_word_once():
    for n in (1, 31, 32, 33, 64, 200):
        for shift in (0, 1, 17, 31):
            parts = toxicity.side_by_side(np.arange(n), 32, shift)
            assert np.concatenate(parts).tolist() == list(range(n)) and all(0 < len(p) <= 32 for p in parts)


def test_gradients_in_slices():
    """A batch of more windows than a slice gives the gradients of the whole batch."""
    rng = np.random.default_rng(3)
    words = [b"w%d" % k for k in range(40)]
    windows = [rng.integers(0, 40, rng.integers(1, 6)).astype(np.int32) for _ in range(23)]
    doc, y = np.repeat(np.arange(3), [10, 12, 1]), np.array([1, 0, 1])
    got = []
    for slice_ in (100, 5):
        shape = toxicity.Shape(window=5, stride=3, hidden=3, attention=4, word_dim=3, gram_dim=2, word_buckets=64, gram_buckets=64, slice=slice_)
        got.append(toxicity.batch_gradients(toxicity.Network(shape), toxicity.Vocabulary(words, shape), windows, lambda z: toxicity.smoothed_max_loss(z, doc, y, 2.0)))
    (whole, moved), (sliced, moved_sliced) = got
    assert all(np.allclose(whole[k], sliced[k], atol=1e-5) for k in whole)
    for k in moved:
        assert moved[k][0].tolist() == moved_sliced[k][0].tolist() and np.allclose(moved[k][1], moved_sliced[k][1], atol=1e-5)


def plain_score(model, text):
    """The score of a text by one window and one step at a time, from the weights alone."""
    w, s = model.net.w, model.shape
    sig = lambda x: 1 / (1 + np.exp(-x.astype(float)))
    words = toxicity.words_of(text or "")
    if not words:
        return float(sig(w["out_bias"])[0])

    def vector(word):
        marked = b"<" + word + b">"
        grams = []
        for n in range(s.shortest, s.longest + 1):
            for i in range(len(marked) - n + 1):
                code = sum(b << (8 * (n - 1 - k)) for k, b in enumerate(marked[i : i + n]))
                grams.append(int(langid.mixed(np.array([code + (n << 56)], np.uint64))[0]) % s.gram_buckets)
        whole = int(langid.mixed(np.array([zlib.crc32(word)], np.uint64))[0]) % s.word_buckets
        return np.concatenate([w["words"][whole], np.mean([w["grams"][g] for g in grams], axis=0)])

    def states(xs, way):
        h, state, out = s.hidden, np.zeros(s.hidden), []
        for x in xs if way == "f" else xs[::-1]:
            g, again = x @ w[f"in_{way}"] + w[f"bias_{way}"], state @ w[f"back_{way}"]
            z, r = sig(g[:h] + again[:h]), sig(g[h : 2 * h] + again[h : 2 * h])
            new = np.tanh(g[2 * h :] + r * again[2 * h :])
            state = (1 - z) * new + z * state
            out.append(state)
        return out if way == "f" else out[::-1]

    best = -np.inf
    for at in range(0, max(1, len(words)), 1):
        if at not in toxicity.starts(len(words), s):
            continue
        xs = [vector(word) for word in words[at : at + s.window]]
        both = [np.concatenate(p) for p in zip(states(xs, "f"), states(xs, "b"), strict=True)]
        e = np.array([np.tanh(p @ w["attend"] + w["attend_bias"]) @ w["query"] for p in both])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        best = max(best, float((a[:, None] * np.array(both)).sum(0) @ w["out"] + w["out_bias"][0]))
    return 1 / (1 + np.exp(-best))


def saved(tmp_path, spark, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_op2_against_plain_scores(spark, tmp_path):
    """The whole query, over odd and repeated rows and clashing columns, rescored one step at a time."""
    rng = random.Random(8)
    rows = toxic_rows(250, rng)
    long_word = "vile" * 60  # longer than any bound on words
    texts = [(i, t) for i, t, _ in rows] + [(5, rows[5][1]), (900, None), (901, ""), (902, "?!"), (903, long_word + " and more"), (None, "vile " + made("aa", rng))]
    labels = [(i, y) for i, _, y in rows] + [(None, 1), (903, 1), (7, None)]
    sf = saved(tmp_path, spark, documents=([(i, t, "x", 3.0) for i, t in texts], "doc_id long, text string, lang string, score double"), labels=([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int"))
    got = toxicity.op2(spark, sf).collect()
    assert got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"} and len(got) == len(texts)
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((i, plain_score(model, t)) for i, t in texts), key=order)
    for (i, p), r in zip(want, sorted(((r["doc_id"], r["score"], r["held_out"], r["predicted"]) for r in got), key=order), strict=True):
        assert r[0] == i and r[1] == pytest.approx(p, abs=2e-4) and r[3] == (r[1] >= 0.5)
        assert r[2] == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0)


def test_training_does_not_depend_on_the_tables_layout(spark):
    rng = random.Random(9)
    rows = toxic_rows(120, rng) + [(3, "another text of three", 0), (3, "and one more vile", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    shape = toxicity.Shape(epochs=1, max_documents=60)
    one, two = toxicity.fit(docs, labels, shape), toxicity.fit(docs.repartition(7, "text").orderBy("text"), labels.repartition(3), shape)
    assert all(np.array_equal(one.net.w[k], two.net.w[k]) for k in one.net.w)
    spoken = docs.selectExpr("doc_id", "text", "if(doc_id % 2 = 0, 'aa', 'bb') lang")
    few = langid.Settings(max_documents=40)
    assert np.array_equal(langid.fit(spoken, few).table, langid.fit(spoken.repartition(5, "text"), few).table)


def test_empty_tables(spark, tmp_path):
    sf = saved(tmp_path, spark, documents=([], "doc_id long, text string, lang string"), labels=([], "doc_id long, toxic int"))
    assert toxicity.op2(spark, sf).collect() == [] == langid.op6(spark, sf).collect()


def test_op6_against_plain_sums(spark, tmp_path):
    rng = random.Random(11)
    texts = [(i, made(lang, rng, rng.randint(1, 300)), lang) for i in range(150) for lang in [rng.choice(list(PARTS))]]
    texts += [(texts[4][0], texts[4][1], texts[4][2]), (900, None, "aa"), (901, "12 + 3", "bb"), (902, "", None), (903, "ka" * 150, "aa"), (None, made("bb", rng), None)]
    sf = saved(tmp_path, spark, documents=([(*t, "x") for t in texts], "doc_id long, text string, lang string, lang_pred string"))
    got = langid.op6(spark, sf).collect()
    assert {"doc_id", "held_out", "lang_pred", "score"} <= set(got[0].asDict()) and len(got) == len(texts)
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"))

    def plain(text):
        words = [x.lower() for x in langid.WORD.findall((text or "").lower())]
        if not words:
            return "und", 0.0
        at = np.concatenate([langid.features([x], model.settings)[0] for x in words])
        logits = (model.table[at].astype(float).mean(0) + model.bias) / model.temperature
        p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
        return model.languages[int(p.argmax())], float(p.max())

    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = sorted(((i, *plain(t)) for i, t, _ in texts), key=order)
    for w, r in zip(want, sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in got), key=order), strict=True):
        assert r[:2] == w[:2] and r[2] == pytest.approx(w[2], abs=1e-6)


def test_equal_languages_go_to_the_first_name():
    table = np.zeros((langid.Settings().buckets, 3), np.float32)
    model = langid.Model(langid.Settings(), ["aa", "bb", "cc"], table, np.array([0.0, 1.0, 1.0]))
    assert model.predict("word")[0] == "bb"


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")).score(["a", None]).tolist() == [0.5, 0.5]
    assert toxicity.train([([[b"a"]], 1)]).score(["x"]).tolist() == [1.0]


def brute(text):
    """Known sentences by trying every known sentence at every line and after every stop, longest first."""
    out, free = [], 0
    starts = sorted({0, *(m.end() for m in re.finditer(r"\n|[.;:!?]\s+", text))})
    for at in starts:
        if at < free:
            continue
        best = None
        for name, sentence in SENTENCES.items():
            words = [r"[^\W_]+(?:[\W_]+[^\W_]+){0,11}?" if w == "*" else re.escape(w) for w in sentence.split()]
            m = re.compile(r"[\s#*/-]*(" + r"[\W_]+".join(words) + r")(?=[\s]*(?:[.;:!?,](?:\s|$)|\n|$))", re.IGNORECASE).match(text, at)
            if m and (best is None or m.end(1) > best[0]):
                best = (m.end(1), name)
        if best:
            out.append(best[1])
            free = best[0]
    return out


TEXTS = [
    "foo. Licensed under CC BY-NC 4.0.\nbar", "Licensed under the Apache License, Version 2.0.", "he said licensed under the MIT license", "Released under the MIT License",
    "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:\n# Redistributions of source code must retain the above copyright notice, this\n# list of conditions and the following disclaimer.",
    "Neither the name of Foo Bar Inc nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "This work is licensed under the GNU General Public License, version 3.\n" * 3, "", "Copyright (c) 2020 A B C. All rights reserved.",
]


@pytest.mark.parametrize("text", TEXTS)
def test_sentences(text):
    assert [f.identifier for f in identified(text, Phrases(SENTENCES))] == brute(text)


def test_rules():
    assert all(w in SENTENCES for _, wanted in RULES for w in wanted)
    seq = lambda *names: [Found(n, i, i + 1) for i, n in enumerate(names)]
    names = lambda found: [g[0] for g in recognised(found)]
    assert names(seq("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty")) == ["BSD-3-Clause"]
    assert names(seq("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")) == ["BSD-2-Clause"]
    assert names(seq("bsd-warranty", "bsd-binary", "bsd-source", "bsd-grant")) == []
    assert names(seq("mit-short", "mit-short", "apache-short")) == ["MIT", "MIT", "Apache-2.0"]
    assert names(seq("mit-grant", "mit-notice", "mit-short", "mit-warranty", "mit-liability")) == ["MIT", "MIT"]
    assert len(recognised(seq(*["mit-short"] * 20_000))) == 20_000


def test_licence_column(spark):
    docs = spark.createDataFrame([(1, "x. Released under the MIT License.", 1), (2, None, 2), (3, "", 3)], "doc_id long, text string, matches int")
    rows = {r["doc_id"]: r["s"] for r in docs.select("doc_id", licences(docs["text"]).alias("s")).collect()}
    assert rows[1]["licences"] == ["MIT"] and (rows[1]["matches"][0]["start"], rows[1]["matches"][0]["end"]) == (3, 33)
    assert rows[2]["licences"] == [] == rows[3]["licences"]
    assert docs.limit(0).select(licences(docs["text"])).collect() == []
