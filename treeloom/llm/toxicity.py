"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is lower-cased, ASCII punctuation becomes space, and what is left
between spaces are its words. A word's input has two parts: the embedding of
the hashed word, and the average embedding of its hashed character n-grams. Two
gated recurrent layers read a window of 32 words in either direction; attention
weights their states, and their weighted sum gives the window's logit. Windows
overlap by half and the last ends with the text; the score of a text is that of
its highest window.

Training is in numpy, by Adam, on a bounded sample of labelled rows, whose texts
are read whole. Labels are of whole texts, so a text's windows share one loss,
on their smoothed maximum. In training, windows lie side by side rather than
overlap, so each word is learned from once in each pass; the first begins a
different number of words into the text in each pass, so that words are seen
with all their neighbours.

When scoring, what a word adds to the gates is computed once for each distinct
word, and all windows of a batch go through the layers together.

Defined results for odd input: a null text or one without words is scored as an
empty window, the offset alone; texts under 32 words are one shorter window;
very long texts have all their windows scored, in slices; repeated rows get
equal scores; labels that repeat a doc_id count as toxic if one is; without
labels of both kinds all scores are the share of toxic labels (0.5 without
any); an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import table, tidy
from treeloom.llm.langid import held_out, mixed

PUNCTUATION = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Shape:
    #: Bound of the training sample: labelled documents, each learned from whole.
    max_documents: int = 4000
    window: int = 32
    stride: int = 16
    word_buckets: int = 1 << 14
    gram_buckets: int = 1 << 15
    #: Bytes of the character n-grams; a word's marks count.
    shortest: int = 3
    longest: int = 6
    word_dim: int = 12
    gram_dim: int = 12
    hidden: int = 8
    attention: int = 8
    epochs: int = 8
    batch: int = 32
    rate: float = 0.01
    sharpness: float = 2.0
    seed: int = 3
    #: Distinct words whose gate inputs a worker keeps, and windows scored at once.
    cache: int = 60_000
    slice: int = 4096


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(PUNCTUATION).split()


def buckets(words: list[bytes], s: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's bucket; the buckets of all its n-grams, and the place of each one's word."""
    whole = (mixed(np.array([zlib.crc32(w) for w in words], np.uint64)) % np.uint64(s.word_buckets)).astype(np.int64)
    marked = [b"<" + w + b">" for w in words]
    codes = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in marked])
    h, ids, owners = codes, [], []
    for n in range(2, s.longest + 1):
        h = (h[:-1] << np.uint64(8)) | codes[n - 1 :]
        if n >= s.shortest:
            inside = owner[: len(h)] == owner[n - 1 :]
            ids.append(mixed(h[inside] + np.uint64(n << 56)))
            owners.append(owner[: len(h)][inside])
    grams = (np.concatenate(ids) % np.uint64(s.gram_buckets)).astype(np.int64)
    return whole, grams, np.concatenate(owners)


def starts(n: int, s: Shape) -> list[int]:
    """Where the windows of ``n`` words begin; all are whole if ``n`` reaches one."""
    return [0] if n <= s.window else [*range(0, n - s.window, s.stride), n - s.window]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights by name, and the passes through them."""

    def __init__(self, s: Shape) -> None:
        rng = np.random.default_rng(s.seed)
        h, d, draw = s.hidden, s.word_dim + s.gram_dim, lambda *n: (rng.standard_normal(n) / np.sqrt(n[0])).astype(np.float32)
        self.s = s
        self.w = {
            "words": (0.1 * rng.standard_normal((s.word_buckets, s.word_dim))).astype(np.float32),
            "grams": (0.1 * rng.standard_normal((s.gram_buckets, s.gram_dim))).astype(np.float32),
            "attend": draw(2 * h, s.attention), "attend_bias": np.zeros(s.attention, np.float32), "query": draw(s.attention),
            "out": draw(2 * h), "out_bias": np.zeros(1, np.float32),
        }
        for way in ("f", "b"):
            self.w |= {f"in_{way}": draw(d, 3 * h), f"bias_{way}": np.zeros(3 * h, np.float32), f"back_{way}": draw(h, 3 * h)}

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """The input vectors of distinct words."""
        whole, grams, owner = buckets(words, self.s)
        out = np.zeros((len(words), self.s.word_dim + self.s.gram_dim), np.float32)
        out[:, : self.s.word_dim] = self.w["words"][whole]
        count = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        for k in range(self.s.gram_dim):
            out[:, self.s.word_dim + k] = np.bincount(owner, self.w["grams"][grams, k], len(words)) / count
        return out

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {way: x @ self.w[f"in_{way}"] + self.w[f"bias_{way}"] for way in ("f", "b")}

    def layer(self, way: str, gates: np.ndarray, mask: np.ndarray | None, keep: list | None = None) -> np.ndarray:
        """States (window, step, hidden) for gate inputs (step, window, 3 hidden)."""
        steps, n, h = len(gates), gates.shape[1], self.s.hidden
        state, back = np.zeros((n, h), np.float32), self.w[f"back_{way}"]
        out = np.zeros((steps, n, h), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            again = state @ back
            zr = sigmoid(gates[t, :, : 2 * h] + again[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gates[t, :, 2 * h :] + r * again[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, z, r, new, again))
            following = new + z * (state - new)
            state = following if mask is None else np.where(mask[t][:, None], following, state)
            out[t] = state
        return out

    def pooled(self, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, tuple]:
        """Logits of windows from their states (step, window, 2 hidden)."""
        u = np.tanh(states @ self.w["attend"] + self.w["attend_bias"])
        e = u @ self.w["query"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        a = np.exp(e - e.max(0))
        if mask is not None:
            a = a * mask
        a = a / np.maximum(a.sum(0), 1e-9)
        c = np.einsum("tn,tnh->nh", a, states)
        return c @ self.w["out"] + self.w["out_bias"][0], (u, a, c)

    def forward(self, gates: dict[str, np.ndarray], mask: np.ndarray | None) -> np.ndarray:
        states = np.concatenate([self.layer(way, gates[way], mask) for way in ("f", "b")], 2)
        return self.pooled(states, mask)[0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, loss_of) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """(loss, gradients of the layers' weights, gradient of the inputs ``x`` (step, window, d)).

        ``loss_of(logits)`` gives the loss and its gradient.
        """
        w, h, g = self.w, self.s.hidden, {}
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.layer(way, x @ w[f"in_{way}"] + w[f"bias_{way}"], mask, kept[way]) for way in ("f", "b")], 2)
        logits, (u, a, c) = self.pooled(states, mask)
        loss, dz = loss_of(logits)
        g["out"], g["out_bias"] = c.T @ dz, np.array([dz.sum()])
        dc = dz[:, None] * w["out"]
        da = np.einsum("nh,tnh->tn", dc, states)
        dstates = a[:, :, None] * dc[None]
        de = a * (da - (a * da).sum(0))
        du = de[:, :, None] * w["query"] * (1 - u**2)
        g["query"] = np.einsum("tn,tna->a", de, u)
        g["attend"], g["attend_bias"] = np.einsum("tnh,tna->ha", states, du), du.sum((0, 1))
        dstates += du @ w["attend"].T
        dx = np.zeros_like(x)
        for k, way in enumerate(("f", "b")):
            carried = np.zeros((x.shape[1], h), np.float32)
            dgates = np.zeros((*x.shape[:2], 3 * h), np.float32)
            dback = np.zeros_like(w[f"back_{way}"])
            for t, state, z, r, new, again in reversed(kept[way]):
                total = carried + dstates[t, :, k * h : (k + 1) * h]
                live = mask[t][:, None]
                d = np.where(live, total, 0)
                dnew = d * (1 - z) * (1 - new**2)
                dzz = d * (state - new) * z * (1 - z)
                dr = dnew * again[:, 2 * h :] * r * (1 - r)
                dgates[t] = np.concatenate([dzz, dr, dnew], 1)
                dagain = np.concatenate([dzz, dr, dnew * r], 1)
                dback += state.T @ dagain
                carried = np.where(live, d * z + dagain @ w[f"back_{way}"].T, total)
            g[f"back_{way}"] = dback
            g[f"in_{way}"], g[f"bias_{way}"] = np.einsum("tnd,tng->dg", x, dgates), dgates.sum((0, 1))
            dx += dgates @ w[f"in_{way}"].T
        return loss, g, dx


def smoothed_max_loss(logits: np.ndarray, doc: np.ndarray, y: np.ndarray, sharpness: float) -> tuple[float, np.ndarray]:
    """Mean log loss of documents on the smoothed maximum of their windows' logits."""
    top = np.full(len(y), -np.inf, np.float32)
    np.maximum.at(top, doc, logits)
    e = np.exp(sharpness * (logits - top[doc]))
    share = e / np.bincount(doc, e, len(y))[doc]
    value = np.bincount(doc, share * logits, len(y))
    p = sigmoid(value)
    loss = float(-np.mean(np.where(y == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9))))
    slope = (p - y) / len(y)
    return loss, (slope[doc] * share * (1 + sharpness * (logits - value[doc]))).astype(np.float32)


class Adam:
    def __init__(self, w: dict[str, np.ndarray], rate: float) -> None:
        self.rate, self.m, self.v, self.t = rate, {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0

    def step(self, w: dict[str, np.ndarray], name: str, g: np.ndarray, rows: np.ndarray | None = None, share: float = 1.0) -> None:
        at = slice(None) if rows is None else rows
        m, v = self.m[name], self.v[name]
        m[at] = 0.9 * m[at] + 0.1 * g
        v[at] = 0.999 * v[at] + 0.001 * g * g
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        w[name][at] -= (self.rate * share * fix * m[at] / (np.sqrt(v[at]) + 1e-8)).astype(np.float32)


@dataclass
class Toxicity:
    """A trained model; ``net`` is None if there was nothing to tell apart."""

    shape: Shape
    net: Network | None
    prior: float
    _index: dict[bytes, int] = field(default_factory=dict, repr=False)
    _gates: dict[str, np.ndarray] | None = field(default=None, repr=False)

    def _ids(self, words: list[bytes]) -> np.ndarray:
        new = list(dict.fromkeys(w for w in words if w not in self._index))
        if self._gates is None or len(self._index) + len(new) > len(self._gates["f"]):
            self._index, new = {}, list(dict.fromkeys(words))
            room = max(self.shape.cache, len(new))
            self._gates = {way: np.zeros((room, 3 * self.shape.hidden), np.float32) for way in ("f", "b")}
        if new:
            at = len(self._index)
            for way, g in self.net.gates(self.net.inputs(new)).items():
                self._gates[way][at : at + len(new)] = g
            self._index.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self._index.__getitem__, words), np.int64, len(words))

    def logits(self, ids: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Logits of windows of word numbers (window, step)."""
        out = []
        for at in range(0, len(ids), self.shape.slice):
            part = ids[at : at + self.shape.slice].T
            out.append(self.net.forward({way: self._gates[way][part] for way in ("f", "b")}, None if mask is None else mask[at : at + self.shape.slice].T))
        return np.concatenate(out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.prior)
        s, best = self.shape, np.full(len(texts), -np.inf)
        full, short, waiting = [], [], 0

        def flush() -> None:
            nonlocal full, waiting
            if full:
                logits = self.logits(np.concatenate([w for _, w in full]))
                np.maximum.at(best, np.repeat([k for k, _ in full], [len(w) for _, w in full]), logits)
                full, waiting = [], 0

        def flush_short() -> None:
            nonlocal short
            if short:
                ids = np.zeros((len(short), s.window), np.int64)
                mask = np.zeros((len(short), s.window), bool)
                for row, (_, i) in enumerate(short):
                    ids[row, : len(i)], mask[row, : len(i)] = i, True
                best[[k for k, _ in short]] = self.logits(ids, mask)
                short = []

        for k, text in enumerate(texts):
            words = words_of(text or "")
            if self._gates is not None and len(self._index) + len(words) > len(self._gates["f"]):
                flush()  # the word numbers may be dealt anew
                flush_short()
            ids = self._ids(words)
            if len(ids) == 0:
                best[k] = self.net.w["out_bias"][0]
            elif len(ids) <= s.window:
                short.append((k, ids))
            else:
                at = np.array(starts(len(ids), s))
                full.append((k, ids[at[:, None] + np.arange(s.window)]))
                waiting += len(at)
                if waiting >= s.slice:
                    flush()
        flush()
        flush_short()
        return sigmoid(best)


def summed_by(where: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows that go to each of ``n`` places."""
    return np.stack([np.bincount(where, rows[:, k], n) for k in range(rows.shape[1])], 1)


def segment_sums(rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each of ``n`` owners, whose rows lie together; every owner has some."""
    return np.add.reduceat(rows, np.searchsorted(owner, np.arange(n)), axis=0)


class Vocabulary:
    """The buckets of words, by the words' numbers, computed once."""

    def __init__(self, words: list[bytes], s: Shape) -> None:
        whole, grams, sizes = [], [], []
        for at in range(0, len(words), 10_000):  # in parts: all n-grams at once would take much memory
            part = words[at : at + 10_000]
            w, g, owner = buckets(part, s)
            whole.append(w.astype(np.int32))
            grams.append(g[np.argsort(owner, kind="stable")].astype(np.int32))
            sizes.append(np.bincount(owner, minlength=len(part)))  # a word and its marks have an n-gram at least
        self.whole, self.grams, self.size = np.concatenate(whole), np.concatenate(grams), np.concatenate(sizes)
        self.begin = np.cumsum(self.size) - self.size

    def grams_of(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of words, the place of each one's word, and how many each word has."""
        size = self.size[known]
        owner = np.repeat(np.arange(len(known)), size)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        return self.grams[np.repeat(self.begin[known], size) + inside], owner, size


def side_by_side(words: np.ndarray, window: int, shift: int) -> list[np.ndarray]:
    """All of ``words`` in windows that don't overlap, the first one of ``shift`` words, if any."""
    if len(words) <= window:
        return [words]
    cuts = range(shift or window, len(words), window)
    return np.split(words, cuts)


def train(samples: Iterable[tuple[list[list[bytes]], int]], s: Shape = Shape()) -> Toxicity:
    """A model from (passages of words, label) samples; windows lie within a passage."""
    number: dict[bytes, int] = {}
    numbers = lambda words: np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
    numbered = [([numbers(p) for p in passages if p], y) for passages, y in samples if any(passages)]
    prior = float(np.mean([y for _, y in numbered])) if numbered else 0.5
    if len({y for _, y in numbered}) < 2:
        return Toxicity(s, None, prior)
    net, rng = Network(s), np.random.default_rng(s.seed)
    net.w["out_bias"][0] = np.log(prior / (1 - prior))
    vocabulary = Vocabulary(list(number), s)
    adam, steps = Adam(net.w, s.rate), s.epochs * -(-len(numbered) // s.batch)
    for _ in range(s.epochs):
        order = rng.permutation(len(numbered))
        for at in range(0, len(order), s.batch):
            part = [([w for p in numbered[i][0] for w in side_by_side(p, s.window, int(rng.integers(s.window)))], numbered[i][1]) for i in order[at : at + s.batch]]
            doc, y = np.repeat(np.arange(len(part)), [len(ws) for ws, _ in part]), np.array([y for _, y in part])
            layers, buckets_moved = batch_gradients(net, vocabulary, [w for ws, _ in part for w in ws], lambda z, d=doc, y=y: smoothed_max_loss(z, d, y, s.sharpness))
            adam.t += 1
            share = 1 - adam.t / (steps + 1)
            for name, grad in layers.items():
                adam.step(net.w, name, grad, share=share)
            for name, (rows, grad) in buckets_moved.items():
                adam.step(net.w, name, grad, rows, share)
    return Toxicity(s, net, prior)


def batch_gradients(net: Network, vocabulary: Vocabulary, windows: list[np.ndarray], loss_of) -> tuple[dict[str, np.ndarray], dict[str, tuple]]:
    """Gradients of the layers' weights, and (buckets, gradients) of the embeddings, for windows of word numbers.

    ``slice`` windows at a time, so that a very long text takes no more memory:
    if there are more, a first pass gives the logits that the loss needs.
    """
    s, parts = net.s, [windows[at : at + net.s.slice] for at in range(0, len(windows), net.s.slice)]
    slopes: list[np.ndarray | None] = [None]
    if len(parts) > 1:
        logits = []
        for part in parts:
            x, mask, *_ = window_inputs(net, vocabulary, part)
            logits.append(net.forward(net.gates(x), mask))
        slope = loss_of(np.concatenate(logits))[1]
        slopes = [slope[at : at + s.slice] for at in range(0, len(slope), s.slice)]
    layers: dict[str, np.ndarray] = {}
    moved: dict[str, list] = {"words": [], "grams": []}
    for part, slope in zip(parts, slopes, strict=True):
        x, mask, place, known, grams, owner, count = window_inputs(net, vocabulary, part)
        _, g, dx = net.gradients(x, mask, loss_of if slope is None else lambda z, dz=slope: (0.0, dz))
        for name, grad in g.items():
            layers[name] = layers[name] + grad if name in layers else grad
        dwords = summed_by(place, dx[mask], len(known))
        moved["words"].append((vocabulary.whole[known], dwords[:, : s.word_dim]))
        moved["grams"].append((grams, (dwords[:, s.word_dim :] / count[:, None])[owner]))
    out = {}
    for name, found in moved.items():
        used, where = np.unique(np.concatenate([rows for rows, _ in found]), return_inverse=True)
        out[name] = (used, summed_by(where, np.concatenate([grad for _, grad in found]), len(used)))
    return layers, out


def window_inputs(net: Network, vocabulary: Vocabulary, windows: list[np.ndarray]) -> tuple:
    """Inputs (step, window, d) and mask of windows, and what their words and n-grams are."""
    s = net.s
    ids, mask = np.zeros((s.window, len(windows)), np.int64), np.zeros((s.window, len(windows)), bool)
    for k, w in enumerate(windows):
        ids[: len(w), k], mask[: len(w), k] = w, True
    known, place = np.unique(ids[mask], return_inverse=True)
    grams, owner, count = vocabulary.grams_of(known)
    vectors = np.concatenate([net.w["words"][vocabulary.whole[known]], segment_sums(net.w["grams"][grams], owner, len(known)) / count[:, None]], 1)
    x = np.zeros((*mask.shape, vectors.shape[1]), np.float32)
    x[mask] = vectors[place]
    return x, mask, place, known, grams, owner, count


def fit(docs: DataFrame, labels: DataFrame, s: Shape = Shape()) -> Toxicity:
    """Trains on at most ``max_documents`` rows of ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic).

    Those with the least hashes of their ids are taken. Equal ids are told
    apart by their texts' hashes, so the sample and its order don't depend on
    how the tables are stored.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(s.seed))
    picked = known.orderBy(order, "doc_id").limit(s.max_documents)
    rows = docs.join(F.broadcast(picked), "doc_id")  # at most max_documents ids
    drawn = rows.select(order.alias("h"), "doc_id", F.xxhash64("text").alias("t"), F.col("text").cast("string").alias("text"), (F.col("toxic") > 0).cast("int").alias("y"))
    taken = drawn.orderBy("h", "doc_id", "t", "text").limit(s.max_documents).collect()  # at most max_documents texts
    return train((([words_of(r["text"] or "")], r["y"]) for r in taken), s)


def toxicity(text: Column, model: Toxicity, spark: SparkSession) -> Column:
    """The score of a whole text, from 0 to 1."""
    shared = spark.sparkContext.broadcast(model)  # the network's weights, bounded by its shape

    @tidy
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for batch in batches:
            out = [m.score(batch.slice(at, 500).to_pylist()) for at in range(0, len(batch), 500)]
            yield pa.array(np.concatenate(out) if out else [], pa.float64())

    return F.arrow_udf(score, "double")(text.cast("string"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    judged = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity(F.col("text"), model, spark).alias("score"))
    return judged.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
