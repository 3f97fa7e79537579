"""Language identification by averaged hashed subword embeddings.

A word's features are its hashed character n-grams and the word itself. A
text's vector is the average of its features' embeddings, a linear softmax
turns it into language probabilities. Embeddings and softmax are trained
together by stochastic gradient descent in numpy, on a bounded sample of
labelled rows, whose texts are read whole. A part of that sample is set aside to fit a temperature, so that
scores are probabilities, and a rejection limit: the least score at which the
accepted part of it reaches the wanted accuracy.

The model is linear in its features, so a word adds a fixed vector of logits;
scoring counts the words of a whole text and adds up what they give.

Defined results for odd input: a null text or one without a letter is ``und``
with score 0 and isn't accepted; very long texts are scored whole; repeated
rows get equal results; ties go to the language first in code point order;
without any labelled row all texts are ``und``; an empty table gives an empty
result. Null languages are not learned. Further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import table, tidy

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    #: Bound of the training sample: labelled documents, each learned from whole.
    max_documents: int = 4000
    buckets: int = 1 << 16
    dim: int = 16
    n_min: int = 1
    n_max: int = 4
    epochs: int = 6
    batch: int = 16
    rate: float = 2.0
    #: Times the rate at which embeddings move, since each has a small share of an average.
    spread: float = 50.0
    calibration_share: float = 0.2
    #: Accuracy that accepted texts should reach.
    wanted: float = 0.99
    seed: int = 7
    #: Words kept in a worker's cache.
    cache: int = 200_000


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes so that their low bits can be used."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def features(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the features of lower-case words, and the place of each one's word.

    A word's features are its n-grams between two marks, and the word itself.
    """
    marked = [f"<{w}>" for w in words]
    size = np.array([len(w) for w in marked])
    owner = np.repeat(np.arange(len(words)), size)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    whole = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in marked], np.uint64)
    ids, owners = [mixed(whole)], [np.arange(len(words))]
    h = codes
    for n in range(1, s.n_max + 1):
        if n > 1:
            h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if len(h) == 0:
            break
        if n >= s.n_min:
            inside = owner[: len(h)] == owner[n - 1 :]
            ids.append(mixed(h[inside] + np.uint64(n << 56)))
            owners.append(owner[: len(h)][inside])
    return (np.concatenate(ids) % np.uint64(s.buckets)).astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    #: What a feature adds to each language's logit, and the offsets.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept_from: float = 1.0
    _index: dict[str, int] = field(default_factory=dict, repr=False)
    _sums: np.ndarray | None = field(default=None, repr=False)

    def sums(self, words: list[str]) -> np.ndarray:
        """For each word what it adds to each logit, and last its number of features."""
        out = np.zeros((len(words), len(self.languages) + 1))
        if words:
            ids, owner = features(words, self.settings)
            for k in range(len(self.languages)):
                out[:, k] = np.bincount(owner, self.table[ids, k], len(words))
            out[:, -1] = np.bincount(owner, minlength=len(words))
        return out

    def logits(self, text: str) -> np.ndarray | None:
        words = Counter(WORD.findall(text.lower()))
        if not words or not self.languages or not any(map(has_letter, words)):
            return None
        if self._sums is None or len(self._index) + len(words) > len(self._sums):
            self._index, self._sums = {}, np.zeros((max(self.settings.cache, len(words)), len(self.languages) + 1))
        index = self._index
        if new := [w for w in words if w not in index]:
            at = len(index)
            self._sums[at : at + len(new)] = self.sums(new)
            index.update(zip(new, range(at, at + len(new)), strict=True))
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        total = np.fromiter(words.values(), np.float64, len(words)) @ self._sums[at]
        return total[:-1] / total[-1] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        logits = self.logits(text or "")
        if logits is None:
            return UNKNOWN, 0.0
        p = softmax(logits[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def has_letter(word: str) -> bool:
    return any(c.isalpha() for c in word)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(samples: list[tuple[list[str] | Counter, str]], s: Settings = Settings()) -> Model:
    """A model from (words, language) samples; words may be given as counts."""
    languages = sorted({y for _, y in samples})
    if not languages:
        return Model(s, [], np.zeros((s.buckets, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(s.seed)
    number = {y: k for k, y in enumerate(languages)}
    rows = [(*feature_counts(Counter(words), s), number[y]) for words, y in samples if words]
    order = rng.permutation(len(rows))
    n_held = int(len(rows) * s.calibration_share)
    held, learn = [rows[i] for i in order[:n_held]], [rows[i] for i in order[n_held:]]
    embed = rng.uniform(-1, 1, (s.buckets, s.dim)).astype(np.float32) / s.dim
    weight, bias = np.zeros((s.dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps = max(1, s.epochs * -(-len(learn) // s.batch))
    step = 0
    for _ in range(s.epochs):
        shuffled = rng.permutation(len(learn))
        for at in range(0, len(learn), s.batch):
            part = [learn[i] for i in shuffled[at : at + s.batch]]
            x, used = averaged(part)
            y = np.array([r[2] for r in part])
            hidden = x @ embed[used]
            off = softmax(hidden @ weight + bias)
            off[np.arange(len(part)), y] -= 1
            off /= len(part)
            rate = s.rate * (1 - step / steps)
            back = off @ weight.T
            weight -= rate * hidden.T @ off
            bias -= rate * off.sum(0)
            # an average moves by a share of what its features move
            embed[used] -= rate * s.spread * x.T @ back
            step += 1
    model = Model(s, languages, embed @ weight, bias.astype(np.float64))
    if held:
        calibrate(model, held)
    return model


def feature_counts(words: Counter, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text's words have features in, and how often each."""
    ids, owner = features(list(words), s)
    times = np.fromiter(words.values(), np.float64, len(words))
    used, at = np.unique(ids, return_inverse=True)
    return used, np.bincount(at, times[owner], len(used))


def averaged(part: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Dense rows of feature shares, over the features that occur in ``part``."""
    used, at = np.unique(np.concatenate([r[0] for r in part]), return_inverse=True)
    row = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
    share = np.concatenate([r[1] / r[1].sum() for r in part])
    x = np.zeros((len(part), len(used)), np.float32)
    x[row, at] = share
    return x, used


def calibrate(model: Model, held: list[tuple]) -> None:
    """Temperature by likelihood, then the least score that keeps the wanted accuracy."""
    logits = np.array([(r[1] / r[1].sum()) @ model.table[r[0]] + model.bias for r in held])
    y = np.array([r[2] for r in held])
    losses = {t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
    model.temperature = float(min(losses, key=losses.get))
    p = softmax(logits / model.temperature)
    score, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-score)
    accuracy = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(accuracy >= model.settings.wanted)
    model.accept_from = float(score[order][good[-1]]) if len(good) else 1.0


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: one in five by a checksum of the id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Trains on at most ``max_documents`` rows of ``docs`` (doc_id, text, lang).

    Those with the least hashes of their ids are picked by id alone; only their
    texts are read then. Equal ids are told apart by their texts' hashes, so
    the sample and its order don't depend on how the table is stored.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(s.seed))
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))  # a null text gives no words
    least = rows.select(order.alias("h"), "doc_id").orderBy("h", "doc_id").limit(s.max_documents)
    bound = least.agg(F.max("h")).first()[0]
    near = rows.where(order <= F.lit(bound)) if bound is not None else rows.limit(0)
    lang, text = F.col("lang").cast("string"), F.col("text").cast("string")
    drawn = near.select(order.alias("h"), "doc_id", F.xxhash64("text").alias("t"), lang.alias("lang"), text.alias("text"))
    picked = drawn.orderBy("h", "doc_id", "t", "lang", "text").limit(s.max_documents).collect()  # at most max_documents texts
    return train([(Counter(WORD.findall((r["text"] or "").lower())), r["lang"]) for r in picked], s)


PREDICTION = "struct<lang_pred:string,score:double,accepted:boolean>"


def language(text: Column, model: Model, spark: SparkSession) -> Column:
    """A struct of lang_pred, score and whether the score passes the rejection limit."""
    shared = spark.sparkContext.broadcast(model)  # buckets x languages numbers, bounded by the settings

    @tidy
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch]
            yield pa.array([{"lang_pred": y, "score": p, "accepted": y != UNKNOWN and p >= m.accept_from} for y, p in got], kind)

    return F.arrow_udf(predict, PREDICTION)(text.cast("string"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs)
    judged = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language(F.col("text"), model, spark).alias("p"))
    return judged.select("doc_id", "held_out", "p.*")
