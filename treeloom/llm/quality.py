"""Quality rules on word statistics and compression bands.

A text is first held against two word rules (too few words, too many words in
repeated three-word windows). What passes is compressed with zstandard, once
as a whole and once in fixed chunks. The ratio compressed/raw of repetitive
text is low, that of text without redundancy (encoded or random bytes) high;
the limits depend on the length, since short inputs compress less.

Defined results for odd input: a null or empty text has no words, all counts
are 0 and it fails the word rules; a text of one long word is one word; very
long texts are compressed whole. Rows are judged one by one, so repeated rows
get equal results, an empty table gives an empty one, and further columns pass
through untouched (the added column has a name of the caller's choice).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import fresh, table, tidy

#: Characters counted as symbols, and ASCII white space.
SYMBOLS = b"#*$%&|<>"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

SIGNAL_TYPE = (
    "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
    "base_failed:boolean,whole_ratio:double,n_chunks:bigint,n_chunks_outside:bigint,kept:boolean>"
)


@dataclass(frozen=True)
class Bands:
    """Limits of the word rules and of the compression ratios.

    ``limits`` lists (shortest length in bytes, least ratio, greatest ratio);
    the last entry whose length isn't above the input's holds. Inputs shorter
    than the first entry have no limits.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    chunk_bytes: int = 4096
    max_chunks_outside: float = 0.5
    level: int = 3
    limits: tuple[tuple[int, float, float], ...] = ((128, 0.30, 1.10), (512, 0.25, 0.85), (2048, 0.20, 0.75), (8192, 0.15, 0.70))

    def outside(self, n_bytes: int, ratio: float) -> bool:
        found = None
        for least, low, high in self.limits:
            if n_bytes >= least:
                found = (low, high)
        return found is not None and not found[0] <= ratio <= found[1]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers, from 0 in order of appearance."""
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window found at least twice."""
    if len(ids) < 4:
        return 0
    n = int(ids.max()) + 1
    pairs = ids[:-2] * n + ids[1:-1]
    if n >= 1 << 21:  # three numbers don't fit in 63 bits; number the pairs first
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    windows = pairs * n + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = np.diff(windows[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= twice
    return int(covered.sum())


def text_signals(text: bytes, bands: Bands, compress) -> dict:
    words = text.split()  # bytes split at ASCII white space only
    n_words = len(words)
    n_chars = len(text.decode("utf-8"))
    n_space = len(text) - len(text.translate(None, SPACE_BYTES))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    n_repeat = repeated_words(word_ids(words))
    base_failed = n_words < bands.min_words or 100 * n_repeat > bands.max_repeat_percent * n_words
    whole, n_chunks, n_outside = None, 0, 0
    if text:
        whole = len(compress(text)) / len(text)
        for start in range(0, len(text), bands.chunk_bytes):
            chunk = text[start : start + bands.chunk_bytes]
            n_chunks += 1
            ratio = whole if len(chunk) == len(text) else len(compress(chunk)) / len(chunk)
            n_outside += bands.outside(len(chunk), ratio)
    kept = not (base_failed or bands.outside(len(text), whole) or n_outside > bands.max_chunks_outside * n_chunks)
    return {
        "n_words": n_words,
        "word_chars": n_chars - n_space,
        "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "whole_ratio": whole,
        "n_chunks": n_chunks,
        "n_chunks_outside": n_outside,
        "kept": kept,
    }


def quality_signals(text: Column, bands: Bands = Bands()) -> Column:
    """A struct of word counts, compression ratios and the verdict ``kept``."""

    @tidy
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress
        for batch in batches:
            raw = (t.as_py() for t in batch.cast(pa.binary()))  # one text at a time
            yield pa.array([text_signals(t or b"", bands, compress) for t in raw], ARROW_SIGNALS)

    return F.arrow_udf(judge, SIGNAL_TYPE)(text.cast("string"))


ARROW_SIGNALS = pa.struct(
    [(n, {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[t]) for n, t in (x.split(":") for x in SIGNAL_TYPE[7:-1].split(","))]
)


def quality_filter(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they came with."""
    name = fresh("signals", docs)
    judged = docs.withColumn(name, quality_signals(F.col(f"`{text}`"), bands))
    return judged.where(F.col(f"{name}.kept")).drop(name)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    judged = docs.select("doc_id", quality_signals(F.col("text")).alias("s"))
    return judged.select("doc_id", "s.*")
