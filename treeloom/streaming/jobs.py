"""Structured Streaming jobs over change events, publications and progress.

State is kept by key, in the shapes of :mod:`treeloom.operators.caches`. Times
are event times in microseconds; a watermark of no delay lets quiet keys flush.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from treeloom.operators.caches import CAP, ECHO, QUIET

#: Fixed value: microseconds after which a server that is still indexing counts as ready.
INDEXING_TIMEOUT = 120_000_000


def cut(times: list[int], items: list[str], begin: int | None, last: int | None, held: list[str], quiet: int, cap: int) -> tuple[list[tuple[int, list[str]]], int | None, int | None, list[str]]:
    """Follows events in order; (closed batches, begin, last, held) of the batch that is open."""
    done = []
    for t, item in zip(times, items, strict=True):
        if begin is not None and (t - last >= quiet or t >= begin + cap):
            done.append((begin, sorted(set(held))))
            begin = None
        if begin is None:
            begin, held = t, []
        last = t
        held = [*held, item] if item not in held else held
    return done, begin, last, held


def relevant(kind: str = "kind"):
    """Events that matter: created, removed, or modified other than in metadata."""
    return F.col(kind).isin("create", "remove", "modify")


def debounced(events: DataFrame, quiet: int = QUIET, cap: int = CAP) -> DataFrame:
    """(key, batch_start, items) of a stream (key, ts, item): batches close when quiet, or at their cap.

    Items are sets, so a repeated path counts once. A batch that stays open is
    flushed once the watermark has passed its quiet time.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, last, held = state.get if state.exists else (None, None, [])
        held, out = list(held), []
        if state.hasTimedOut:
            out = [(begin, sorted(set(held)))]
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values("at")
            done, begin, last, held = cut(rows["at"].tolist(), rows["item"].tolist(), begin, last, held, quiet, cap)
            out = done
            state.update((begin, last, held))
            wake = min(last + quiet, begin + cap) // 1000 + 1
            state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"key": key[0], "batch_start": [b for b, _ in out], "items": [i for _, i in out]})

    timed = events.select("key", "ts", F.unix_micros("ts").alias("at"), "item").withWatermark("ts", "0 seconds")
    return timed.groupBy("key").applyInPandasWithState(step, "key string, batch_start long, items array<string>", "begin long, last long, held array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def without_echoes(events: DataFrame, window: int = ECHO) -> DataFrame:
    """Changes of a stream (key, ts, is_write) that no own write of the last ``window`` explains; a write hides one."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (wrote,) = state.get if state.exists else (None,)
        out = []
        for at, write in pd.concat(list(frames)).sort_values(["at", "is_write"], ascending=[True, False])[["at", "is_write"]].itertuples(index=False):
            if write:
                wrote = at
            elif wrote is not None and at - wrote < window:
                wrote = None
            else:
                wrote = None
                out.append(at)
        state.update((wrote,))
        if out:
            yield pd.DataFrame({"key": key[0], "at": out})

    rows = events.select("key", F.unix_micros("ts").alias("at"), "is_write")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, at long", "wrote long", "append", GroupStateTimeout.NoTimeout)


def diagnostics(events: DataFrame) -> DataFrame:
    """(key, value, dirty) after each batch of a stream (key, ts, kind, value) of publications and marks: the store's state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, published, marked = state.get if state.exists else (None, None, None)
        for at, kind, new in pd.concat(list(frames)).sort_values("at")[["at", "kind", "value"]].itertuples(index=False):
            if kind == "publish":
                if published is None or at >= published:
                    value, published = new, at
            else:
                marked = at if marked is None else max(marked, at)
        state.update((value, published, marked))
        dirty = published is None or marked is not None and marked > published
        yield pd.DataFrame({"key": [key[0]], "value": [value], "dirty": [dirty]})

    rows = events.select("key", F.unix_micros("ts").alias("at"), "kind", "value")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, value string, dirty boolean", "value string, published long, marked long", "update", GroupStateTimeout.NoTimeout)


def indexing(events: DataFrame, quiet: int, timeout: int = INDEXING_TIMEOUT) -> DataFrame:
    """(key, ready_at): once for each server of a stream (key, ts, token, begins), when it has been
    quiet for ``quiet`` microseconds, or ``timeout`` after its first event, whichever comes first."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_, since, begun, ready = state.get if state.exists else ([], None, None, False)
        open_, found = set(open_), None
        due = lambda: begun + timeout if since is None else min(since + quiet, begun + timeout)
        if state.hasTimedOut:
            if not ready:
                found, ready = due(), True
        else:
            for at, token, begins in pd.concat(list(frames)).sort_values("at")[["at", "token", "begins"]].itertuples(index=False):
                begun = int(at) if begun is None else begun
                if not ready and at >= due():
                    found, ready = due(), True
                if begins:
                    open_.add(token)
                    since = None
                elif token in open_:
                    open_.discard(token)
                    since = int(at) if not open_ else None
        state.update((sorted(open_), since, begun, ready))
        if not ready:
            state.setTimeoutTimestamp(max(due() // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if found is not None:
            yield pd.DataFrame({"key": [key[0]], "ready_at": [found]})

    rows = events.select("key", "ts", F.unix_micros("ts").alias("at"), "token", "begins").withWatermark("ts", "0 seconds")
    return rows.groupBy("key").applyInPandasWithState(step, "key string, ready_at long", "open array<string>, since long, begun long, ready boolean", "append", GroupStateTimeout.EventTimeTimeout)


def generations(changes: DataFrame) -> DataFrame:
    """(path, generation): how often each path of a stream (path) and its parent were changed."""
    parent = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise("")
    return changes.select(F.explode(F.array_distinct(F.array("path", parent))).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("generation"))


def propagate(changes: DataFrame, handlers: list[Callable[[DataFrame], DataFrame]], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each batch of distinct paths to all handlers and the union of what they return to ``sink``."""

    def batch(df: DataFrame, epoch: int) -> None:
        paths = df.select("path").distinct().persist()
        out = None
        for h in handlers:
            made = h(paths)
            out = made if out is None else out.unionByName(made)
        sink(out.distinct(), epoch)
        paths.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
