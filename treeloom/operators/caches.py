"""What caches, watchers and stores hold, as tables: the batch form of the streaming operators.

Times are microseconds. The streaming jobs in ``treeloom.streaming`` are held
against these on finished streams.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, in microseconds: quiet time and longest batch of the watcher, how
#: long own writes are remembered, how long query results hold.
QUIET, CAP, ECHO, TTL = 50_000, 500_000, 2_000_000, 300_000_000


def generations(bumps: DataFrame, path: str) -> DataFrame:
    """(path, generation): how often each path was bumped."""
    return bumps.groupBy(path).agg(F.count(F.lit(1)).alias("generation"))


def bumped_paths(changes: DataFrame, path: str) -> DataFrame:
    """Each changed path and its parent: a change bumps both."""
    parent = F.when(F.col(path).contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("")
    return changes.select(F.explode(F.array_distinct(F.array(F.col(path), parent))).alias(path))


def valid(entries: DataFrame, current: DataFrame, path: str, stored: str) -> DataFrame:
    """Entries whose stored generation is their path's current one; paths never bumped are at 0."""
    now = current.select(F.col(path), F.col("generation").alias("__g"))
    return entries.join(now, path, "left").where(F.col(stored) == F.coalesce("__g", F.lit(0))).drop("__g")


def fresh(age: Column, ttl: int = TTL) -> Column:
    """Whether a result of this age still holds."""
    return age <= ttl


def quiet_runs(events: DataFrame, key: str, at: str, quiet: int) -> DataFrame:
    """``run``: the number of the run that each event is in; runs are ``quiet`` or more apart."""
    order = Window.partitionBy(key).orderBy(at)
    gap = F.when(F.col(at) - F.lag(at).over(order) >= quiet, 1).otherwise(0)
    return events.withColumn("__gap", gap).withColumn("run", F.sum("__gap").over(order)).drop("__gap")


def debounced(events: DataFrame, key: str, at: str, item: str, quiet: int = QUIET, cap: int = CAP) -> DataFrame:
    """(key, batch_start, items): batches end ``quiet`` after their last event or ``cap`` after their first.

    Runs are cut at quiet times first. A run shorter than the cap is one batch;
    only inside longer ones must the cap be followed event by event.
    """
    runs = quiet_runs(events.select(key, F.col(at).alias("at"), F.col(item).alias("item")), key, "at", quiet)
    whole = Window.partitionBy(key, "run")
    marked = runs.withColumns({"batch_start": F.min("at").over(whole), "__long": F.max("at").over(whole) - F.min("at").over(whole) >= cap})
    group = lambda df: df.groupBy(key, "batch_start").agg(F.array_sort(F.collect_set("item")).alias("items"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        starts, begin = [], None
        for t in pdf["at"]:
            if begin is None or t >= begin + cap:
                begin = t
            starts.append(begin)
        return pdf.assign(batch_start=starts)[[key, "batch_start", "item"]]

    columns = f"{key} {events.schema[key].dataType.simpleString()}, batch_start long, item {runs.schema['item'].dataType.simpleString()}"
    long = marked.where("__long").groupBy(key, "run").applyInPandas(cut, columns)
    return group(marked.where("not __long").select(key, "batch_start", "item").unionByName(long))


def without_echoes(events: DataFrame, key: str, at: str, is_write: Column, tie: str, window: int = ECHO) -> DataFrame:
    """Changes that aren't echoes: a write hides the next change of its path, if that comes within ``window``."""
    order = Window.partitionBy(key).orderBy(at, tie)
    write = F.coalesce(is_write, F.lit(False))
    echo = F.lag(write).over(order) & (F.col(at) - F.lag(at).over(order) < window)
    return events.withColumns({"__w": write, "__e": F.coalesce(echo, F.lit(False))}).where(~F.col("__w") & ~F.col("__e")).drop("__w", "__e")


def latest(publications: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, value, dirty): each key's last publication, and whether it was marked changed after it."""
    last = publications.groupBy(key).agg(F.max_by(value, at).alias(value), F.max(at).alias("published"))
    marked = marks.groupBy(key).agg(F.max(at).alias("marked"))
    return last.join(marked, key, "full").select(key, value, F.coalesce(F.col("marked") > F.col("published"), F.col("published").isNull()).alias("dirty"))


def pulled_or_published(pulled: DataFrame, published: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): what a server answered when asked, else what it published last.

    ``pulled`` has (key, kind, value): a ``full`` answer counts, any other kind
    (unchanged, partial) gives null, the empty result. Keys that weren't asked
    for take the value of ``published`` (see :func:`latest`).
    """
    asked = pulled.select(key, F.lit(True).alias("__asked"), F.when(F.col("kind") == "full", F.col(value)).alias("__pulled"))
    both = asked.join(published.select(key, value), key, "full")
    return both.select(key, F.when(F.col("__asked"), F.col("__pulled")).otherwise(F.col(value)).alias(value))


def ready_times(progress: DataFrame, key: str, at: str, token: str, begins: Column, quiet: int) -> DataFrame:
    """(key, ready_at): when a server has first been without open tokens for ``quiet``; null if never before its last event.

    A token that begins twice is open once, and an end without a beginning
    doesn't count.
    """
    by_token = Window.partitionBy(key, token).orderBy(at)
    turned = progress.withColumn("__open", begins.cast("int")).withColumn("__was", F.coalesce(F.lag("__open").over(by_token), F.lit(0)))
    step = F.col("__open") - F.col("__was")
    order = Window.partitionBy(key).orderBy(at, token)
    running = turned.withColumn("__step", step).where("__step <> 0").withColumn("open", F.sum("__step").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead(at).over(order))
    still = (F.col("open") == 0) & (F.col("next") - F.col(at) >= quiet)
    return running.groupBy(key).agg(F.min(F.when(still, F.col(at) + quiet)).alias("ready_at"))


def indexing_states(rows: Iterator[tuple[int, str, bool]], quiet: int, timeout: int) -> list[tuple[int, str]]:
    """The states (time, name) of one server's tracker for its progress in order, for tests and streams."""
    out, open_, since, begun, ready = [], set(), None, None, False
    for at, token, begins in rows:
        if begun is None:
            begun = at
        if not ready and since is not None and at - since >= quiet:
            out.append((since + quiet, "ready"))
            ready = True
        if not ready and at - begun >= timeout:
            out.append((begun + timeout, "ready"))
            ready = True
        if begins:
            open_.add(token)
            since = None
        elif token in open_:
            open_.discard(token)
            since = at if not open_ else None
        out.append((at, "ready" if ready else "indexing" if open_ else "quiescent"))
    return out


def followed(rows: DataFrame, key: str, order: list[str], columns: list[str], start: Callable[[], object], step: Callable, outcome: str, kind: str) -> DataFrame:
    """``rows`` with ``outcome``: what ``step(state, *columns)`` says of each row, called in ``order`` within ``key``.

    For states that no window can express. Rows stream through in Arrow
    batches, sorted by Spark; a task holds one batch and the state of one key,
    however many rows the key has. ``order`` has no ties.
    """
    schema = rows.schema.add(outcome, kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, began = None, None, False
        for batch in batches:
            out = []
            for now, *values in zip(*[batch[c].tolist() for c in (key, *columns)], strict=True):
                if not began or now != at:
                    at, state, began = now, start(), True
                out.append(step(state, *values))
            yield batch.assign(**{outcome: pd.Series(out, index=batch.index, dtype=object)})

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def lru_hits(reads: DataFrame, cache: str, at: str, key: str, capacity: int = 4096) -> DataFrame:
    """``reads`` with ``hit``: whether a cache of the ``capacity`` last used keys holds the key. Keys without a value are held too."""

    def step(held: OrderedDict, k: object) -> bool:
        hit = k in held
        held[k] = None
        held.move_to_end(k)
        if len(held) > capacity:
            held.popitem(last=False)
        return hit

    return followed(reads, cache, [at], [key], OrderedDict, step, "hit", "boolean")


def timed_hits(reads: DataFrame, node: str, at: str, ttl: int | None) -> DataFrame:
    """``reads`` with ``hit``: whether the node's content is still held from the read that last fetched it.

    Without ``ttl`` the first read is held for good; at 0 nothing is held. A
    hit doesn't make the content any younger, so what is fetched next depends
    on every read before it.
    """
    if ttl == 0:
        return reads.withColumn("hit", F.lit(False))
    if ttl is None:
        return reads.withColumn("hit", F.row_number().over(Window.partitionBy(node).orderBy(at)) > 1)

    def step(state: dict, t: int) -> bool:
        hit = "since" in state and t - state["since"] < ttl
        if not hit:
            state["since"] = t
        return hit

    return followed(reads, node, [at], [at], dict, step, "hit", "boolean")


def bound_hits(ops: DataFrame, inode: str, at: str, kind: str, ttl: int) -> DataFrame:
    """``ops`` with ``hit``: whether a ``lookup`` finds the node that was bound; null for other operations.

    A ``bind`` and each ``touch`` (open or release) make it last ``ttl`` more;
    lookups don't. A binding that ran out goes when it is looked up; a touch
    before that revives it.
    """

    def step(state: dict, t: int, what: str) -> bool | None:
        if what == "bind" or (what == "touch" and "until" in state):
            state["until"] = t + ttl
        if what != "lookup":
            return None
        hit = "until" in state and t <= state["until"]
        if not hit:
            state.clear()
        return hit

    return followed(ops, inode, [at], [at, kind], dict, step, "hit", "boolean")


def listing_hits(ops: DataFrame, at: str, kind: str, path: str, target: str) -> DataFrame:
    """(path, at, hit) of each ``readdir``: whether the folder's listing is held.

    Creating, making, removing and renaming in a folder let its listing go, as
    does renaming into it (``target``); an outside ``change`` lets that of the
    path and of its parent go. So a listing is held if the folder's last
    operation was to read it.
    """
    parent = F.when(F.col(path).contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("")
    touched = F.when(F.col(kind) == "rename", F.array_distinct(F.array(F.col(path), F.coalesce(target, path)))).when(F.col(kind) == "change", F.array_distinct(F.array(F.col(path), parent))).otherwise(F.array(path))
    each = ops.where(F.col(kind).isin("readdir", "create", "mkdir", "remove", "rename", "change")).select(F.explode(touched).alias("path"), F.col(at).alias("at"), F.col(kind).alias("__kind"))
    last = F.lag("__kind").over(Window.partitionBy("path").orderBy("at"))
    return each.withColumn("hit", F.coalesce(last == "readdir", F.lit(False))).where("__kind = 'readdir'").drop("__kind")


def documents_open(ops: DataFrame, path: str, at: str, kind: str, readable: str) -> DataFrame:
    """``ops`` with (open, version, sent): what a server has been told of a document after each operation.

    ``access`` opens it at version 0, if it can be read; each ``change`` of an
    open document sends the next version, or closes it if it can't be read any
    more; ``close`` closes it. What says nothing to the server sends null.
    """
    order = Window.partitionBy(path).orderBy(at)
    shut = (F.col(kind) == "close") | ((F.col(kind) == "change") & ~F.col(readable))
    life = F.coalesce(F.sum(F.when(shut, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opens = (F.col(kind) == "access") & F.col(readable)
    within = Window.partitionBy(path, "__life").orderBy(at)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.bool_or(opens).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    marked = ops.withColumn("__life", life).withColumn("__before", before)
    version = F.sum(F.when(F.col("__before") & (F.col(kind) == "change"), 1).otherwise(0)).over(so_far)
    is_open = (F.col("__before") | opens) & ~shut
    sent = F.when(F.col("__before") & shut, "close").when(~F.col("__before") & opens, "open").when(F.col("__before") & (F.col(kind) == "change"), "change")
    return marked.withColumns({"open": is_open, "version": F.when(is_open, version), "sent": sent}).drop("__life", "__before")


def flushes(ops: DataFrame, handle: str, at: str, kind: str) -> DataFrame:
    """(handle, at, writes, cleared) of each ``clear``: whether it leaves the buffer clean.

    It does if nothing was written since the ``snapshot`` before it; else what
    was written in the meantime (``writes``) would be lost, so the buffer stays
    dirty. A clear without a snapshot clears nothing.
    """
    order = Window.partitionBy(handle).orderBy(at)
    snap = F.max(F.when(F.col(kind) == "snapshot", F.col(at))).over(order)
    marked = ops.withColumn("__snap", snap)
    since = F.sum(F.when(F.col(kind) == "write", 1).otherwise(0)).over(Window.partitionBy(handle, "__snap").orderBy(at))
    done = marked.withColumn("writes", since).where(F.col(kind) == "clear")
    return done.select(handle, at, "writes", (F.col("__snap").isNotNull() & (F.col("writes") == 0)).alias("cleared"))
