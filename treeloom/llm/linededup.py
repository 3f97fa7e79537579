r"""Incremental line deduplication that can be taken back.

A line's key is the line without ASCII white space at its ends and with A-Z in
lower case. A key of at least ten code points that two or more documents hold
stays only in the document with the smallest id.

The index has these tables in the shared folder, each a list of versions:

``docs``
    (doc_id, keys), as documents came: what makes deletions exact.
``filters``
    a cuckoo filter for each shard of the key space, holding one print for
    every key that some live document has. Most keys have one holder; the
    filter is all that is asked about them.
``singles``
    (key, keeper) of keys that came new with one holder, by shard.
``refs``
    exact reference counts, with the keeper, of keys that reached two holders
    or lost some, by shard. A later version of a key replaces the earlier.

Inserting groups a batch by key and asks the shards' filters which keys may be
known. New keys go to the filters and, with one holder, to the singles. For those
that may be known the exact counts are looked up, in the shards that have such
keys and nowhere else, and the batch's holders are added to them; nothing is
counted anew from the documents. A key that a filter only seemed to know gets its
own print once no count was found. Deleting reads the files that hold the deleted
documents, takes their holders off the counts of their keys and keys without
holders out of the filters; only where a keeper went are the other documents
searched for the next one. Shards hold distinct keys, so a line that every
document has is one row there; when the shards hold twice as many keys as they
should, filters and counts are dealt anew, in greater number, which also joins
the versions. The query and the pipeline insert their documents in ``BATCHES``
batches, so that the filters decide which keys of the later ones are looked up.

Defined results for odd input: a null or empty text is one empty line; very
long texts are split whole; rows with the same doc_id are one document; a null
doc_id is one document that comes after all others; an empty table gives an
empty result; other columns pass through. Inserting an id that the index holds is
an error, and deleting one that it doesn't hold changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import SPACE, fresh, looked_up, scratch, table, tidy
from treeloom.llm.cuckoo import CuckooFilter, Full

MIN_CODE_POINTS = 10
#: Insertions that the query and the pipeline deal their documents into.
BATCHES = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def key_digest(key: Column) -> Column:
    """The first 16 bytes of the key's SHA-256."""
    return F.unhex(F.substring(F.sha2(key.cast("binary"), 256), 1, 32))


def python_digest(line: bytes) -> bytes:
    """The digest of a line's key, as :func:`key_digest` makes it."""
    return hashlib.sha256(line.strip(SPACE.encode()).translate(FOLD)).digest()[:16]


def keys_of(docs: DataFrame, least: int = MIN_CODE_POINTS) -> DataFrame:
    """(doc_id, keys): the digests of each row's keys, each once."""
    keys = F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), line_key)
    long_enough = F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= least))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(long_enough, key_digest).alias("keys"))


CHANGES = "kind string, shard int, key binary, refs long, keeper long, filter binary, prints long"
DOCS = "doc_id long, keys array<binary>, batch int, version int"
COUNTS = "key binary, refs long, keeper long, version int, shard int"
FILTERS = "shard int, filter binary, prints long"


def stored(shard: int, kept: CuckooFilter | None, prints: int) -> pd.DataFrame:
    """A row of the filters; without a filter if it must be rebuilt."""
    return pd.DataFrame({"shard": [np.int32(shard)], "filter": [kept.to_bytes() if kept is not None else None], "prints": [prints]})


def in_shard(shard: tuple, keys: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
    """What a batch changes in one shard: ``new`` and ``known`` keys, and the new ``filter``.

    ``keys`` has (key, refs, keeper) as the batch alone has them.
    """
    kept = CuckooFilter.from_bytes(state["filter"].iloc[0]) if len(state) else CuckooFilter(2 * len(keys))
    digests = [bytes(k) for k in keys["key"]]
    known = kept.contains(digests)
    new = [k for k, old in zip(digests, known, strict=True) if not old]
    prints = len(kept) + len(new)
    try:
        kept.insert(new)
    except Full:
        kept = None  # to be rebuilt from the counts
    rows = pd.DataFrame({"kind": np.where(known, "known", "new"), "shard": np.int32(shard[0]), "key": keys["key"], "refs": keys["refs"], "keeper": keys["keeper"].astype("Int64"), "filter": None, "prints": pd.array([None] * len(keys), "Int64")})
    last = stored(shard[0], kept, prints).assign(kind="filter", key=None, refs=0, keeper=pd.array([None], "Int64"))
    return pd.concat([rows, last[rows.columns]], ignore_index=True)


class LineIndex:
    """The tables of one index under ``path``; versions are numbered from 1."""

    def __init__(self, spark: SparkSession, path: str, keys_per_shard: int = 250_000, least: int = MIN_CODE_POINTS) -> None:
        self.spark, self.path, self.keys_per_shard, self.least = spark, path, keys_per_shard, least
        self.shards, self.version, self.files = 0, 0, 0
        self.docs_paths: list[str] = []
        self.singles_paths: list[str] = []
        self.refs_paths: list[str] = []
        self.filters_path: str | None = None
        self.dead_paths: list[str] = []
        self.read_shards: list[int] | None = []  #: shards whose counts the last change read

    def _write(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> str:
        self.files += 1
        path = f"{self.path}/{name}/run={self.files}"
        df.write.partitionBy(*by).parquet(path)
        return path

    def _there(self, path: str) -> list[str]:
        """The path, if anything was written there: partitions without rows have no folder."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return [path] if where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where) else []

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _by_shard(self, paths: list[str], shards: list[int] | None) -> DataFrame:
        """Counts (key, refs, keeper, version) of the named shards (None: all), from no other folder."""
        if not paths:
            return self._read([], COUNTS).drop("shard")
        rows = self.spark.read.schema(COUNTS).option("basePath", paths[0].split("/run=")[0]).parquet(*paths)
        return (rows if shards is None else rows.where(F.col("shard").isin(shards))).select("key", "refs", "keeper", "version")

    def _shard(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int"))

    def _write_counts(self, df: DataFrame, name: str, version: int, kind: str = "count") -> list[str]:
        """Counts (key, refs, keeper) of a version, a folder for each shard."""
        rows = self._shard(df).withColumns({"version": F.lit(version), "kind": F.lit(kind)})
        return self._there(f"{self._write(rows.repartition('shard'), name, ('kind', 'shard'))}/kind={kind}")

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows of ``docs`` whose documents haven't been deleted."""
        if not self.dead_paths:
            return rows.select("doc_id", "keys")
        dead = self._read(self.dead_paths, "dead_id long, until int").groupBy("dead_id").agg(F.max("until").alias("until"))
        alive = rows.join(dead, F.col("doc_id").eqNullSafe(F.col("dead_id")) & (F.col("version") <= F.col("until")), "left_anti")
        return alive.select("doc_id", "keys")

    def docs(self) -> DataFrame:
        """(doc_id, keys) of live documents."""
        return self._alive(self._read(self.docs_paths, DOCS))

    def postings(self) -> DataFrame:
        """(key, doc_id) of live documents, each pair once."""
        return self.docs().select(F.explode("keys").alias("key"), "doc_id").dropDuplicates(["key", "doc_id"])

    def _latest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.max_by(F.struct("refs", "keeper"), "version").alias("r")).select("key", "r.*")

    def refs(self) -> DataFrame:
        """(key, refs, keeper) of keys that at least two live documents hold."""
        rows = self._by_shard(self.refs_paths, None)
        return (self._latest(rows) if len(self.refs_paths) > 1 else rows).where("refs > 1").select("key", "refs", "keeper")

    def counts(self, keys: DataFrame | None = None) -> DataFrame:
        """(key, refs, keeper) as last counted, of all live keys or of ``keys`` (key, shard) alone, whose shards are all that is read."""
        if keys is None:
            return self._latest(self._by_shard(self.singles_paths, None).unionByName(self._by_shard(self.refs_paths, None))).where("refs > 0")
        self.read_shards = sorted(r["shard"] for r in keys.select("shard").distinct().collect())
        rows = self._by_shard(self.singles_paths, self.read_shards).unionByName(self._by_shard(self.refs_paths, self.read_shards))
        return self._latest(rows.join(keys.select("key"), "key", "left_semi")).where("refs > 0")

    def filters(self) -> DataFrame:
        return self._read([self.filters_path] if self.filters_path else [], FILTERS)

    def insert(self, docs: DataFrame, batches: int = 1) -> None:
        """Adds documents (doc_id, text) whose ids the index doesn't hold yet, in as many ``batches``.

        Texts are read once; a batch is the documents whose ids hash alike.
        """
        dealt = F.pmod(F.xxhash64("doc_id", F.lit("batch")), F.lit(batches)).cast("int")
        path = self._write(keys_of(docs, self.least).withColumn("batch", dealt).withColumn("version", F.lit(self.version + batches)), "docs")
        came = self._read([path], DOCS)
        ids = came.select("doc_id")
        if self.docs_paths and ids.join(self.docs().select(F.col("doc_id").alias("old")), F.col("doc_id").eqNullSafe(F.col("old")), "left_semi").limit(1).count():
            raise ValueError("the index already holds some of these documents; delete them first")
        self.docs_paths.append(path)
        repeated = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
        for k in range(batches):
            postings = came.where(F.col("batch") == k).select(F.explode("keys").alias("key"), "doc_id")
            self._insert(postings.dropDuplicates(["key", "doc_id"]) if repeated else postings)  # within a row keys are distinct

    def _insert(self, postings: DataFrame) -> None:
        self.version += 1
        grouped = postings.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("keeper"))
        batch = self._read([self._write(grouped, "batch")], "key binary, refs long, keeper long")
        self._make_room(batch.count())
        asked = self._shard(batch).groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(in_shard, CHANGES)
        # New keys with one holder are counted by that; they lie in a folder of their own.
        kind = F.when((F.col("kind") == "new") & (F.col("refs") == 1), "single").otherwise(F.col("kind"))
        changed = self._write(asked.withColumn("kind", kind).withColumn("version", F.lit(self.version)), "changes", ("kind", "shard"))
        changes = self._read([changed], "kind string, shard int, key binary, refs long, keeper long, filter binary, prints long, version int")
        known = changes.where("kind = 'known'").select("key", "shard", "refs", "keeper")
        old = self.counts(known).select("key", F.col("refs").alias("held"), F.col("keeper").alias("first"))
        added = known.join(old, "key", "left").select("key", (F.col("refs") + F.coalesce("held", F.lit(0))).alias("refs"), F.least("keeper", "first").alias("keeper"), F.col("held").isNull().alias("seeming"))
        fresh_ = changes.where("kind = 'new'").select("key", "refs", "keeper", F.lit(False).alias("seeming"))
        counted = self._write_counts(added.unionByName(fresh_), "refs", self.version)
        self.singles_paths += self._there(f"{changed}/kind=single")
        self.refs_paths += counted
        self._store_filters(changes, self._read(counted, COUNTS + ", seeming boolean").where("seeming").select("key"))

    def _make_room(self, arriving: int) -> None:
        """Shards for what is held and ``arriving``; more of them once they hold twice what they should."""
        if not self.shards:
            self.shards = max(8, -(-arriving // self.keys_per_shard))
            return
        held = self.filters().agg(F.coalesce(F.sum("prints"), F.lit(0))).first()[0] + arriving
        if held > 2 * self.keys_per_shard * self.shards:
            self.shards = -(-held // self.keys_per_shard)
            self._rebuild(None)

    def _store_filters(self, changes: DataFrame, seeming: DataFrame) -> None:
        """The shards' new filters: those of ``changes``, old ones where a shard had no key,
        with prints for keys that only seemed known, rebuilt ones where full."""
        made = changes.where("kind = 'filter'").select("shard", "filter", "prints")
        quiet = self.filters().join(made.select("shard"), "shard", "left_anti")
        state = made.unionByName(quiet)

        def again(shard: tuple, keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            if not len(keys) or old["filter"].iloc[0] is None:
                return old[["shard", "filter", "prints"]]
            kept, prints = CuckooFilter.from_bytes(old["filter"].iloc[0]), int(old["prints"].iloc[0]) + len(keys)
            try:
                kept.insert([bytes(k) for k in keys["key"]])
            except Full:
                kept = None
            return stored(shard[0], kept, prints)

        if seeming.limit(1).count():
            state = self._shard(seeming).groupBy("shard").cogroup(state.groupBy("shard")).applyInPandas(again, FILTERS)
        self.filters_path = self._write(state, "filters")
        full = self.filters().where(F.col("filter").isNull()).select("shard")
        if full.limit(1).count():
            self._rebuild(full)

    def _rebuild(self, full: DataFrame | None) -> None:
        """Twice the room for the named shards, from the counts. For None all shards are dealt anew, and the counts with them, all versions in one."""

        def build(shard: tuple, keys: pd.DataFrame) -> pd.DataFrame:
            digests, room = [bytes(k) for k in keys["key"]], 2 * len(keys)
            while True:
                kept = CuckooFilter(room)
                try:
                    kept.insert(digests)
                    return stored(shard[0], kept, len(digests))
                except Full:
                    room *= 2

        if full is None:
            live = self._read([self._write(self.counts(), "live")], "key binary, refs long, keeper long")
            last = self.version - 1  # what a batch under way will count is later
            self.singles_paths = self._write_counts(live.where("refs = 1"), "changes", last, "single")
            self.refs_paths = self._write_counts(live.where("refs > 1"), "refs", last)
            keys = self._shard(live.select("key"))
        else:
            named = [r["shard"] for r in full.select("shard").collect()]
            rows = self._by_shard(self.singles_paths, named).unionByName(self._by_shard(self.refs_paths, named))
            keys = self._shard(self._latest(rows).where("refs > 0").select("key"))
        state = keys.groupBy("shard").applyInPandas(build, FILTERS)
        if full is not None:
            state = state.unionByName(self.filters().where(F.col("filter").isNotNull()))
        self.filters_path = self._write(state, "filters-rebuilt")

    def delete(self, ids: DataFrame) -> None:
        """Takes documents (doc_id) out; the index is then as if they had never come."""
        self.version += 1
        gone = ids.select(F.col("doc_id").cast("long").alias("dead_id")).distinct()
        dead = self._write(gone.withColumn("until", F.lit(self.version)), "dead")
        gone = self._read([dead], "dead_id long, until int").select("dead_id")
        of_gone = F.col("doc_id").eqNullSafe(F.col("dead_id"))
        # Ids alone tell which files have the documents; keys are read from those.
        live = [r[0] for r in self._read(self.docs_paths, DOCS).select("doc_id", F.col("_metadata.file_path").alias("file")).join(gone, of_gone, "left_semi").select("file").distinct().collect()]
        within = self._alive(self._read(live, DOCS)).join(gone, of_gone, "left_semi")
        lost = within.select(F.explode("keys").alias("key"), "doc_id").dropDuplicates(["key", "doc_id"])
        lost = self._read([self._write(lost, "lost")], "key binary, doc_id long")
        fewer = self._shard(lost.groupBy("key").agg(F.count(F.lit(1)).alias("gone")))
        now = fewer.join(self.counts(fewer), "key").select("key", (F.col("refs") - F.col("gone")).alias("refs"), "keeper")
        went = lost.select(F.col("key").alias("of"), F.col("doc_id").alias("was"))
        marked = now.join(went, (F.col("key") == F.col("of")) & F.col("keeper").eqNullSafe(F.col("was")), "left").select("key", "refs", "keeper", (F.col("of").isNotNull() & (F.col("refs") > 0)).alias("bereft"))
        marked = self._read([self._write(marked, "marked")], "key binary, refs long, keeper long, bereft boolean")
        self.dead_paths.append(dead)
        bereft = marked.where("bereft")
        if bereft.limit(1).count():  # the next keepers are among the documents that are left
            heirs = self.docs().select(F.explode("keys").alias("key"), "doc_id").join(bereft.select("key"), "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("heir"))
            marked = marked.join(heirs, "key", "left").withColumn("keeper", F.when(F.col("bereft"), F.col("heir")).otherwise(F.col("keeper")))
        counted = self._write_counts(marked.select("key", "refs", "keeper"), "refs", self.version)
        self.refs_paths += counted
        gone_keys = self._shard(self._read(counted, COUNTS).where("refs = 0").select("key"))

        def drop(shard: tuple, keys: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
            kept = CuckooFilter.from_bytes(old["filter"].iloc[0])
            kept.delete([bytes(k) for k in keys["key"]])
            return stored(shard[0], kept, int(old["prints"].iloc[0]) - len(keys))

        self.filters_path = self._write(gone_keys.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(drop, FILTERS), "filters")

    def drops(self) -> DataFrame:
        """(doc_id, keys): the keys whose lines each document loses."""
        refs = self.refs().select("key", F.struct("keeper").alias("keeper"), "refs")
        held = looked_up(self.docs().select(F.explode("keys").alias("key"), "doc_id"), refs, "key", "keeper", "refs", 1 + refs.agg(F.coalesce(F.sum("refs"), F.lit(0))).first()[0], "doc_id")
        lost = held.where(F.col("keeper").isNotNull() & ~F.col("keeper.keeper").eqNullSafe(F.col("doc_id")))
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))  # at most the lines of the document


CUT = "struct<n_lines:bigint,n_dropped:bigint,kept_sha256:string,text:string>"


def without(text: Column, keys: Column, with_text: bool) -> Column:
    """Drops the lines of ``text`` whose key digest is among ``keys``."""

    @tidy
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())])
        for texts, drops in batches:
            rows = []
            for t, k in zip(texts.cast(pa.binary()), drops, strict=True):
                raw = t.as_py() or b""
                n_lines, n_dropped = raw.count(b"\n") + 1, 0
                if k.is_valid:
                    lost = set(k.as_py())
                    lines = [x for x in raw.split(b"\n") if python_digest(x) not in lost]
                    n_dropped = n_lines - len(lines)
                    raw = b"\n".join(lines)
                rows.append((n_lines, n_dropped, hashlib.sha256(raw).hexdigest(), raw.decode() if with_text and t.is_valid else None))
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * 4, kind, strict=True)], fields=list(kind))

    return F.arrow_udf(cut, CUT)(text.cast("string"), keys)


def deduplicated(docs: DataFrame, drops: DataFrame, with_text: bool = True) -> DataFrame:
    """``docs`` with a struct column ``cut_`` (or the next free name): n_lines, n_dropped, kept_sha256, text."""
    key, keys = fresh("cut_id", docs), fresh("cut_keys", docs)
    lost = drops.select(F.col("doc_id").alias(key), F.col("keys").alias(keys))
    joined = docs.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col(key)), "left")
    return joined.withColumn(fresh("cut_", docs), without(F.col("text"), F.col(keys), with_text)).drop(key, keys)


def index_of(docs: DataFrame) -> LineIndex:
    index = LineIndex(docs.sparkSession, scratch(docs.sparkSession, "lines"))
    index.insert(docs, BATCHES)
    return index


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    cut = deduplicated(docs, index_of(docs).drops(), with_text=False)
    return cut.select("doc_id", "cut_.n_lines", "cut_.n_dropped", "cut_.kept_sha256")


OP3_SQL = r"""
WITH lines AS (
  SELECT d.doc_id, u.nth, d.parts[u.nth] AS line,
         translate(trim(d.parts[u.nth], E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d, unnest(range(1, len(d.parts) + 1)) AS u(nth)
), shared AS (
  SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.nth, l.line, (s.key IS NOT NULL AND s.keeper <> l.doc_id) AS lost FROM lines l LEFT JOIN shared s ON s.key = l.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(lost AS INTEGER)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lost lines taken out of ``text``; ``n_chars``, where there is one, is counted anew."""
    cut = deduplicated(docs, index_of(docs.select("doc_id", "text")).drops())
    text = F.col(fresh("cut_", docs))["text"]
    new = {"text": text} | ({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
