"""Line deduplication against plain Python, and that insertions can be taken back."""

import hashlib

import numpy as np
import pytest

from treeloom.llm.common import scratch
from treeloom.llm.cuckoo import CuckooFilter, Full
from treeloom.llm.linededup import LineIndex, dedup_lines, deduplicated, index_of, python_digest

SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows):
    """rows: (doc_id, text), ids may repeat. Returns sorted result rows."""
    rank = lambda i: (i is None, i or 0)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 10:
                holders.setdefault(key_of(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key_of(x), ())) > 1 and min(h, key=rank) != i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=lambda r: (rank(r[0]), r[1:]))


def run(spark, rows, schema="doc_id long, text string"):
    docs = spark.createDataFrame(rows, schema)
    cut = deduplicated(docs, index_of(docs.select("doc_id", "text")).drops())
    got = cut.select("doc_id", "cut_.n_lines", "cut_.n_dropped", "cut_.kept_sha256").collect()
    return sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


LONG = "A line that many documents share"
ROWS = [
    (3, f"{LONG}\nonly in three, this line\n\n"),
    (1, f"  {LONG.upper()}\t\nshort\nshort"),
    (2, f"{LONG}\n{LONG}\nshort"),
    (2, f"another row of two\n{LONG}"),
    (7, None),
    (8, ""),
    (None, f"{LONG}\nonly in three, this line"),
    (None, "ÄÖÜ is not folded, line"),
    (9, "äöü is not folded, line\x0b"),
    (10, " " + LONG),
    (11, LONG + "\n" + "x" * 100_000),
    (12, "x" * 100_000),
    (13, "ten chars!\nnine char"),
    (14, "ten chars!\nnine char"),
]


def test_matches_plain_python(spark):
    assert run(spark, ROWS) == plain(ROWS)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_other_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, LONG, "a"), (2, LONG, "b")], "doc_id long, text string, keys string").withColumnRenamed("keys", "cut_id")
    cut = deduplicated(docs, index_of(docs.select("doc_id", "text")).drops())
    assert {(r["doc_id"], r["cut_id"], r["cut_"]["text"]) for r in cut.collect()} == {(1, "a", LONG), (2, "b", "")}


def test_whole_documents_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, LONG, 0, "a"), (2, f"{LONG}\nown", 0, "b"), (3, None, None, "c")], "doc_id long, text string, n_chars long, cut_ string")
    out = dedup_lines(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, LONG, len(LONG), "a"), (2, "own", 3, "b"), (3, None, None, "c")]


def test_a_hot_line(spark):
    rows = [(i, f"{LONG}\nline number {i} of its own") for i in range(3000)]
    assert run(spark, rows) == plain(rows)


def state(index):
    return sorted((bytes(r["key"]), r["doc_id"]) for r in index.postings().collect()), sorted((bytes(r["key"]), r["refs"], r["keeper"]) for r in index.refs().collect())


def test_batches_and_deletions_can_be_taken_back(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    first = [(i, f"shared line number {i % 7}\nown line number {i}") for i in range(60)]
    second = [(100 + i, f"shared line number {i % 9}\nown line number {i}") for i in range(40)]
    index = LineIndex(spark, scratch(spark, "t"), keys_per_shard=20)
    index.insert(frame(first))
    before = state(index)
    index.insert(frame(second))
    both = LineIndex(spark, scratch(spark, "t"))
    both.insert(frame(first + second))
    assert state(index) == state(both)
    index.delete(frame(second).select("doc_id"))
    assert state(index) == before
    # the filters hold exactly the keys that are left
    left = {}
    for r in index._shard(index.postings().select("key").distinct()).collect():
        left.setdefault(r["shard"], []).append(bytes(r["key"]))
    for r in index.filters().collect():
        kept = CuckooFilter.from_bytes(bytes(r["filter"]))
        assert len(kept) == len(left.get(r["shard"], []))
        assert kept.contains(left.get(r["shard"], [])).all()
    # deleting keepers names new ones
    index.delete(frame(first[:10]).select("doc_id"))
    rest = LineIndex(spark, scratch(spark, "t"))
    rest.insert(frame(first[10:]))
    assert state(index) == state(rest)
    index.insert(frame(first[:10]))
    assert state(index) == before


FIRST, TWIN = "a line that is unique 0", "another repeated line 888681"  # keys with equal prints and buckets


@pytest.mark.parametrize("order", [[1], [2, 3]])
def test_falsely_known_keys(spark, order):
    """A key that a filter only seems to know, and that its batch repeats, keeps its own print."""
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    index = LineIndex(spark, scratch(spark, "t"), keys_per_shard=1_000_000)
    index.insert(frame((1, FIRST)))
    index.shards = 1
    index._rebuild(None)
    kept = CuckooFilter.from_bytes(bytes(index.filters().first()["filter"]))
    assert kept.contains([python_digest(TWIN.encode())]).all()  # the two do collide
    index.insert(frame((2, TWIN), (3, TWIN)))
    index.delete(frame(*((i, "") for i in order)).select("doc_id"))
    filters = CuckooFilter.from_bytes(bytes(index.filters().first()["filter"]))
    assert len(filters) == 1 and filters.contains([python_digest((TWIN if order == [1] else FIRST).encode())]).all()
    index.insert(frame((4, TWIN), (5, FIRST)))
    refs = {bytes(r["key"]): (r["refs"], r["keeper"]) for r in index.refs().collect()}
    assert refs == ({python_digest(TWIN.encode()): (3, 2)} if order == [1] else {python_digest(FIRST.encode()): (2, 1)})


def test_shards_grow_with_the_index(spark):
    frame = lambda ids: spark.createDataFrame([(i, f"own line number {i}\nshared line number {i % 5}") for i in ids], "doc_id long, text string")
    index = LineIndex(spark, scratch(spark, "t"), keys_per_shard=10)
    index.insert(frame(range(40)))
    assert index.shards == 8
    index.insert(frame(range(40, 400)), batches=2)
    assert index.shards > 16 and index.filters().agg({"prints": "max"}).first()[0] < 40
    whole = LineIndex(spark, scratch(spark, "t"))
    whole.insert(frame(range(400)))
    assert state(index) == state(whole)
    index.delete(frame(range(40, 400)).select("doc_id"))
    few = LineIndex(spark, scratch(spark, "t"))
    few.insert(frame(range(40)))
    assert state(index) == state(few)


def test_held_ids_cannot_come_again(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    index = LineIndex(spark, scratch(spark, "t"))
    index.insert(frame((1, LONG), (None, LONG)))
    for again in (1, None):
        with pytest.raises(ValueError, match="already holds"):
            index.insert(frame((again, "a line of its own")))
    index.delete(frame((None, "")).select("doc_id"))
    before = state(index)
    assert [i for _, i in before[0]] == [1] and before[1] == []
    index.delete(frame((7, "")).select("doc_id"))  # not held: nothing changes
    assert state(index) == before
    index.delete(frame((1, "")).select("doc_id"))
    assert state(index) == ([], [])


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_any_number_of_batches(spark, batches):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    index = LineIndex(spark, scratch(spark, "t"), keys_per_shard=2)
    index.insert(docs, batches)
    got = deduplicated(docs, index.drops()).select("doc_id", "cut_.n_lines", "cut_.n_dropped", "cut_.kept_sha256").collect()
    assert sorted(map(tuple, got), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == plain(ROWS)


def test_filter():
    rng = np.random.default_rng(1)
    keys = [bytes(k) for k in rng.integers(0, 256, (4000, 16), dtype=np.uint8)]
    kept = CuckooFilter(4000)
    kept.insert(keys[:1000])
    kept.insert(keys[1000:3000])
    assert kept.contains(keys[:3000]).all()
    assert kept.contains(keys[3000:]).mean() < 0.01
    kept.delete(keys[:1500])
    assert kept.contains(keys[1500:3000]).all()
    assert len(kept) == 1500
    with pytest.raises(KeyError):
        for k in keys[3000:]:
            kept.delete([k])
    with pytest.raises(Full):
        CuckooFilter(10).insert(keys)


def rows_read(spark, df):
    """How many rows of files a run of ``df`` reads."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    return sum(int(m) for m in scans(plan))


def scans(plan):
    text = plan.nodeName()
    if text.startswith("AdaptiveSparkPlan"):
        yield from scans(plan.executedPlan())
        return
    if "ShuffleQueryStage" in text or "BroadcastQueryStage" in text:
        yield from scans(plan.plan())
        return
    if text.startswith("Scan parquet"):
        yield plan.metrics().apply("numOutputRows").value()
    children = plan.children()
    for i in range(children.size()):
        yield from scans(children.apply(i))


def test_a_small_batch_reads_few_counts(spark):
    """One in a hundred documents: counts are read in the shards of their known lines alone, and no other document."""
    frame = lambda ids: spark.createDataFrame([(i, f"own line number {i}\nshared line number {i // 10}") for i in ids], "doc_id long, text string")
    index = LineIndex(spark, scratch(spark, "t"), keys_per_shard=10)
    index.insert(frame(range(1000)))
    known = index.counts().count()
    index.insert(frame(range(1000, 1010)))  # shares no line with the others
    assert len(index.read_shards) <= 1  # but for a false print, no shard is asked
    index.insert(spark.createDataFrame([(2000 + i, f"shared line number {i}") for i in range(3)], "doc_id long, text string"))
    assert 1 <= len(index.read_shards) <= 4 < index.shards // 20
    asked = index._shard(spark.createDataFrame([(python_digest(f"shared line number {i}".encode()),) for i in range(3)], "key binary"))
    looked = index.counts(asked)
    assert sorted(r["refs"] for r in looked.collect()) == [11, 11, 11]
    assert rows_read(spark, looked) < known / 20
    whole = LineIndex(spark, scratch(spark, "t"))
    whole.insert(frame(range(1010)))
    whole.insert(spark.createDataFrame([(2000 + i, f"shared line number {i}") for i in range(3)], "doc_id long, text string"))
    assert state(index) == state(whole)


def test_many_changes(spark):
    """Insertions and deletions in turn: after each, the index is what one insertion of the living documents gives."""
    rng = np.random.default_rng(7)
    text = lambda: "\n".join(f"a line out of a few {rng.integers(12)}" if rng.random() < 0.5 else f"a line out of many {rng.integers(10**6)}" for _ in range(rng.integers(5)))
    index, alive = LineIndex(spark, scratch(spark, "t"), keys_per_shard=15), {}
    for step in range(5):
        new = {100 * step + k: text() for k in range(12)} | ({None: text()} if step == 1 else {})
        index.insert(spark.createDataFrame(list(new.items()), "doc_id long, text string"), batches=1 + step % 2)
        alive |= new
        gone = [i for i in alive if rng.random() < 0.4] if step % 2 else []
        if gone:
            index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
            alive = {i: t for i, t in alive.items() if i not in gone}
    whole = LineIndex(spark, scratch(spark, "t"))
    whole.insert(spark.createDataFrame(list(alive.items()), "doc_id long, text string"))
    assert state(index) == state(whole)
