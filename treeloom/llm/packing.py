"""Best-fit packing of token sequences by bin completion.

Documents become token ids, ids become pieces of at most ``capacity`` tokens,
and pieces are put into as few sequences as the search finds.

Pieces of one length are interchangeable, so the search runs on the histogram
of lengths. It has at most ``capacity`` entries however large the input is;
that is all the driver gets. Around the largest length left, the search
enumerates the undominated fillings of the rest of the bin, those of least
waste first, uses one for as many bins as the counts allow, then for half as
many and so on down to one, and prunes by the waste that would still beat the
best packing known. Best-fit decreasing gives the first incumbent. Fillings are
made one by one as the search asks for them; the only cut is ``max_nodes``,
which counts the nodes of the search and the fillings it looked at.

The pieces are then dealt to the planned slots by their rank among the pieces
of their length. A task counts its own pieces while it writes them; running
sums over (task, length) make that a rank over all, so no length, however
common, meets in one task.

Defined results for odd input: a null or empty text is the end id alone, one
piece of length 1; very long texts become many full pieces, of which only the
first may be shorter; repeated rows and equal doc_ids are packed one by one;
an empty table gives an empty result; further columns of the input are not
read.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.llm.common import table, tidy, written

CAPACITY = 1024
END_ID = 2
#: Search nodes, fillings looked at included, after which the best packing so far is taken.
MAX_NODES = 20_000
#: Parts of a bin, at most, that the lower bound steps by.
MAX_PARTS = 64
#: One text in so many, by a checksum of the text, is also encoded by the ``tokenizers`` library, whole.
CHECKED_SHARE = 32

_encoders: dict[str, object] = {}
_libraries: dict[str, object] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """A fast encoder that gives the ids of the tokenizer file at ``path``.

    It is built from the file's own vocabulary. The ids are held against those
    of the ``tokenizers`` library in :func:`checked` and in the tests.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        _encoders[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def token_ids(enc, text: str, end_id: int = END_ID) -> np.ndarray:
    ids = enc.encode_to_numpy(text, allowed_special="all", disallowed_special=())
    return np.append(ids, end_id).astype("<u4")


def checked(path: str, text: str) -> None:
    """Fails if the ``tokenizers`` library gives other ids for ``text``."""
    from tokenizers import Tokenizer

    if path not in _libraries:
        _libraries[path] = Tokenizer.from_file(path)
    want = _libraries[path].encode(text, add_special_tokens=False).ids
    if token_ids(encoder(path), text)[:-1].tolist() != want:
        raise ValueError("the fast encoder and the tokenizer file disagree")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be shorter."""
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every text, with each piece's number among those of its task and length."""
    schema = pa.schema([(n, pa.int32() if t == "int" else pa.int64()) for n, t in (x.split() for x in PIECES.split(", "))])

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if zlib.crc32((text or "").encode()) % CHECKED_SHARE == 0:
                    checked(path, text or "")
                ids = token_ids(enc, text or "", end_id)
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


# --- the search over the histogram of lengths ---


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing, many equal pieces at a time: (lengths of a bin, bins)."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_bins if r >= length), default=None)
            if room is None:
                pattern, bins = (), math.ceil(left / (capacity // length))
                room = capacity
            else:
                pattern, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            each = min(room // length, left)
            used = min(bins, left // each)
            if bins > used and pattern:
                open_bins.setdefault(room, []).append((pattern, bins - used))
            left -= used * each
            open_bins.setdefault(room - each * length, []).append((pattern + (length,) * each, used))
    return [x for group in open_bins.values() for x in group]


def rounded_up(weights: np.ndarray, whole: int | np.ndarray) -> int:
    """The greatest quotient, rounded up."""
    return int(np.max(-(-weights // whole)))


def fewest(counts: dict[int, int], capacity: int) -> int:
    """A lower bound on the bins, by dual feasible functions.

    Such a function gives each length a weight so that no filling of a bin weighs
    more than 1; the weight of all pieces, rounded up, bounds the bins. Tried are

    - the length itself, with lengths over ``capacity - e`` as whole bins and
      those under ``e`` as nothing, for each length ``e`` up to half a bin;
    - on top of each, steps: of k + 1 equal parts of a bin, as many as lie within
      a length, by k; lengths of whole parts keep their share. Pieces of more
      than a third, say, weigh a half each (k = 2), since no three share a bin;
    - for each step ``e``, twice the whole steps in a short length, and for a
      long one what its complement leaves.
    """
    if not counts:
        return 0
    x, n = (np.array(v, np.int64) for v in zip(*sorted(counts.items()), strict=True))
    least = np.array([0, *x[2 * x <= capacity]], np.int64)[:, None]
    kept = np.where(x > capacity - least, capacity, np.where(x < least, 0, x))
    bound = rounded_up(kept @ n, capacity)
    for k in range(1, min(capacity // int(x[0]), MAX_PARTS) + 1):
        parts = (k + 1) * kept
        weight = np.where(parts % capacity == 0, k * kept, capacity * (parts // capacity))
        bound = max(bound, rounded_up(weight @ n, k * capacity))
    step = np.arange(1, capacity // 2 + 1)[:, None]
    long_ = 2 * (capacity // step - (capacity - x) // step)
    weight = np.where(2 * x > capacity, long_, np.where(2 * x == capacity, capacity // step, 2 * (x // step)))
    return max(bound, rounded_up(weight @ n, 2 * (capacity // step[:, 0])))


def bits(values) -> int:
    out = 0
    for v in values:
        out |= 1 << v
    return out


def smeared(found: int, most: int) -> int:
    """The numbers v + d for v in the set ``found`` and 0 <= d <= ``most``."""
    reach = 0
    while reach < most:
        step = min(reach + 1, most - reach)
        found |= found << step
        reach += step
    return found


def dominated(chosen: tuple[int, ...], free: int, waste: int) -> bool:
    """Whether a piece that isn't ``chosen`` could take the place of some that are (or of none).

    ``free`` is the set of lengths of which some are left beside ``chosen``.
    The pieces replaced then fit where that piece would have been, so the
    filling with it is as good in any packing.
    """
    one = many = 0  # sums of one chosen piece, and of two or more
    for x in chosen:
        many |= (many | one) << x
        one |= 1 << x
    if free & many:
        return True
    return waste > 0 and bool(free & (smeared((1 | one | many) << 1, waste - 1)))


def reachable(usable: list[int], counts: dict[int, int], room: int) -> list[int]:
    """For k = 0, 1, ...: the set of what the first ``k`` of ``usable`` can add up to within ``room``."""
    sums, mask = [1], (1 << (room + 1)) - 1
    for x in usable:
        now = sums[-1]
        for _ in range(min(counts[x], room // x)):
            more = now | (now << x) & mask
            if more == now:
                break
            now = more
        sums.append(now)
    return sums


def fillings(lengths: list[int], counts: dict[int, int], room: int, waste: int, order: str = "least"):
    """The undominated fillings of ``room`` that waste at most ``waste``, one by one.

    ``lengths`` is descending. ``order`` says which come first: "least", those
    of least waste, and of these the ones whose smallest piece is large;
    "large", those of least waste and of these the ones with the largest
    pieces; "greedy", those with the largest pieces, whatever they waste.
    Gives None for each filling that is dominated, so that the caller can count
    what was looked at.
    """
    usable = [x for x in lengths if x <= room and counts[x] > 0]
    every, n_usable = bits(usable), len(usable)
    sums = reachable(usable if order == "least" else usable[::-1], counts, room)

    def smallest_large(among: int, left: int):
        """What of the first ``among`` lengths adds up to ``left``."""
        if left == 0:
            yield ()
        for i in range(among if left else 0):
            x = usable[i]
            for n in range(1, min(counts[x], left // x) + 1):
                if sums[i] >> (left - n * x) & 1:
                    for rest in smallest_large(i, left - n * x):
                        yield rest + (x,) * n

    def largest_first(at: int, left: int, slack: int):
        """What of the lengths from ``at`` adds up to ``left``, or to as much as ``slack`` less."""
        near = (1 << (min(slack, left) + 1)) - 1  # the sums from left - slack to left, moved down
        for i in range(at, n_usable):
            x = usable[i]
            if not sums[n_usable - i] >> max(0, left - slack) & near:
                return  # what follows can't fill enough
            for n in range(min(counts[x], left // x), 0, -1):
                if sums[n_usable - i - 1] >> max(0, left - n * x - slack) & ((1 << (min(slack, left - n * x) + 1)) - 1):
                    for rest in largest_first(i + 1, left - n * x, slack):
                        yield (x,) * n + rest
        if left <= slack:
            yield ()

    most = min(waste, room)
    if order == "greedy":
        made = largest_first(0, room, most)
    else:
        made = (f for w in range(most + 1) for f in (smallest_large(n_usable, room - w) if order == "least" else largest_first(0, room - w, 0)))
    for chosen in made:
        used_up = bits(x for x in set(chosen) if chosen.count(x) == counts[x])
        w = room - sum(chosen)
        yield None if dominated(chosen, every & ~used_up, w) else (w, chosen)


#: The passes of the search: the order of the fillings, and how many at a node (None: all).
PASSES = (("greedy", 4), ("least", 4), ("large", 4), ("greedy", 16), ("least", None))


def complete(counts: dict[int, int], capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> list[tuple[tuple[int, ...], int]]:
    """The fewest bins the search finds, as (lengths of a bin, how many such bins).

    The search broadens: it runs with the first few fillings at each node, once
    in each of their orders, then with more, and last with all of them and with
    fewer bins of each. The passes share the nodes.
    """
    counts = {x: n for x, n in counts.items() if n}
    total = sum(x * n for x, n in counts.items())
    best = best_fit(counts, capacity)
    bins_of = lambda plan: sum(n for _, n in plan)
    least, best_bins = fewest(counts, capacity), bins_of(best)
    left, plan, wasted, nodes = dict(counts), [], 0, 0

    def allowed() -> int:
        """The waste that a packing better than the best may still add."""
        return (best_bins - 1) * capacity - total - wasted

    def branches(top: int, order: str, width: int | None):
        """(lengths of a bin, bins, waste of each): each filling for as many bins as can be, then for fewer."""
        nonlocal nodes
        lengths = sorted((x for x, n in left.items() if n), reverse=True)
        without_top = left | {top: left[top] - 1}
        taken = 0
        for found in fillings(lengths, without_top, capacity - top, allowed(), order):
            nodes += 1
            if nodes >= stop or taken == width:
                return
            if found is None:
                continue
            waste, filling = found
            if waste > allowed():  # the best has improved meanwhile
                continue
            taken += 1
            chosen = (top, *filling)
            bins = min(left[x] // chosen.count(x) for x in set(chosen))
            if waste:
                bins = min(bins, allowed() // waste)
            while bins and waste * bins <= allowed():
                yield chosen, bins, waste
                bins = 0 if width else bins // 2

    for k, (order, width) in enumerate(PASSES):
        stop = nodes + (max_nodes - nodes) // (len(PASSES) - k)
        left, plan, wasted = dict(counts), [], 0
        stack = [[branches(max(left), order, width), None]] if left else []
        while stack and nodes < stop and best_bins > least:
            node = stack[-1]
            if node[1] is not None:  # take back what this node had chosen last
                chosen, bins, waste = node[1]
                for x in chosen:
                    left[x] += bins
                plan.pop()
                wasted -= waste * bins
            node[1] = next(node[0], None) if allowed() >= 0 else None
            if node[1] is None:
                stack.pop()
                continue
            nodes += 1
            chosen, bins, waste = node[1]
            for x in chosen:
                left[x] -= bins
            plan.append((chosen, bins))
            wasted += waste * bins
            top = max((x for x, n in left.items() if n), default=None)
            if top is not None:
                stack.append([branches(top, order, width), None])
            elif bins_of(plan) < best_bins:
                best, best_bins = list(plan), bins_of(plan)
        if best_bins <= least:
            break
    return best


def slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, ordered by length and rank.

    Slot ``i`` takes ``mult`` pieces for each of ``bins`` sequences from
    ``sequence``; the first lies at ``offset``.
    """
    rows, sequence = [], 0
    for chosen, bins in plan:
        offset = 0
        for x in sorted(set(chosen), reverse=True):
            mult = chosen.count(x)
            rows.append((x, mult, bins, sequence, offset))
            offset += mult * x
        sequence += bins
    rows.sort()
    names = ("length", "mult", "bins", "sequence", "offset")
    out = {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}
    size = out["mult"] * out["bins"]
    total = np.cumsum(size) - size
    first = np.searchsorted(out["length"], out["length"], side="left")
    out["rank"] = total - total[first] if len(rows) else total
    return out


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, max_nodes: int = MAX_NODES) -> DataFrame:
    """One row for each piece of ``docs`` (doc_id, text), with its sequence and place."""
    spark = docs.sparkSession
    pieces = written(cut_documents(docs, path, capacity, end_id), "pieces")
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    dealt = spark.sparkContext.broadcast(slots(complete(counts, capacity, max_nodes)))  # bounded by the search, not by the data
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = dealt.value
        for batch in batches:
            length, rank = (np.asarray(batch.column(n)) for n in ("length", "rank"))
            order = np.int64(1) << 50  # lengths and ranks as one sorted key
            at = np.searchsorted(s["length"] * order + s["rank"], length * order + rank, side="right") - 1
            inside = rank - s["rank"][at]
            sequence = s["sequence"][at] + inside // s["mult"][at]
            offset = s["offset"][at] + inside % s["mult"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[x.split()[0] for x in PACKED.split(", ")])

    return ranked.mapInArrow(place, PACKED)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
