"""Edit scripts between versions of a text, and where lines come from across many versions.

Lines that begin or end both texts alike are kept as they are. Of what lies
between, lines that occur once on each side meet, and the longest rising run of
their places holds the two texts together (the anchors). Only the stretches
between anchors are compared line by line, by the linear-space search for a
shortest edit. All of this sees one pair, in Arrow batches of pairs, and gives
its script as runs of lines with one sign. Lines keep their line feed, so a last
line without one differs from the same line with one.

Anchors hold blocks of lines together where a shortest script would tear them up
for the sake of repeated lines, so a script isn't always the shortest; where one
text is the other with lines taken out, it is, and is found in one pass. Else
time grows with the number of lines that differ within a stretch.

Null texts are empty, and bytes that are no UTF-8 count as the sign that stands
for them. Keys name one pair each, and a null key is a pair like any other;
equal texts have no changes and an empty diff.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.operators import graph, sequences

STEPS = "array<struct<sign:string,pos:int,i:int,j:int,n:int>>"
ARROW_STEP = [pa.field("sign", pa.string()), *(pa.field(c, pa.int32()) for c in ("pos", "i", "j", "n"))]


def lines_of(text: Column) -> Column:
    """The lines of a text, each with its line feed."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))


# Helpers of one pair: each sees one text's lines, or fewer.


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (by first number) whose second numbers rise."""
    tails, ends, before = [], [], []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before.append(ends[at - 1] if at else None)
        tails[at : at + 1], ends[at : at + 1] = [j], [n]
    out, n = [], ends[-1] if ends else None
    while n is not None:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def meeting(a: list, b: list) -> tuple[int, int, int, int]:
    """Where shortest edits from both ends of ``a`` and ``b`` meet: the run of equal lines from (x, y) to (u, v)."""
    n, m = len(a), len(b)
    ahead, back, gap = {1: 0}, {1: 0}, n - m
    for d in range((n + m + 1) // 2 + 1):
        diagonals = range(-(d - 2 * max(0, d - m)), d - 2 * max(0, d - n) + 1, 2)
        for way, other, forth in ((ahead, back, True), (back, ahead, False)):
            for k in diagonals:
                low, high = way.get(k - 1, -1), way.get(k + 1, -1)
                x = high if k == -d or (k != d and low < high) else low + 1
                x0, y = x, x - k
                while x < n and y < m and (a[x] == b[y] if forth else a[n - 1 - x] == b[m - 1 - y]):
                    x, y = x + 1, y + 1
                way[k] = x
                reach = d - 1 if forth else d
                if gap % 2 == forth and -reach <= gap - k <= reach and x + other.get(gap - k, -1) >= n:
                    return (x0, x0 - k, x, y) if forth else (n - x, m - y, n - x0, m - (x0 - k))
    raise AssertionError("edits from both ends must meet")


def inside(a: list, b: list) -> list[int] | None:
    """Places in ``a``, the first ones, of all that ``b`` has, if ``b`` is ``a`` with some taken out."""
    rest = iter(enumerate(a))
    out = [next((i for i, y in rest if x == y), None) for x in b] if len(b) <= len(a) else [None]
    return None if None in out else out


def matched(a: list, b: list) -> list[tuple[int, int]]:
    """The places of equal lines that a shortest edit from ``a`` to ``b`` keeps, in order."""
    both = set(a) & set(b)
    left, right = ([i for i, x in enumerate(side) if x in both] for side in (a, b))
    one, two = [a[i] for i in left], [b[j] for j in right]
    if (places := inside(one, two)) is not None:
        return [(left[i], j) for i, j in zip(places, right)]
    if (places := inside(two, one)) is not None:
        return [(i, right[j]) for i, j in zip(left, places)]
    out, todo = [], [(0, len(left), 0, len(right))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[left[a0]] == b[right[b0]]:
            out.append((left[a0], right[b0]))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[left[a1 - 1]] == b[right[b1 - 1]]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((left[a1], right[b1]))
        if a0 < a1 and b0 < b1:
            x, y, u, v = meeting([a[i] for i in left[a0:a1]], [b[j] for j in right[b0:b1]])
            out += [(left[a0 + x + k], right[b0 + y + k]) for k in range(u - x)]
            todo += [(a0, a0 + x, b0, b0 + y), (a0 + u, a1, b0 + v, b1)]
    return sorted(out)


def split_lines(text: bytes) -> list[bytes]:
    """The lines of a text as :func:`lines_of` has them."""
    *whole, last = text.split(b"\n")
    return [x + b"\n" for x in whole] + [last] * bool(last)


def kept_lines(a: list, b: list) -> list[tuple[int, int]]:
    """The places of the lines of ``a`` that are kept in ``b``, in order: both ends, anchors, and what lies between these."""
    head, a1, b1 = 0, len(a), len(b)
    while head < a1 and head < b1 and a[head] == b[head]:
        head += 1
    while a1 > head and b1 > head and a[a1 - 1] == b[b1 - 1]:
        a1, b1 = a1 - 1, b1 - 1
    out = [(k, k) for k in range(head)]
    if head < a1 and head < b1:
        one, two = ({x: i for i, x in enumerate(side[head:end], head) if times[x] == 1} for side, end in ((a, a1), (b, b1)) for times in (Counter(side[head:end]),))
        i0, j0 = head, head
        for i, j in [*rising([(i, two[x]) for x, i in one.items() if x in two]), (a1, b1)]:
            if i0 < i and j0 < j:
                out += [(i0 + x, j0 + y) for x, y in matched(a[i0:i], b[j0:j])]
            if i < a1:
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    return out + [(a1 + k, b1 + k) for k in range(len(a) - a1)]


def steps(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    """The script from ``a`` to ``b`` as runs of lines with one sign: (sign, lines of the script before, of ``a``, of ``b``, how many)."""
    out, pos, i, j = [], 0, 0, 0
    for x, y in [*kept_lines(a, b), (len(a), len(b))]:
        if x > i:
            out.append(("-", pos, i, j, x - i))
            pos, i = pos + x - i, x
        if y > j:
            out.append(("+", pos, i, j, y - j))
            pos, j = pos + y - j, y
        if x < len(a):
            if out and out[-1][0] == " ":
                out[-1] = (*out[-1][:4], out[-1][4] + 1)
            else:
                out.append((" ", pos, i, j, 1))
            pos, i, j = pos + 1, i + 1, j + 1
    return out


def patch_applied(old: str, patch: str) -> str | None:
    """``old`` with a unified diff applied; None if the text isn't what the diff says."""
    *whole, last = old.split("\n")
    lines, out, at = [x + "\n" for x in whole] + [last] * bool(last), [], 0
    rows, n = patch.split("\n"), 0
    while n < len(rows):
        row, n = rows[n], n + 1
        if not row.startswith("@@ "):
            continue
        first, _, size = row.split(" ")[1][1:].partition(",")
        start = int(first) - (size != "0")
        out, at = out + lines[at:start], start
        while n < len(rows) and rows[n][:1] in (" ", "-", "+"):
            sign, line, n = rows[n][0], rows[n][1:] + "\n", n + 1
            if n < len(rows) and rows[n].startswith("\\"):
                line, n = line[:-1], n + 1
            if sign != "+":
                if at >= len(lines) or lines[at] != line:
                    return None
                at += 1
            if sign != "-":
                out.append(line)
    return "".join(out + lines[at:])


def edit_steps(old: Column, new: Column) -> Column:
    """The script between two texts, an array of runs in the order of a diff: ``sign``, ``pos`` (lines of the script before), ``i`` and ``j`` (lines of either text before) and ``n``."""

    def search(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for one, two in batches:
            ends, rows = [0], []
            for x, y in zip(one, two):
                rows += steps(split_lines(x.as_py()), split_lines(y.as_py()))
                ends.append(len(rows))
            parts = zip(*rows) if rows else [[]] * len(ARROW_STEP)
            runs = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(parts, ARROW_STEP)], fields=list(ARROW_STEP))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)

    whole = lambda text: F.make_valid_utf8(F.coalesce(text, F.lit(""))).cast("binary")
    return F.arrow_udf(search, STEPS)(whole(old), whole(new))


def patched(old: Column, patch: Column) -> Column:
    """``old`` with a unified diff applied; null if the text isn't what the diff says."""

    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, patches in batches:
            yield pa.array([patch_applied(t.as_py() or "", p.as_py() or "") for t, p in zip(texts, patches)], pa.string())

    return F.arrow_udf(apply, "string")(old, patch)


# Scripts of many pairs.


def line_map(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, i, j): line ``i`` of ``old`` is kept as line ``j`` of ``new``, both from 0."""
    runs = pairs.select(key, F.explode(edit_steps(F.col(old), F.col(new))).alias("__step")).where("__step.sign = ' '")
    each = runs.select(key, "__step", F.explode(F.sequence(F.lit(0), F.col("__step.n") - 1)).alias("__k"))
    return each.select(key, (F.col("__step.i") + F.col("__k")).alias("i"), (F.col("__step.j") + F.col("__k")).alias("j"))


def script(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, pos, sign, i, j, line): every line in the order of a diff, kept (a space), taken away (-) or added (+).

    ``pos`` counts from 1; ``i`` and ``j`` are how many lines of the old and the
    new text come before.
    """
    # Texts are dealt by key, once for all that follows.
    dealt = pairs.select(key, F.col(old).alias("__old"), F.col(new).alias("__new"), edit_steps(F.col(old), F.col(new)).alias("__steps")).repartition(F.col(key))
    texts = dealt.select(key, lines_of(F.col("__old")).alias("__old"), lines_of(F.col("__new")).alias("__new"), "__steps")
    # An inner explode would bring a filter on the steps below the exchange, and the search would run twice.
    runs = texts.select(key, "__old", "__new", F.explode_outer("__steps").alias("__step"))
    each = runs.select(key, "__old", "__new", "__step", F.explode(F.sequence(F.lit(0), F.col("__step.n") - 1)).alias("__k"))
    place = lambda c: F.col(f"__step.{c}") + F.col("__k")
    before = lambda c, other: F.when(F.col("__step.sign") == other, F.col(f"__step.{c}")).otherwise(place(c)).alias(c)
    line = F.when(F.col("__step.sign") == "+", F.get("__new", place("j"))).otherwise(F.get("__old", place("i")))
    return each.select(key, (place("pos") + 1).alias("pos"), "__step.sign", before("i", "+"), before("j", "-"), line.alias("line"))


def hunks(rows: DataFrame, key: str, context: int = 3) -> DataFrame:
    """(key, hunk, old_start, old_lines, new_start, new_lines, text) of a script: its changes, with lines of context around them."""
    before, after = Window.partitionBy(key).orderBy("pos"), Window.partitionBy(key).orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    changed = F.when(F.col("sign") != " ", F.col("pos"))
    near = (F.col("pos") - F.max(changed).over(before) <= context) | (F.min(changed).over(after) - F.col("pos") <= context)
    marked = sequences.islands(rows.withColumn("near", F.coalesce(near, F.lit(False))), key, "pos", "near").where("near")
    shown = F.concat("sign", "line", F.when(F.endswith("line", F.lit("\n")), "").otherwise("\n\\ No newline at end of file\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("s")))), lambda r: r["s"]), "")
    made = marked.groupBy(key, "island").agg(F.min("pos").alias("first"), F.min("i").alias("i"), F.min("j").alias("j"), F.count_if(F.col("sign") != "+").alias("old_lines"), F.count_if(F.col("sign") != "-").alias("new_lines"), body.alias("body"))
    start = lambda at, n: F.when(F.col(n) == 0, F.col(at)).otherwise(F.col(at) + 1)
    side = lambda at, n: F.concat(start(at, n).cast("string"), F.when(F.col(n) == 1, "").otherwise(F.concat(F.lit(","), F.col(n).cast("string"))))
    head = F.concat(F.lit("@@ -"), side("i", "old_lines"), F.lit(" +"), side("j", "new_lines"), F.lit(" @@\n"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("first"))
    return made.select(key, nth.alias("hunk"), start("i", "old_lines").alias("old_start"), "old_lines", start("j", "new_lines").alias("new_start"), "new_lines", F.concat(head, "body").alias("text"))


def unified(pairs: DataFrame, key: str, old: str, new: str, path: str, context: int = 3) -> DataFrame:
    """(key, diff) of each pair: a unified diff with ``a/`` and ``b/`` before ``path``, empty if nothing changed."""
    found = hunks(script(pairs, key, old, new), key, context)
    whole = found.groupBy(F.col(key).alias("of")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk", "text"))), lambda r: r["text"]), "").alias("body"))
    asked = pairs.select(key, F.regexp_replace(F.coalesce(path, F.lit("")), "^/", "").alias("name"))
    head = F.concat(F.lit("--- a/"), "name", F.lit("\n+++ b/"), "name", F.lit("\n"))
    return asked.join(whole, F.col(key).eqNullSafe(F.col("of")), "left").select(key, F.when(F.col("body").isNull(), "").otherwise(F.concat(head, "body")).alias("diff"))


# Versions.


def origins(versions: DataFrame, file: str, version: str, text: str) -> DataFrame:
    """(file, version, line_no, origin, origin_line): the version that brought each line of each version, and the line's number there, from 1.

    ``versions`` are ordered within their file and none comes twice. A line points
    to the one that it was kept from in the version before. Pointers are doubled:
    a line takes over its target's pointer until that is a line that came new, so
    lines kept through v versions take log2(v) rounds.
    """
    named = versions.select(F.col(file).alias("file"), F.col(version).alias("version"), F.col(text).alias("body"))
    # Places are found over file and version alone; texts then meet by place.
    order = named.select("file", "version").withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("version")))
    told = graph.settled(named.alias("n").join(order.alias("o"), F.expr("n.file <=> o.file and n.version <=> o.version")).select(F.struct("n.file", "o.nth").alias("at"), "n.version", "n.body"))
    last = told.select(F.struct("at.file", (F.col("at.nth") + 1).alias("nth")).alias("of"), F.col("body").alias("old"))
    pairs = told.join(last, F.expr("at <=> of")).select("at", "old", "body")
    kept = line_map(pairs, "at", "old", "body").select(F.col("at").alias("of"), F.col("i").alias("old_i"), F.col("j").alias("new_j"))
    every = told.select("at", F.posexplode(lines_of(F.col("body"))).alias("line", "text")).drop("text")
    line = lambda at, nth_, n: F.struct(F.col(f"{at}.file").alias("file"), nth_.alias("nth"), n.alias("line"))
    own = line("at", F.col("at.nth"), F.col("line"))
    begun = every.join(kept, F.expr("at <=> of and line = new_j"), "left").select(own.alias("id"), F.when(F.col("old_i").isNull(), own).otherwise(line("at", F.col("at.nth") - 1, F.col("old_i"))).alias("to"))
    now = graph.settled(begun.withColumn("open", F.expr("not (id <=> to)")))
    while not now.where("open").isEmpty():
        ahead = now.select(F.col("id").alias("target"), F.col("to").alias("next"), F.col("open").alias("further"))
        moved = now.where("open").join(ahead, F.expr("to <=> target")).select("id", F.col("next").alias("to"), F.col("further").alias("open"))
        now = graph.settled(now.where("not open").unionByName(moved))
    names = told.select(F.col("at").alias("name"), "version")
    of = lambda c: F.struct(F.col(f"{c}.file"), F.col(f"{c}.nth"))
    new = now.join(names.withColumnRenamed("version", "v"), of("id").eqNullSafe(F.col("name"))).drop("name")
    full = new.join(names.withColumnRenamed("version", "origin"), of("to").eqNullSafe(F.col("name")))
    return full.select(F.col("id.file").alias(file), F.col("v").alias(version), (F.col("id.line") + 1).alias("line_no"), "origin", (F.col("to.line") + 1).alias("origin_line"))


def blamed(found: DataFrame, file: str, version: str) -> DataFrame:
    """(file, version, start_line, end_line, origin): the hunks of :func:`origins`, runs of lines that one version brought."""
    whole = F.struct(file, version)
    runs = sequences.islands(found.withColumn("of", whole), "of", "line_no", "origin")
    return runs.groupBy("of", "origin", "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line")).select("of.*", "start_line", "end_line", "origin")
