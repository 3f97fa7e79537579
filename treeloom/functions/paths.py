"""Path and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """Everything before the last slash; empty for a bare name."""
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("")


def extension(path: Column) -> Column:
    """The text after the last dot of the name; null without one, and for names that begin with their only dot."""
    found = F.regexp_extract(name(path), r"^.+\.([^.]+)$", 1)
    return F.nullif(found, F.lit(""))


def compound_extension(path: Column) -> Column:
    """A struct (inner, outer) of names with two extensions; null for others."""
    pattern = r"^.+\.([^.]+)\.([^.]+)$"
    return F.when(name(path).rlike(pattern), F.struct(F.regexp_extract(name(path), pattern, 1).alias("inner"), F.regexp_extract(name(path), pattern, 2).alias("outer")))


def strip_root(path: Column, root: Column) -> Column:
    """``path`` below ``root``; null if it isn't below."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(base), F.substring(path, F.length(base) + 1, F.length(path))).when(path == F.rtrim(root, F.lit("/")), "")


def strip_suffix(path: Column, suffix: str) -> Column:
    """The name without ``suffix``; null if it lacks it or is nothing else."""
    return F.when(path.endswith(suffix) & (F.length(path) > len(suffix)), F.substring(path, F.lit(1), F.length(path) - len(suffix)))


def relative(path: Column, base: Column) -> Column:
    """``path`` as seen from the folder ``base``."""
    a, b = segments(path), segments(base)
    least = F.least(F.size(a), F.size(b))
    same = F.transform(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: (i <= least) & F.get(a, i - 1).eqNullSafe(F.get(b, i - 1)) & F.get(a, i - 1).isNotNull())
    common = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & x, 1).otherwise(0)).alias("n"), (s["on"] & x).alias("on")))["n"]
    up = F.array_repeat(F.lit(".."), F.size(b) - common)
    return F.array_join(F.concat(up, F.slice(a, common + 1, F.greatest(F.size(a) - common, F.lit(0)))), "/")


def rewritten(path: Column, old: str, new: str) -> Column:
    """``path`` with its prefix ``old`` made ``new``; unchanged without it."""
    return F.when((path == old) | path.startswith(old + "/"), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def to_uri(path: Column) -> Column:
    """A file URI; each segment is percent-encoded."""
    coded = F.transform(F.split(path, "/"), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")))
    return F.concat(F.lit("file://"), F.array_join(coded, "/"))


def from_uri(uri: Column) -> Column:
    """A file URI's path, as it stands in the URI."""
    return F.when(uri.startswith("file://"), F.substring(uri, 8, 1 << 30)).otherwise(uri)


def companion(path: Column, mark: str = "@") -> Column:
    """A struct (source, inner) of ``dir/name@/rest``; source is null without a marked segment."""
    pattern = r"^(.*?[^/])" + mark + r"(?:/(.*))?$"
    good = path.rlike(pattern)
    return F.struct(F.when(good, F.regexp_extract(path, pattern, 1)).alias("source"), F.when(good, F.regexp_extract(path, pattern, 2)).alias("inner"))


def fragment_path(source: Column, fs_path: Column, ext: Column) -> Column:
    """Where the body of a fragment is shown: nested names under the source's companion."""
    nested = F.array_join(F.transform(fs_path, lambda x: F.concat(x, F.lit("@"))), "/")
    return F.concat(source, F.lit("@/symbols/"), nested, F.lit("/body."), ext)


def target_link(symbol: Column, path: Column, line: Column) -> Column:
    """``symbol-file:line``, or ``file:line`` without a symbol."""
    place = F.concat(name(path), F.lit(":"), line.cast("string"))
    return F.when(symbol.isNotNull() & (symbol != ""), F.concat(symbol, F.lit("-"), place)).otherwise(place)


def search_link(path: Column, symbol: Column) -> Column:
    return F.concat(F.replace(path, F.lit("/"), F.lit("-")), F.lit("::"), symbol)
