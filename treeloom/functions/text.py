"""Text expressions: all are Column to Column and stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Visibility labels and their short forms.
VISIBILITY = {"pub(crate)": "crate", "pub(super)": "super", "pub(self)": "self", "": "-"}
#: Severities by number.
SEVERITY = {1: "ERROR", 2: "WARNING", 3: "INFO", 4: "HINT"}
WEEK_SECONDS = 7 * 24 * 3600.0


def lines(text: Column) -> Column:
    """Lines without their ends; a final line break starts no line, ``\\r\\n`` is one break."""
    parts = F.split(text, "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, "\r$", ""))


def slug(text: Column) -> Column:
    """Kebab case of the ASCII letters and digits; camel case is taken apart."""
    camel = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1-$2"), "([A-Z]+)([A-Z][a-z])", "$1-$2")
    return F.lower(F.trim(F.regexp_replace(camel, "[^A-Za-z0-9]+", "-"), F.lit("-")))


def bounded_slug(text: Column, most: int) -> Column:
    """A slug of at most ``most`` characters, cut back to a hyphen if there is one."""
    s = slug(text)
    return F.when(F.length(s) <= most, s).otherwise(F.regexp_replace(F.substring(s, 1, most), "-[^-]*$", ""))


def utc_date(epoch_seconds: Column) -> Column:
    """``yyyy-MM-dd``, or ``-`` where there is no such date (years 1 to 9999)."""
    inside = epoch_seconds.between(-62135596800, 253402300799)
    return F.when(inside, F.date_format(F.timestamp_seconds(F.when(inside, epoch_seconds)), "yyyy-MM-dd")).otherwise("-")


def token_label(n_bytes: Column) -> Column:
    """A quarter of the bytes as ``~n``, from a thousand on as ``~n.nk``, cut off."""
    n = F.floor(n_bytes / 4)
    return F.when(n >= 1000, F.concat(F.lit("~"), F.floor(n / 1000).cast("string"), F.lit("."), F.floor((n % 1000) / 100).cast("string"), F.lit("k"))).otherwise(
        F.concat(F.lit("~"), n.cast("string"))
    )


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; empty if there is none."""
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    return F.coalesce(F.get(F.filter(trimmed, lambda x: x != ""), F.lit(0)), F.lit(""))


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)


def tag_suffix(after: Column) -> Column:
    """What a tag says: an optional ``(author)``, then a colon, then the text. Null without a colon."""
    pattern = r"(?s)^(?:\([^)]*\))?:(.*)$"
    return F.when(after.rlike(pattern), F.trim(F.regexp_extract(after, pattern, 1)))


def strip_line_prefixes(text: Column, prefixes: list[str]) -> Column:
    """Each line without its first matching comment prefix and one space after it."""
    import re

    pattern = "^(?:" + "|".join(re.escape(p) for p in prefixes) + ") ?"
    return F.array_join(F.transform(lines(text), lambda x: F.regexp_replace(F.trim(x), pattern, "")), "\n")


def line_comment(text: Column, indent: str, prefix: str) -> Column:
    """Each line as a comment line; blank lines get the bare prefix."""
    return F.array_join(F.transform(lines(text), lambda x: F.when(x == "", F.lit(indent + prefix)).otherwise(F.concat(F.lit(indent + prefix + " "), x))), "\n")


def strip_jsdoc(text: Column) -> Column:
    """The body of a ``/** ... */`` comment without its stars and blank edges."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(text), r"^/\*\*?", ""), r"\*/$", "")
    return F.trim(F.array_join(F.transform(F.split(inner, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^\* ?", "")), "\n"), F.lit(" \n"))


def dedented(text: Column) -> Column:
    """A docstring without the indent that all its later lines share."""
    parts = lines(text)
    later = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.trim(x) != "")
    indent = F.coalesce(F.array_min(F.transform(later, lambda x: F.length(x) - F.length(F.ltrim(x)))), F.lit(0))
    body = F.transform(parts, lambda x, i: F.when(i == 0, F.trim(x)).otherwise(F.substring(x, indent + 1, F.length(x))))
    return F.rtrim(F.array_join(body, "\n"), F.lit(" \n"))


def strip_quotes(text: Column) -> Column:
    """A string literal's content, without prefix letters and triple or single quotes."""
    return F.regexp_replace(text, r"(?s)^[rRbBuUfF]*(\"\"\"|'''|\"|')(.*?)\1$", "$2")


def clean_doc(text: Column, prefixes: list[str]) -> Column:
    """The first line that isn't blank of a comment; null if there is none."""
    line = first_line(strip_line_prefixes(text, prefixes))
    return F.when(line != "", line)


def compact_visibility(label: Column) -> Column:
    out = label
    for long, short in VISIBILITY.items():
        out = F.when(label == long, short).otherwise(out)
    return F.coalesce(out, F.lit("-"))


def section_first_line(body: Column) -> Column:
    """The first line that is neither blank nor a heading, trimmed; null if there is none."""
    return F.get(F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#")), F.lit(0))


def flat_type(text: Column) -> Column:
    """A type's text as a name: ``::`` becomes ``_``; brackets, commas and spaces go."""
    return F.translate(F.replace(text, F.lit("::"), F.lit("_")), "<>, ", "")


def impl_name(trait: Column, type_: Column) -> Column:
    return F.when(trait.isNotNull() & (trait != ""), F.concat(flat_type(trait), F.lit("_for_"), flat_type(type_))).otherwise(flat_type(type_))


def text_up_to(text: Column, mark: str) -> Column:
    """What comes before the first ``mark``, trimmed; without one the first line."""
    return F.when(F.instr(text, mark) > 0, F.trim(F.substring_index(text, mark, 1))).otherwise(F.substring_index(text, "\n", 1))


def split_disambiguator(name: Column) -> Column:
    """A struct (base, kind) of a name cut at its last ``~``; kind is null if either side is empty."""
    pattern = r"^(.+)~([^~]+)$"
    good = name.rlike(pattern)
    return F.struct(F.when(good, F.regexp_extract(name, pattern, 1)).otherwise(name).alias("base"), F.when(good, F.regexp_extract(name, pattern, 2)).alias("kind"))


def pacing(used: Column, seconds_left: Column) -> Column:
    """Expected minus used percent of a seven-day window; null outside of it."""
    inside = (seconds_left > 0) & (seconds_left <= WEEK_SECONDS)
    return F.when(inside, (F.lit(WEEK_SECONDS) - seconds_left) / F.lit(WEEK_SECONDS) * 100.0 - used)


def scaled_position(value: Column, most: Column, power: float = 0.4) -> Column:
    return F.when(most == 0, 0.0).otherwise(F.pow(value / most, F.lit(power)))


def command_name(command: Column) -> Column:
    """A shell command's program: assignments, ``env`` and a leading ``cd ... &&`` are skipped, folders cut off."""
    bare = F.regexp_replace(F.trim(command), r"^(?:(?:env|\S*=\S*)(?:\s+|$))+", "")
    bare = F.regexp_replace(bare, r"^cd(?:\s+(?!(?:&&|;)(?:\s|$))\S+)*(?:\s+(?:&&|;)\s*|\s*$)", "")
    return F.substring_index(F.regexp_extract(bare, r"^(\S*)", 1), "/", -1)


def grep_intent(pattern: Column) -> Column:
    """A struct (kind, symbol) of what a search pattern looks for; kind is null if it is not a symbol."""
    last = F.regexp_replace(F.substring_index(pattern, "::", -1), r"^[^\p{Alnum}_]+|[^\p{Alnum}_]+$", "")
    name = F.regexp_extract(F.regexp_replace(pattern, r"(?<![\p{Alnum}_])fn(?![\p{Alnum}_])", " "), r"([\p{Alnum}_]+)", 1)
    call = pattern.startswith("\\.") | pattern.startswith("fn ") | pattern.startswith("fn\\s") | pattern.contains("\\(") | (pattern.contains("(") & pattern.rlike(r"^\p{Alpha}"))
    row = lambda kind, symbol: F.struct(F.lit(kind).alias("kind"), symbol.alias("symbol"))
    none = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("symbol"))
    return (
        F.when(pattern.contains("::") & (last != ""), row("callers", last))
        .when(call, F.when(name != "", row("callers", name)).otherwise(none))
        .when(pattern.rlike(r"^[A-Z][\p{Alnum}_]*$"), row("references", pattern))
        .when(pattern.startswith("use ") | pattern.startswith("import ") | pattern.startswith("from "), row("imports", F.lit("")))
        .otherwise(none)
    )


def severity_label(number: Column) -> Column:
    out = F.lit("UNKNOWN")
    for n, label in SEVERITY.items():
        out = F.when(number == n, label).otherwise(out)
    return out


def ljust(text: Column, width: int) -> Column:
    """Padded to ``width``; longer texts stay whole."""
    return F.rpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))


def rjust(text: Column, width: int) -> Column:
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))


def mode_bits(read: Column, write: Column, execute: Column) -> Column:
    """Permission bits for owner, group and others alike, from three flags."""
    return (F.when(read, 0o444).otherwise(0)).bitwiseOR(F.when(write, 0o200).otherwise(0)).bitwiseOR(F.when(execute, 0o111).otherwise(0))


def narrowed(permissions: Column, mode: Column) -> Column:
    """A mode limited to what the permissions allow."""
    return mode.bitwiseAND(permissions)


def comm(name: Column) -> Column:
    """A process name as the kernel keeps it: as many whole characters as 15 bytes hold."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda n: F.octet_length(F.left(name, n)) <= 15)
    return F.left(name, F.array_max(fits))


def line_of(text: Column, needle: Column) -> Column:
    """The number of the first line that contains the first line of ``needle``; null if none does."""
    head = F.substring_index(needle, "\n", 1)
    at = F.array_position(F.transform(F.split(text, "\n"), lambda x: F.contains(x, head)), F.lit(True))
    return F.when(at > 0, at)


def ensure_trailing_newline(text: Column) -> Column:
    return F.when((text == "") | text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def ensure_leading_newline(before: Column, content: Column) -> Column:
    """``content``, on a new line if ``before`` doesn't end one."""
    return F.when((before != "") & ~before.endswith("\n"), F.concat(F.lit("\n"), content)).otherwise(content)


def line_start(text: Column, offset: Column) -> Column:
    """The 0-based place where the line around the 0-based ``offset`` begins."""
    return offset - F.length(F.substring_index(F.substring(text, F.lit(1), offset), "\n", -1))


def line_end(text: Column, offset: Column) -> Column:
    """The 0-based place of the line break after ``offset``, or the end."""
    rest = F.substring(text, offset + 1, F.length(text))
    return offset + F.length(F.substring_index(rest, "\n", 1))


def indent_at(text: Column, offset: Column) -> Column:
    start = line_start(text, offset)
    return F.regexp_extract(F.substring(text, start + 1, F.length(text)), r"^([ \t]*)", 1)


def blank_lines_after(rest: Column) -> Column:
    """How many characters of whole blank lines ``rest`` begins with."""
    return F.length(F.regexp_extract(rest, r"^((?:[ \t]*\n)*)", 1))


def diff_or_sentinel(diff: Column, binary: Column) -> Column:
    return F.when(binary, "Binary file differs\n").otherwise(F.coalesce(F.nullif(diff, F.lit("")), F.lit("No changes\n")))


def entry_slug(text: Column) -> Column:
    """The name of a tagged comment: its first line, at most 40 characters, or ``unnamed``."""
    return F.coalesce(F.nullif(bounded_slug(first_line(text), 40), F.lit("")), F.lit("unnamed"))


def slice_spec(spec: Column) -> Column:
    """A struct (kind, start, end) of ``M``, ``M-N`` or ``-N``; null where it is none of these."""
    number = lambda p: F.expr("null").cast("long") if p is None else F.regexp_extract(spec, p, 1).try_cast("long")
    single, start, end, tail = number(r"^([0-9]+)$"), number(r"^([0-9]+)-[0-9]+$"), number(r"^[0-9]+-([0-9]+)$"), number(r"^-([0-9]+)$")
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"))
    return F.when(tail > 0, row("tail", tail, tail)).when((start > 0) & (end >= start), row("range", start, end)).when(single > 0, row("single", single, single))


def file_slice_spec(spec: Column) -> Column:
    """A struct (start, end) of ``M`` or ``M-N`` as file views take it: 0 is allowed; null if inverted or something else."""
    start, end = F.regexp_extract(spec, r"^([0-9]+)(?:-[0-9]+)?$", 1).try_cast("long"), F.regexp_extract(spec, r"^[0-9]+-([0-9]+)$", 1).try_cast("long")
    return F.when(start.isNotNull() & (end.isNull() | (end >= start)), F.struct(start.alias("start"), end.alias("end")))


def sliced(items: Column, spec: Column) -> Column:
    """The items of an array that a :func:`slice_spec` selects, clamped."""
    n = F.size(items)
    begin = F.when(spec["kind"] == "tail", F.greatest(n - spec["start"], F.lit(0))).otherwise(F.least(spec["start"] - 1, n.cast("long")))
    stop = F.when(spec["kind"] == "tail", n.cast("long")).otherwise(F.least(spec["end"], n.cast("long")))
    return F.slice(items, (begin + 1).cast("int"), F.greatest(stop - begin, F.lit(0)).cast("int"))


#: Kinds of input and output errors and their numbers.
ERRNO = {"not-found": 2, "permission-denied": 13, "already-exists": 17, "not-a-directory": 20, "is-a-directory": 21, "invalid-input": 22, "directory-not-empty": 39, "timed-out": 110}


def errno(causes: Column, default: int = 5) -> Column:
    """The number of the first cause in a chain of error kinds that has one."""
    table = F.create_map(*[F.lit(x) for pair in ERRNO.items() for x in pair])
    known = F.filter(F.transform(causes, lambda c: table[c]), lambda n: n.isNotNull())
    return F.coalesce(F.get(known, F.lit(0)), F.lit(default))


def _whole_chars(raw: Column, at: Column) -> Column:
    """``at``, or the place where the character begins that a cut there would tear: at most three bytes before."""
    inside = lambda k: F.hex(F.substring(raw, at + 1 - k, F.lit(1))).between("80", "BF") & (at > k)
    return at - F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)


def position(body: Column, offset: Column) -> Column:
    """A struct (line, utf16), from 0, of a byte offset: the line and the UTF-16 units before it there; places past the end are the end."""
    raw = F.encode(F.coalesce(body, F.lit("")), "utf-8")
    at = F.least(F.coalesce(offset.cast("int"), F.lit(0)), F.octet_length(raw))
    before = F.decode(F.substring(raw, F.lit(1), _whole_chars(raw, at)), "utf-8")
    last = F.substring_index(before, "\n", -1)
    return F.struct(F.regexp_count(before, F.lit("\n")).cast("long").alias("line"), utf16_length(last).alias("utf16"))


def utf16_length(line: Column) -> Column:
    """UTF-16 units: characters, and one more for each beyond U+FFFF."""
    return (F.char_length(line) + F.regexp_count(line, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("long")


def offset_of(body: Column, line: Column, utf16: Column) -> Column:
    """The byte offset of a position; the line's end if it is shorter, null past the last line."""
    parts = F.split(F.coalesce(body, F.lit("")), "\n", -1)
    nth = line.cast("int")
    before = F.octet_length(F.array_join(F.slice(parts, F.lit(1), nth), "\n")) + F.when(nth > 0, 1).otherwise(0)
    units = F.encode(F.get(parts, nth), "UTF-16LE")
    bytes_ = F.least(2 * F.coalesce(utf16.cast("int"), F.lit(0)), F.octet_length(units))
    torn = (bytes_ > 0) & F.hex(F.substring(units, bytes_, F.lit(1))).between("D8", "DB")  # the first half of a pair
    head = F.decode(F.substring(units, F.lit(1), bytes_ - F.when(torn, 2).otherwise(0)), "UTF-16LE")
    return F.when(nth < F.size(parts), before + F.octet_length(head)).cast("long")
