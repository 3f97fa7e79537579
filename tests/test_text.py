"""Text, path and Python text functions on boundary cases."""

import pytest
from pyspark.sql import functions as F

from treeloom.functions import paths, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(spark, f, *values):
    return one(spark, f(*[F.lit(v) for v in values]))


@pytest.mark.parametrize(("given", "want"), [("CamelCase", "camel-case"), ("Hello, World!", "hello-world"), ("--a  b--", "a-b"), ("HTTPServer", "http-server"), ("", ""), ("é", "")])
def test_slug(spark, given, want):
    assert lit(spark, text.slug, given) == want


def test_bounded_slug(spark):
    assert one(spark, text.bounded_slug(F.lit("one two three"), 9)) == "one-two"
    assert one(spark, text.bounded_slug(F.lit("abcdefghij"), 4)) == "abcd"
    assert one(spark, text.bounded_slug(F.lit("short"), 40)) == "short"


@pytest.mark.parametrize(("n", "want"), [(0, "~0"), (3400, "~850"), (8400, "~2.1k"), (3999, "~999"), (4000, "~1.0k")])
def test_tokens(spark, n, want):
    assert lit(spark, text.token_label, n) == want


@pytest.mark.parametrize(("given", "want"), [(0, "1970-01-01"), (1700000000, "2023-11-14"), (10**15, "-")])
def test_date(spark, given, want):
    assert lit(spark, text.utc_date, given) == want


def test_lines(spark):
    assert lit(spark, text.lines, "a\r\nb\n") == ["a", "b"]
    assert lit(spark, text.lines, "") == []
    assert lit(spark, text.lines, "a\n\n") == ["a", ""]
    assert lit(spark, text.first_line, "\n  \n x \ny") == "x"
    assert lit(spark, text.first_line, " \n") == ""


@pytest.mark.parametrize(("given", "want"), [(": do it", "do it"), ("(me): do it", "do it"), (" - no", None), (" no", None), (":", "")])
def test_tag_suffix(spark, given, want):
    assert lit(spark, text.tag_suffix, given) == want


def test_comments(spark):
    assert one(spark, text.strip_line_prefixes(F.lit("/// a\n///b\n  // c"), ["///", "//"])) == "a\nb\nc"
    assert one(spark, text.line_comment(F.lit("a\n\nb"), "  ", "///")) == "  /// a\n  ///\n  /// b"
    assert lit(spark, text.strip_jsdoc, "/**\n * Does it.\n * @param x\n */") == "Does it.\n@param x"
    assert lit(spark, text.strip_quotes, 'r"""doc"""') == "doc"
    assert lit(spark, text.dedented, "First.\n    Second.\n      Third.\n") == "First.\nSecond.\n  Third."
    assert one(spark, text.clean_doc(F.lit("///\n/// Hello"), ["///"])) == "Hello"
    assert lit(spark, text.section_first_line, "# A\n\n text \nmore") == "text"


def test_labels(spark):
    assert [lit(spark, text.compact_visibility, v) for v in ("pub", "pub(crate)", "", "export")] == ["pub", "crate", "-", "export"]
    assert [lit(spark, text.severity_label, n) for n in (1, 2, 3, 4, 9)] == ["ERROR", "WARNING", "INFO", "HINT", "UNKNOWN"]
    assert lit(spark, text.impl_name, "fmt::Display", "Foo<T, U>") == "fmt_Display_for_FooTU"
    assert one(spark, text.ljust(F.lit("abc"), 2)) == "abc"
    assert one(spark, text.rjust(F.lit("abc"), 5)) == "  abc"


@pytest.mark.parametrize(
    ("given", "want"),
    [("ls -la", "ls"), ("A=1 env B=2 /usr/bin/cargo test", "cargo"), ("cd /x && make all", "make"), ("cd x", ""), ("", "")],
)
def test_command_name(spark, given, want):
    assert lit(spark, text.command_name, given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("Foo::bar", ("callers", "bar")), (r"\.method\(", ("callers", "method")), ("fn parse", ("callers", "parse")), ("Parser", ("references", "Parser")), ("use std", ("imports", "")), ("plain words", (None, None)), ("call(", ("callers", "call"))],
)
def test_grep_intent(spark, given, want):
    assert tuple(lit(spark, text.grep_intent, given)) == want


@pytest.mark.parametrize(
    ("spec", "record", "file"),
    [("5", ("single", 5, 5), (5, None)), ("2-4", ("range", 2, 4), (2, 4)), ("-3", ("tail", 3, 3), None), ("0", None, (0, None)), ("0-3", None, (0, 3)), ("4-2", None, None), ("-", None, None), ("3--x", None, None), ("", None, None)],
)
def test_slice_specs(spark, spec, record, file):
    got = lit(spark, text.slice_spec, spec)
    assert (None if got is None else tuple(got)) == record
    got = lit(spark, text.file_slice_spec, spec)
    assert (None if got is None else tuple(got)) == file


@pytest.mark.parametrize(("spec", "want"), [("2", [2]), ("2-9", [2, 3]), ("9", []), ("-2", [2, 3]), ("-9", [1, 2, 3])])
def test_sliced(spark, spec, want):
    assert one(spark, text.sliced(F.array(*map(F.lit, (1, 2, 3))), text.slice_spec(F.lit(spec)))) == want


def test_edges_of_lines(spark):
    t = "ab\n  cd\nef"
    assert [lit(spark, text.line_start, t, i) for i in (0, 1, 3, 5, 9)] == [0, 0, 3, 3, 8]
    assert [lit(spark, text.line_end, t, i) for i in (0, 5, 9)] == [2, 7, 10]
    assert lit(spark, text.indent_at, t, 5) == "  "
    assert lit(spark, text.blank_lines_after, " \n\n  x") == 3
    assert lit(spark, text.ensure_trailing_newline, "a") == "a\n"
    assert lit(spark, text.ensure_leading_newline, "a", "b") == "\nb"
    assert lit(spark, text.line_of, t, "cd\nzz") == 2
    assert lit(spark, text.line_of, t, "zz") is None


def test_paths(spark):
    assert tuple(lit(spark, paths.compound_extension, "a/x.md.j2")) == ("md", "j2")
    assert lit(spark, paths.extension, "a/.hidden") is None
    assert lit(spark, paths.relative, "a/b/c", "a/d/e") == "../../b/c"
    assert lit(spark, paths.relative, "a/b", "") == "a/b"
    assert lit(spark, paths.strip_root, "/r/a/b", "/r") == "a/b"
    assert lit(spark, paths.strip_root, "/rx/a", "/r") is None
    assert lit(spark, paths.to_uri, "/a b/c") == "file:///a%20b/c"
    assert lit(spark, paths.from_uri, "file:///a/b") == "/a/b"
    assert tuple(lit(spark, paths.companion, "src/a.rs@/symbols/X@/body.rs")) == ("src/a.rs", "symbols/X@/body.rs")
    assert lit(spark, paths.companion, "src/a.rs")["source"] is None
    assert one(spark, paths.strip_suffix(F.lit("a@"), "@")) == "a"
    assert one(spark, paths.strip_suffix(F.lit("@"), "@")) is None
    assert one(spark, paths.fragment_path(F.lit("a.rs"), F.array(F.lit("Foo"), F.lit("bar")), F.lit("rs"))) == "a.rs@/symbols/Foo@/bar@/body.rs"
    assert lit(spark, paths.target_link, "f", "src/a.rs", 3) == "f-a.rs:3"


def test_pacing(spark):
    week = 604800.0
    assert lit(spark, text.pacing, 50.0, week / 2) == 0.0
    assert lit(spark, text.pacing, 50.0, 0.0) is None
    assert lit(spark, text.pacing, 50.0, week + 1) is None
    assert lit(spark, text.scaled_position, 1.0, 0.0) == 0.0


def test_diff_sentinel(spark):
    assert lit(spark, text.diff_or_sentinel, "", False) == "No changes\n"


def plain_position(t, offset):
    before = t.encode()[:offset].decode("utf-8", "ignore")
    return before.count("\n"), len(before.rpartition("\n")[2].encode("utf-16-le")) // 2


def plain_offset(t, line, column):
    lines = t.split("\n")
    if line >= len(lines):
        return None
    head = lines[line].encode("utf-16-le")[: 2 * column].decode("utf-16-le", "ignore")
    return len("\n".join(lines[:line]).encode()) + (line > 0) + len(head.encode())


def test_positions(spark):
    from pyspark.sql import functions as F

    texts = ["aé\n\U0001f600x\n", "", "\n\n", "漢字\U00010000é\U0010ffff", "plain", "x\U0001f600\n\U0001f600", None]
    rows = [(t, i) for t in texts for i in range(len((t or "").encode()) + 3)]
    got = spark.createDataFrame(rows, "t string, i int").select("t", "i", text.position(F.col("t"), F.col("i")).alias("p")).collect()
    assert all(tuple(r["p"]) == plain_position(r["t"] or "", r["i"]) for r in got)
    rows = [(t, line, col) for t in texts for line in range(4) for col in range(8)]
    got = spark.createDataFrame(rows, "t string, line int, col int").select("*", text.offset_of(F.col("t"), F.col("line"), F.col("col")).alias("o")).collect()
    assert all(r["o"] == plain_offset(r["t"] or "", r["line"], r["col"]) for r in got)
