"""Parsers: fragments by language, spans, names, errors, and the relational Markdown against the parser."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treeloom.operators import intervals, sections, views
from treeloom.parse import tables
from treeloom.parse.fragments import STRUCTURAL, decompose, fragment_rows
from treeloom.parse.tree import errors

RUST = """//! File doc.
use std::fmt;
use a::b;

/// A thing.
#[derive(Debug)]
pub struct Foo<T> { pub a: i32, b: Vec<T> }

impl<T> fmt::Display for Foo<T> {
    /// Shows.
    fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result { write!(f, "}") }
}
pub(crate) const MAX: usize = 5;
fn main() { let x = |a, b| a + b; if x(1, 2) > 3 { return; } }
"""
PYTHON = '''"""Module doc."""
import os
from a import b

LIMIT = 3

@deco
class Foo:
    """A class.

    More.
    """

    def method(self, x: int = 1) -> int:
        return x


async def run():
    pass
'''
TS = """import { a } from "b";
/** Adds. */
export function add(x: number, y: number): number { return x + y; }
export class Foo<T> extends Bar { private n = 1; method(a: string): void { a.b(c => c + `x${1}`); } }
interface I { a: string; b(): void }
type A = string | number;
enum E { X, Y = 2 }
const f = (x: number) => x * 2, g = /re[/]x/.test("a");
namespace N { export const z = 1; }
"""


def names(path, text):
    found = decompose(path, text)
    return [(r[2], r[5], r[19]) for r in fragment_rows(found[1], text, found[2])]


def test_rust():
    assert names("a.rs", RUST) == [
        (0, "file_doc", None), (0, "imports", None), (0, "Struct", "Foo"), (1, "docstring", None), (1, "decorator", None), (0, "Impl", "fmt_Display_for_FooT"),
        (1, "Function", "fmt"), (2, "docstring", None), (0, "Const", "MAX"), (0, "Function", "main"),
    ]
    foo = next(f for f in decompose("a.rs", RUST)[1] if f.name == "Foo")
    assert (foo.signature, foo.visibility, foo.doc) == ("pub struct Foo<T>", "pub", "A thing.")


def test_python():
    assert names("a.py", PYTHON) == [
        (0, "file_doc", None), (0, "imports", None), (0, "Variable", "LIMIT"), (0, "Class", "Foo"), (1, "docstring", None), (1, "decorator", None), (1, "Function", "method"), (0, "Function", "run"),
    ]
    foo = next(f for f in decompose("a.py", PYTHON)[1] if f.name == "Foo")
    assert foo.doc == "A class.\n\nMore."
    assert next(c for c in foo.children if c.name == "method").signature == "def method(self, x: int = 1) -> int"


def test_typescript():
    got = names("a.ts", TS)
    assert [(k, n) for d, k, n in got if d == 0] == [
        ("imports", None), ("Function", "add"), ("Class", "Foo"), ("Interface", "I"), ("TypeAlias", "A"), ("Enum", "E"), ("Variable", "f"), ("Module", "N"),
    ]
    assert (1, "Field", "n") in got and (1, "Function", "method") in got and (1, "Variable", "z") in got


def test_other_languages():
    assert [n for _, _, n in names("a.toml", 'x = 1\n[a]\nk = """\n[no]\n"""\n[[b.c]]\n[a]\n')] == [None, "a", "b-c", "a-2"]
    assert [(d, k, n) for d, k, n in names("a.nix", '{ x = 1; y = { z = "a;b"; w = [ 1 2 ]; }; }')] == [(0, "Variable", "x"), (0, "Module", "y"), (1, "Variable", "z"), (1, "Variable", "w")]
    assert [(k, n) for _, k, n in names("a.fnl", '(local m (require :m))\n(fn add [x] (+ x 1)) ; (fn no [])\n(local s "(fn x)")\n(macro w [] `x)')] == [("imports", None), ("Function", "add"), ("Variable", "s"), ("Macro", "w")]
    assert [(d, k, n) for d, k, n in names("a.j2", '{% extends "b" %}{% block x %}{% if a %}{% set v = 1 %}{% endif %}{% macro m(a) %}{% endmacro %}{% endblock %}')] == [(0, "preamble", None), (0, "Module", "x"), (1, "Variable", "v"), (1, "Function", "m")]
    both = names("a.md.j2", "{# c #}# One\n{% block b %}text{% endblock %}\n## Two\n")
    assert ("section", "00-one") in [(k, n) for _, k, n in both] and any(k == "Module" for _, k, _ in both)
    assert decompose("a.unknown", "x") is None and decompose("x.zzz.j2", "{% block a %}{% endblock %}")[1][0].name == "a"


def test_clashing_names():
    assert [n for _, k, n in names("a.rs", "struct A; fn A() {} fn A() {} fn b() {}")] == ["A~Struct", "A~Function", "A~Function-2", "b"]


MD = "intro\n\n# A\ntext\n## B\n```py\n# x\n```\n## B\n# C ##\nend é\n"


def test_markdown():
    assert names("a.md", MD) == [(0, "preamble", None), (0, "section", "00-a"), (1, "section", "00-b"), (2, "code", "1.py"), (1, "section", "01-b"), (0, "section", "01-c")]
    assert names("a.md", " \n\n") == [] and names("a.md", "#no heading\n") == [(0, "preamble", None)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["# A\n", "## B\n", "### C\n", "text\n", "```py\n", "```\n", "é\n", "\n", "#### D #\n"]), max_size=30))
def test_markdown_spans(parts):
    text = "".join(parts)
    rows = list(fragment_rows(decompose("a.md", text)[1], text, True))
    for r in rows:
        if r[1] is not None:
            parent = rows[r[1]]
            assert parent[8] <= r[8] <= r[9] <= parent[9]
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1] and a[5] not in STRUCTURAL:
                assert a[9] <= b[8]


def test_relational_markdown(spark):
    rng = random.Random(3)
    parts = ["# A\n", "## B\n", "### C\n", "text\n", "```py\n# no\n```\n", "é\n", "\n"]
    files = [("x.md", MD)] + [(f"{i}.md", "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))) for i in range(40)]
    df = spark.createDataFrame(files, "path string, text string")
    want = sorted((path, r[5], r[8], r[9]) for path, text in files for r in fragment_rows(decompose(path, text)[1], text, True))
    got = sections.markdown_sections(df, "path", "text")
    assert sorted((r["path"], r["kind"], r["byte_start"], r["byte_end"]) for r in got.collect()) == want
    parents = {(p, r[8], r[5]): rows[r[1]][8] if r[1] is not None else None for p, t in files for rows in [list(fragment_rows(decompose(p, t)[1], t, True))] for r in rows}
    assert all(parents[r["path"], r["byte_start"], r["kind"]] == r["parent_start"] for r in got.collect())


def test_relational_toml(spark):
    files = [("a.toml", 'x = 1\n[a]\nk = """\n[no]\n"""\n[[b.c]]\n[a]\n'), ("b.toml", "[only]\n"), ("c.toml", "")]
    got = sections.toml_sections(spark.createDataFrame(files, "path string, text string"), "path", "text")
    want = sorted((p, r[4], r[8], r[9]) for p, t in files for r in fragment_rows(decompose(p, t)[1], t, True))
    assert sorted((r["path"], r["name"], r["byte_start"], r["byte_end"]) for r in got.collect()) == want


FILES = [("src/a.rs", RUST), ("b.py", PYTHON), ("c.ts", TS), ("d.md", MD), ("bad.py", "def f(:\n"), ("bad.rs", "fn f( { ] }"), ("x.bin", "?"), ("n.rs", None)]


def test_tables(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    found = tables.fragments(files).cache()
    assert tables.invariant_breaches(found).collect() == []
    n = tables.nodes(files).cache()
    assert n.where("pre >= post").count() == 0
    bad = {r["path"] for r in tables.parse_errors(files).collect()}
    assert bad == {"bad.py", "bad.rs"}
    verdicts = {r["path"]: r["valid"] for r in tables.validations(files).collect()}
    assert verdicts["src/a.rs"] and not verdicts["bad.py"]
    language = {r["path"]: (r["language"], r["inner_ext"]) for r in tables.with_language(spark.createDataFrame([("a.md.j2",), ("b.rs",), ("c.x",)], "path string")).collect()}
    assert language == {"a.md.j2": ("Jinja2", "md"), "b.rs": ("Rust", None), "c.x": (None, None)}
    wanted = spark.createDataFrame([("src/a.rs", ["main"]), ("b.py", ["Foo", "method"])], "path string, fs_path array<string>")
    bodies = {r["path"]: r["body"] for r in tables.symbol_bodies(files.where("text is not null"), wanted).collect()}
    assert bodies["src/a.rs"].startswith("fn main()") and "return x" in bodies["b.py"]


def test_views(spark):
    files = spark.createDataFrame(FILES[:4], "path string, text string")
    found = tables.fragments(files).cache()
    rows = {(r["path"], r["name"]): r for r in views.symbol_table(found).collect()}
    assert rows["src/a.rs", "Foo"]["kind"] == "pub struct" and rows["src/a.rs", "Foo"]["description"] == "A thing."
    assert rows["b.py", "  method"]["lines"] == "14-15"
    assert rows["d.md", "  00-b"]["code_blocks"] == "1 block (py)"
    assert {r["kind"] for r in views.kinds(found.where("path = 'b.py'")).collect()} == {"class", "function", "variable"}
    assert [r["fs_name"] for r in views.by_kind(found, "Enum").collect()] == ["E"]
    listed = {r["entry"] for r in views.facets(found).where("path = 'b.py' and frag_id = 3").collect()}
    assert {"body", "docstring", "decorators", "signature", "OVERVIEW.md", "method@"} <= listed
    assert [r["name"] for r in views.code_blocks(found).collect()] == ["1.py"]
    points = spark.createDataFrame([("src/a.rs", 11), ("src/a.rs", 4), ("src/a.rs", 99), ("src/a.rs", 0)], "path string, line long")
    at = {r["line"]: r["fs_path"] for r in views.at_line(points, found).collect()}
    assert at == {11: ["fmt_Display_for_FooT", "fmt"], 4: ["Foo"], 99: ["main"]}
    table = views.markdown_table(spark.createDataFrame([("b", 2), ("a|c", 1)], "name string, n int"), ["name", "n"], ["n"]).first()["table"]
    assert table == "| name | n |\n|-|-|\n| a\\|c | 1 |\n| b | 2 |\n"


def test_nearest_prefers_what_comes_before(spark):
    spans = spark.createDataFrame([("f", 0, 2, "a", 0), ("f", 6, 8, "b", 1)], "path string, s long, e long, name string, ord int")
    points = spark.createDataFrame([("f", 3), ("f", 4), ("f", 1), ("f", 5)], "path string, row long")
    got = {r["row"]: r["name"] for r in intervals.nearest(points, spans, "path", "row", "s", "e", "name", "ord").collect()}
    assert got == {1: "a", 3: "a", 4: "b", 5: "b"}


@pytest.mark.parametrize("text", ["fn f() { a **b; let c = '\"'; let d = '\\''; 'x: loop { break 'x; } }", "impl<'a> A<'a> for B where C: D { type E = F; }", "fn f() { match x { 1..=2 if y => z?, _ => {} } }", "fn f() { let S { a, .. } = s; v[1..].iter().map(|x| -> u8 { *x as u8 }); }"])
def test_rust_without_errors(text):
    from treeloom.parse.clike import parse

    assert errors(parse(text, "rust"), text) == []
