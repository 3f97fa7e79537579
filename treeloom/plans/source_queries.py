"""Parsers and analysis rules over source files made from suppliers.

Each supplier gives one file, whose size ``n`` is its key modulo 20, so that
files below, at and above every limit occur. The SQL says from ``n`` alone what
must be found.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.analysis import rules
from treeloom.operators import sections, todos, views
from treeloom.parse import tables
from treeloom.plans.registry import query, read

N_SQL = "(s_suppkey % 20)"


def repeated(part: str, mark: str = "", first: int = 1) -> Column:
    """``part`` n times, with ``@`` replaced by the number of each, from ``first``."""
    number = F.sequence(F.lit(first).cast("long"), F.col("n") + first - 1)
    return F.when(F.col("n") > 0, F.array_join(F.transform(number, lambda i: F.replace(F.lit(part), F.lit("@"), i.cast("string"))), mark)).otherwise("")


def files(spark, sf_dir, ext: str, text: Column) -> DataFrame:
    """(path, text): a file for each supplier; ``text`` may use ``n``."""
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 20).cast("long").alias("n"))
    return rows.select(F.concat(F.col("s_suppkey").cast("string"), F.lit("." + ext)).alias("path"), text.alias("text"))


def keyed(df: DataFrame) -> Column:
    """The supplier behind a path."""
    return F.substring_index(df["path"], ".", 1).cast("long").alias("s_suppkey")


def odd(yes: str, no: str) -> Column:
    return F.when(F.col("n") % 2 == 1, yes).otherwise(no)


def enclosed(before: str, part: str, after: str, mark: str = "", first: int = 1) -> Column:
    return F.concat(F.lit(before), repeated(part, mark, first), F.lit(after))


def nested(opening: str, closing: str, core: str) -> Column:
    return F.concat(F.lit("fn f() { "), repeated(opening), F.lit(core), repeated(closing), F.lit(" }"))


ODD = "n % 2 = 1"
#: For each rule a source file and when the rule must find something in it, once.
RULE_SOURCES: dict[str, tuple[str, Column | Callable[[], Column], str]] = {
    "ascii-separator": ("rs", lambda: F.concat(F.lit("// "), F.repeat(F.lit("="), F.col("n").cast("int") % 2 * 10), F.lit("\nfn f() {}")), ODD),
    "boolean-parameter": ("ts", lambda: odd("function f(on: boolean) {}", "function f(on: string) {}"), ODD),
    "deep-nesting": ("rs", lambda: F.when(F.col("n") < 5, nested("if a { ", "} ", "g(); ")).otherwise("fn f() {}"), "n = 4"),
    "deep-super-import": ("rs", lambda: enclosed("use ", "super::", "a;"), "n >= 2"),
    "deeply-nested-type": ("rs", lambda: F.concat(F.lit("fn f(a: "), repeated("Vec<"), F.lit("u8"), repeated(">"), F.lit(") {}")), "n >= 3"),
    "deprecation-marker": ("py", lambda: odd("# kept for reference\nx = 1\n", "# current\nx = 1\n"), ODD),
    "else-if-chain": ("rs", lambda: enclosed("fn f() { if a { } ", "else if b@ { } ", "}"), "n >= 3"),
    "empty-catch": ("ts", lambda: odd("try { f(); } catch (e) { }", "try { f(); } catch (e) { g(e); }"), ODD),
    "fat-trait": ("rs", lambda: enclosed("trait T { ", "fn m@(&self); ", "}"), "n > 8"),
    "god-struct": ("rs", lambda: enclosed("struct S { ", "f@: u8", " }", ", "), "n > 10"),
    "index-in-loop": ("py", lambda: odd("for i in range(len(v)):\n    g(v[i])\n", "for x in v:\n    g(x)\n"), ODD),
    "large-closure": ("rs", lambda: enclosed("fn f() { let g = || {\n", "h();\n", "}; }"), "n + 2 > 15"),
    "long-match": ("rs", lambda: enclosed("fn f(x: i32) -> i32 { match x { ", "@ => @, ", "} }"), "n > 8"),
    "long-parameter-list": ("rs", lambda: enclosed("fn f(", "a@: u8", ") {}", ", "), "n > 5"),
    "magic-number": ("rs", lambda: F.concat(F.lit("fn f() { g(a + "), F.col("n").cast("string"), F.lit("); }")), "n > 2"),
    "magic-string": ("rs", lambda: odd('fn f() { if a == "admin" { g(); } }', 'fn f() { g("admin"); }'), ODD),
    "manual-map": ("rs", lambda: odd("fn f() { match a { Some(x) => Some(x + 1), None => None } }", "fn f() { match a { Some(x) => x, None => 0 } }"), ODD),
    "negated-condition": ("rs", lambda: odd("fn f() { if !a { b(); } else { c(); } }", "fn f() { if !a { b(); } }"), ODD),
    "redundant-clone": ("rs", lambda: odd("fn f() { let b = a.clone(); g(b); }", "fn f() { let b = a.clone(); g(b, a); }"), ODD),
    "repeated-field-access": ("rs", lambda: enclosed("fn f() { ", "self.a.m@(); ", "}"), "n >= 3"),
    "single-use-variable": ("rs", lambda: enclosed("fn f() { let a = g(); ", "h@(a); ", "}"), "n = 1"),
    "string-concat-loop": ("rs", lambda: odd('fn f() { for a in b { s += "x"; } }', "fn f() { for a in b { n += 1; } }"), ODD),
    "string-format-push": ("rs", lambda: odd('fn f() { s.push_str(&format!("{}-{}", a, b)); }', "fn f() { s.push_str(a); }"), ODD),
    "stringly-typed-match": ("rs", lambda: enclosed("fn f() { match a { ", '"x@" => @, ', "_ => 0 } }"), "n >= 3"),
    "todo-fixme": ("rs", lambda: odd("// TODO: do it\nfn f() {}", "// the TODO list\nfn f() {}"), ODD),
    "too-many-locals": ("rs", lambda: enclosed("fn f() { ", "let a@ = 1; ", "}"), "n > 10"),
    "too-many-methods": ("rs", lambda: enclosed("impl S { ", "fn m@() {} ", "}"), "n > 15"),
    "type-in-variable-name": ("rs", lambda: odd("fn f() { let name_str = 1; }", "fn f() { let name = 1; }"), ODD),
    "unnecessary-else": ("py", lambda: odd("def f():\n    if a:\n        return 1\n    else:\n        b()\n", "def f():\n    if a:\n        b()\n    else:\n        c()\n"), ODD),
    "unwrap-chain": ("rs", lambda: enclosed("fn f() { a()", ".m@().unwrap()", "; }"), "n >= 2"),
}


def add_rule(id_: str, ext: str, text: Callable[[], Column], when: str) -> None:
    def find(spark, sf_dir):
        hints = rules.analyse(tables.nodes(files(spark, sf_dir, ext, text())), rules.enabled([id_]))
        return hints.groupBy(keyed(hints), "severity").agg(F.count(F.lit(1)).alias("n_found"))

    find.__name__ = "rule_" + id_.replace("-", "_")
    find.__doc__ = f"Files in which {id_} finds something."
    severity = rules.RULES[id_].severity
    query(f"SELECT s_suppkey, '{severity}' AS severity, 1::BIGINT AS n_found FROM (SELECT s_suppkey, {N_SQL} AS n FROM supplier) WHERE {when}")(find)


for _id, (_ext, _text, _when) in RULE_SOURCES.items():
    add_rule(_id, _ext, _text, _when)


def symbol_names(name: str, ext: str, text: Callable[[], Column], kind: str, prefix: str, doc: str) -> None:
    """Registers a query that lists the top symbols of each file by place, with their kind."""

    def find(spark, sf_dir):
        found = views.navigable(tables.fragments(files(spark, sf_dir, ext, text())).where("depth = 0"))
        rows = F.array_sort(F.collect_list(F.struct("ord", "name", "kind")))
        return found.groupBy(keyed(found)).agg(rows.alias("r")).select("s_suppkey", F.array_join(F.transform("r", lambda x: x["name"]), " ").alias("names"), F.array_join(F.array_distinct(F.transform("r", lambda x: x["kind"])), " ").alias("kinds"))

    find.__name__, find.__doc__ = name, doc
    query(f"SELECT s_suppkey, array_to_string(list_transform(range(1, n + 1), lambda i: '{prefix}' || i), ' ') AS names, '{kind}' AS kinds FROM (SELECT s_suppkey, {N_SQL} AS n FROM supplier) WHERE n > 0")(find)


symbol_names("symbols_rust", "rs", lambda: repeated("/// doc\npub fn f@(a: u8) {}\n"), "Function", "f", "Functions of Rust files.")
symbol_names("symbols_rust_types", "rs", lambda: repeated("struct S@ { a: u8 }\n"), "Struct", "S", "Types of Rust files.")
symbol_names("symbols_python", "py", lambda: repeated("def f@():\n    pass\n"), "Function", "f", "Functions of Python files.")
symbol_names("symbols_python_classes", "py", lambda: repeated("class C@:\n    x = 1\n"), "Class", "C", "Classes of Python files.")
symbol_names("symbols_typescript", "ts", lambda: repeated("function f@() {}\n"), "Function", "f", "Functions of TypeScript files.")
symbol_names("symbols_toml", "toml", lambda: F.concat(F.lit("x = 1\n"), repeated("[t@]\na = 1\n")), "Module", "t", "Tables of TOML files, behind a preamble.")
symbol_names("symbols_nix", "nix", lambda: F.concat(F.lit("{ "), repeated("a@ = @; "), F.lit("}")), "Variable", "a", "Bindings of Nix files.")
symbol_names("symbols_fennel", "fnl", lambda: repeated("(fn f@ [] nil)\n"), "Function", "f", "Functions of Fennel files.")
symbol_names("symbols_markdown", "md", lambda: F.concat(F.lit("intro\n"), repeated("# H@\ntext\n")), "section", "H", "Sections of Markdown files.")
symbol_names("symbols_jinja", "j2", lambda: repeated("{% block b@ %}x{% endblock %}\n"), "Module", "b", "Blocks of templates.")


@query(f"""
SELECT s_suppkey, CAST(2 * n AS BIGINT) AS n_symbols, array_to_string(list_transform(range(1, n + 1), lambda i: 'b' || i || ' x' || i), ' ') AS names
FROM (SELECT s_suppkey, {N_SQL} AS n FROM supplier) WHERE n > 0""")
def symbols_injected(spark, sf_dir):
    """Template blocks and the Rust functions inside them, by place."""
    found = views.navigable(tables.fragments(files(spark, sf_dir, "rs.j2", repeated("{% block b@ %}fn x@() {}{% endblock %}\n"))))
    rows = F.array_sort(F.collect_list(F.struct("byte_start", "name")))
    return found.groupBy(keyed(found)).agg(F.count(F.lit(1)).alias("n_symbols"), F.array_join(F.transform(rows, lambda r: r["name"]), " ").alias("names"))


@query(f"""
SELECT s_suppkey, 'struct' AS kind, n AS children, '1-1' AS lines FROM (SELECT s_suppkey, {N_SQL} AS n FROM supplier) WHERE false
UNION ALL SELECT s_suppkey, 'impl', CAST(n AS BIGINT), '1-' || (n + 2) FROM (SELECT s_suppkey, {N_SQL} AS n FROM supplier)""")
def symbol_overview(spark, sf_dir):
    """The symbol table's row for an impl: its children and its lines."""
    found = tables.fragments(files(spark, sf_dir, "rs", enclosed("impl S {\n", "fn m@() {}\n", "}\n")))
    rows = views.symbol_table(found).where(F.col("kind") == "impl")
    return rows.select(keyed(rows), "kind", F.col("children").cast("long").alias("children"), "lines")


@query(f"""
SELECT s_suppkey, 'pub fn f(a: u8) -> u8' AS signature, 'line ' || n AS doc FROM (SELECT s_suppkey, {N_SQL} AS n FROM supplier)""")
def symbol_facets(spark, sf_dir):
    """Signature and stripped documentation of a function."""
    found = tables.fragments(files(spark, sf_dir, "rs", F.concat(F.lit("/// line "), F.col("n").cast("string"), F.lit("\npub fn f(a: u8) -> u8 { a }\n"))))
    from treeloom.functions import text

    rows = found.where("kind = 'Function'")
    return rows.select(keyed(rows), F.trim("signature").alias("signature"), text.clean_doc(F.col("doc"), ["///"]).alias("doc"))


@query(f"SELECT s_suppkey, n % 2 = 0 AS valid FROM (SELECT s_suppkey, {N_SQL} AS n FROM supplier)")
def syntax_validity(spark, sf_dir):
    """Whether Python files can be read."""
    found = tables.validations(files(spark, sf_dir, "py", odd("def f(:\n", "def f():\n    pass\n")))
    return found.select(keyed(found), "valid")


@query("SELECT s_suppkey, 0::BIGINT AS breaches FROM supplier WHERE false")
def fragment_invariants(spark, sf_dir):
    """Fragments that overlap a sibling or leave their parent: none."""
    made = files(spark, sf_dir, "rs", F.concat(enclosed("impl S {\n", "fn m@() {}\n", "}\n"), enclosed("mod m {\n", "struct T@;\n", "}\n")))
    bad = tables.invariant_breaches(tables.fragments(made))
    return bad.groupBy(keyed(bad)).agg(F.count(F.lit(1)).alias("breaches"))


@query(f"""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Rust' WHEN s_suppkey % 3 = 1 THEN 'Jinja2' END AS language, CASE WHEN s_suppkey % 3 = 1 THEN 'py' END AS inner_ext FROM supplier""")
def registry_lookup(spark, sf_dir):
    """Languages by extension, compound extensions first."""
    ext = F.when(F.col("s_suppkey") % 3 == 0, ".rs").when(F.col("s_suppkey") % 3 == 1, ".py.j2").otherwise(".unknown")
    rows = read(spark, sf_dir, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), ext).alias("path"))
    named = tables.with_language(rows)
    return named.select(keyed(named), "language", "inner_ext")


@query(f"""
SELECT s_suppkey, 'intro ' || n || chr(10) AS preamble FROM (SELECT s_suppkey, {N_SQL} AS n FROM supplier) WHERE n % 2 = 1""")
def markdown_preamble(spark, sf_dir):
    """Text before the first heading, unless it is blank."""
    made = files(spark, sf_dir, "md", F.concat(F.when(F.col("n") % 2 == 1, F.concat(F.lit("intro "), F.col("n").cast("string"))).otherwise(" "), F.lit("\n# H\ntext\n")))
    found = sections.markdown_sections(made, "path", "text").where("kind = 'preamble'").join(made, "path")
    return found.select(keyed(found), F.expr("substring(text, byte_start + 1, byte_end - byte_start)").alias("preamble"))


@query(f"""
SELECT s_suppkey, CAST(2 * i AS BIGINT) AS line, 'TODO' AS tag, 'step ' || i AS text FROM (SELECT s_suppkey, {N_SQL} AS n FROM supplier), unnest(range(1, n + 1)) AS u(i)""")
def todo_rows(spark, sf_dir):
    """Tagged comments with what they say; tags outside comments don't count."""
    found = todos.entries(files(spark, sf_dir, "rs", repeated('let TODO@ = "x";\n// TODO(me): step @\n')), "path", "text")
    return found.select(keyed(found), F.col("line_no").cast("long").alias("line"), "tag", "text")


@query(f"""
SELECT s_suppkey, 'todo-fixme' AS rule_id, CAST(CASE WHEN n < 3 THEN 1 ELSE n END AS BIGINT) AS n, CAST(i AS BIGINT) AS line
FROM (SELECT s_suppkey, {N_SQL} AS n FROM supplier), unnest(range(1, n + 1)) AS u(i) WHERE n < 3 OR i = 1""")
def analysis_view(spark, sf_dir):
    """Findings of one rule as shown: three or more in a file become one row."""
    hints = rules.analyse(tables.nodes(files(spark, sf_dir, "rs", repeated("// TODO: do it\n"))), rules.enabled(["todo-fixme"]))
    shown = rules.view(hints)
    return shown.select(keyed(shown), "rule_id", F.col("n").cast("long").alias("n"), F.col("line_start").cast("long").alias("line"))
