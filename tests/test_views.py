"""Views of locations, hints, diagnostics, servers and providers."""

from pyspark.sql import functions as F

from treeloom.functions import text
from treeloom.operators import edges, history, views


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_locations(spark):
    df = spark.createDataFrame([("/r/a.rs", 0, 4), ("/rx/b.rs", 1, 1), ("/r/d/c.rs", 9, 0)], "file string, line long, column long")
    assert rows(views.locations(df, "/r/")) == [("a.rs", 1, 5), ("d/c.rs", 10, 1)]


def test_inlay_hints_and_hover(spark):
    df = spark.createDataFrame([(0, 1, [": ", "u8"], 1), (2, 3, ["x:"], 2), (4, 5, ["?"], 9), (6, 7, ["n"], None)], "line long, column long, parts array<string>, kind int")
    assert rows(views.inlay_hints(df)) == [(1, 2, ": u8", "type"), (3, 4, "x:", "parameter"), (5, 6, "?", "other"), (7, 8, "n", "unknown")]
    h = spark.createDataFrame([("one", None), (None, ["a", "b"]), (None, None)], "s string, p array<string>")
    assert [r["h"] for r in h.select(views.hover(F.col("s"), F.col("p")).alias("h")).collect()] == ["one", "a\n\nb", ""]


def test_diagnostics(spark):
    df = spark.createDataFrame([(0, 0, 1, "rustc", "E1", "m"), (1, 2, None, None, None, "n")], "line long, column long, severity int, source string, code string, message string")
    assert rows(views.diagnostics(df)) == [(1, 1, "ERROR", "rustc", "E1", "m"), (2, 3, "UNKNOWN", "", "", "n")]


def test_bodies(spark):
    body = "x\n    fn é() {}\nz"
    df = spark.createDataFrame([(body,)], "t string")
    got = df.select(views.body(F.encode("t", "utf-8"), F.lit(6).cast("long"), F.lit(16).cast("long")).alias("b"), views.masked_body(F.col("t"), F.lit(9), F.lit(12)).alias("m")).first()
    assert got["b"] == "    fn é() {}"
    assert got["m"] == "       é()   "


def test_servers(spark):
    servers = spark.createDataFrame([("a", 0, "rust", ["rs", "zz"], True), ("b", 1, "rust2", ["rs"], True), ("c", 2, "py", ["py"], False)], "server string, ord int, language string, exts array<string>, enabled boolean")
    parsers = spark.createDataFrame([("rs",), ("py",)], "ext string")
    assert rows(edges.server_index(servers, parsers)) == [("rs", "a", "rust")]
    symbols = spark.createDataFrame([("s", 1, "ParseNode"), ("r", 0, "parser"), ("s", 0, "other")], "server string, ord int, name string")
    assert [r["name"] for r in edges.search(symbols, "PARSE").collect()] == ["parser", "ParseNode"]


def test_system(spark):
    providers = spark.createDataFrame([("fs", 0, 0, True), ("b", 1, 0, False), ("a", 0, 0, False), ("slice", 0, -100, False)], "id string, depth int, priority int, terminal boolean")
    index = spark.createDataFrame([("Rust",), ("Rust",), ("Python",)], "language string")
    got = sorted(rows(views.system(providers, index)))
    assert [r[1] for r in got] == ["slice", "a", "b", "fs"] and got[0][2] == "Rust, Python"


def test_old_versions(spark):
    blobs = spark.createDataFrame([("a", "1", b"whole"), ("a", "2", b"\xff")], "path string, hash string, content binary")
    bodies = spark.createDataFrame([("a", "1", "body")], "path string, hash string, body string")
    assert {(r[1], bytes(r[2])) for r in history.content_at(blobs, bodies).collect()} == {("1", b"body"), ("2", b"\xff")}


def test_todo_links(spark):
    df = spark.createDataFrame([("src/a.rs", 3, "TODO", "do-it")], "path string, line_no long, tag string, entry string")
    assert rows(views.todo_entries(df, "path")) == [("TODO", "src-a.rs:3-do-it", "src/a.rs@/lines:3")]


def test_errno(spark):
    df = spark.createDataFrame([(["other", "not-found", "timed-out"],), (["other"],), ([],)], "c array<string>")
    assert [r["n"] for r in df.select(text.errno(F.col("c")).alias("n")).collect()] == [2, 5, 5]
