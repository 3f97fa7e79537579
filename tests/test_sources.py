"""Files, ignore rules, a real repository, history, records and policies."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from treeloom.operators import graph, history, policies
from treeloom.sources import files, git, ignore, records


def test_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe")
    (tmp_path / "c.md").write_text("# é\n")
    scanned = files.scan(spark, str(tmp_path))
    assert sorted((r["path"], r["n_bytes"]) for r in scanned.select("path", "n_bytes").collect()) == [("b.bin", 2), ("c.md", 5), ("src/a.py", 12)]
    assert {r["path"] for r in files.texts(scanned).collect()} == {"c.md", "src/a.py"}
    assert {r["path"]: r["text"] for r in files.lossy(scanned).collect()}["b.bin"] == "��"
    assert [tuple(r) for r in files.listing(scanned, "").collect()] == [("b.bin", False), ("c.md", False), ("src", True)]
    assert [tuple(r) for r in files.listing(scanned, "src").collect()] == [("a.py", False)]
    assert files.entry(scanned, "nope").count() == 0
    assert [(r["line_no"], r["byte_start"], r["text"]) for r in files.lines(files.texts(scanned)).where("path = 'src/a.py'").collect()] == [(1, 0, "x = 1"), (2, 6, "y = 2")]
    assert [(r["path"], r["language"], r["n_lines"]) for r in files.overview(files.texts(scanned)).collect()] == [("c.md", "Markdown", 1), ("src/a.py", "Python", 2)]
    files.write(files.texts(scanned), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert files.from_rows(spark, [("m", b"abc")]).first()["n_bytes"] == 3


RULES = [
    ("", "nested", "*.log\nbuild/\n/top.txt\n!keep.log\ndocs/**/x.md\n# comment\n\n"),
    ("src", "nested", "!*.log\ngen_*.rs\n"),
    ("", "configured", "secret*\n"),
]


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("a.log", True), ("keep.log", False), ("src/a.log", False), ("build/x/y.c", True), ("src/build/y.c", True), ("top.txt", True), ("a/top.txt", False),
        ("docs/a/b/x.md", True), ("docs/x.md", True), ("src/gen_a.rs", True), ("gen_a.rs", False), ("secrets.txt", True), ("plain.rs", False), ("src/build", False),
    ],
)
def test_ignore(spark, path, want):
    df = spark.createDataFrame([(path,)], "path string")
    assert ignore.excluded(df, ignore.rules(spark, RULES)).first()["excluded"] is want


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null", "GIT_COMMITTER_NAME": "c", "GIT_COMMITTER_EMAIL": "c@x"}

    def run(*args, day=1, author="ann"):
        when = f"2024-01-{day:02d}T00:00:00+00:00"
        more = {"GIT_AUTHOR_NAME": author, "GIT_AUTHOR_EMAIL": "a@x", "GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when}
        subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, env=env | more)

    run("init", "-q", "-b", "main")
    (root / "a.py").write_text("one\ntwo\nthree\n")
    run("add", "."), run("commit", "-qm", "First commit\n\nbody", day=1)
    (root / "a.py").write_text("one\nTWO\nthree\nfour\n")
    (root / "b.md").write_text("# B\n")
    run("add", "."), run("commit", "-qm", "Second", day=2, author="bob")
    run("branch", "feat/x")
    (root / "b.md").write_text("# B2\n")
    run("commit", "-qam", "Third", day=3)
    run("notes", "add", "-m", "a note", "HEAD~1"), run("tag", "v1")
    run("checkout", "-q", "feat/x"), (root / "c.txt").write_text("c"), run("add", "."), run("commit", "-qm", "Side", day=4), run("checkout", "-q", "main")
    (root / "a.py").write_text("one\nTWO\nthree\nfour\nfive\n")
    (root / "new.txt").write_text("n")
    (root / "staged.txt").write_text("s")
    run("add", "staged.txt")
    return str(root)


def test_git(spark, repo):
    t = lambda name, **o: git.read(spark, repo, name, **o)
    assert {r["path"] for r in t("index").collect()} == {"a.py", "b.md", "staged.txt"}
    commits, changes = t("commits").cache(), t("file_changes").cache()
    assert [(r["message"], r["author"], r["date"]) for r in history.shown(commits).orderBy("walk_idx").collect()] == [
        ("Third", "ann", "2024-01-03"), ("Second", "bob", "2024-01-02"), ("First commit", "ann", "2024-01-01"),
    ]
    assert [r["message"] for r in history.touching(commits, changes, "a.py", 10).collect()] == ["Second", "First commit"]
    assert [r["message"] for r in history.symbol_log(commits, changes, "a.py", 4, 4, 10).collect()] == ["Second"]
    assert [tuple(r) for r in history.contributors(commits, changes, "b.md").collect()] == [("ann", 1), ("bob", 1)]
    assert [r["note"].strip() for r in history.notes(commits, changes, t("notes"), "b.md").collect()] == ["a note"]
    shown = {(r["start_line"], r["end_line"]): (r["hash"], r["message"]) for r in history.blame(t("blame", path="a.py"), commits).collect()}
    assert shown[5, 5][0] == "uncommitted" and shown[2, 2][1] == "Second" and shown[1, 1][1] == "First commit"
    cut = history.symbol_blame(t("blame", path="a.py"), 2, 3).collect()
    assert sorted((r["start_line"], r["end_line"]) for r in cut) == [(2, 2), (3, 3)]
    assert {(r["path"], r["bucket"], r["label"]) for r in history.status(t("status")).collect()} == {("a.py", "modified", "modified"), ("new.txt", "untracked", "untracked"), ("staged.txt", "staged", "new file")}
    refs = t("refs").cache()
    assert {(r["name"], r["kind"], r["is_head"]) for r in refs.collect()} == {("feat/x", "branch", False), ("main", "branch", True), ("v1", "tag", False)}
    assert {r["name"]: r["is_dir"] for r in t("tree").collect()} == {"a.py": False, "b.md": False}
    assert bytes(t("blobs", path="a.py").first()["content"]) == b"one\nTWO\nthree\nfour\n"
    empty = history.head_or_empty(t("index"), t("blobs"))
    assert {r["path"]: bytes(r["content"]) for r in empty.collect()}["staged.txt"] == b""
    names = [r["name"] for r in history.file_names(history.touching(commits, changes, "a.py", 50), "py").collect()]
    assert names[0].startswith("001_2024-01-02_") and names[0].endswith("_second.py")
    assert [tuple(r) for r in history.extensions(t("index")).collect()] == [("md", 1), ("py", 1), ("txt", 1)]
    side = t("commits", ref="feat/x")
    parents = commits.select("hash", F.explode_outer("parents").alias("parent")).unionByName(side.select("hash", F.explode_outer("parents").alias("parent"))).distinct()
    heads = {r["name"]: r["target"] for r in refs.collect()}
    assert tuple(graph.ahead_behind(parents, heads["main"], heads["feat/x"]).first()) == (1, 1)
    reach = graph.reachable(parents, spark.createDataFrame([(heads["main"],)], "start string"))
    deletable = {r["name"]: r["deletable"] for r in history.may_delete(refs.where("kind = 'branch'"), reach).collect()}
    assert deletable == {"main": False, "feat/x": False}


def test_notes_upsert(spark):
    notes = spark.createDataFrame([("a", "x"), ("b", "y")], "hash string, note string")
    assert {tuple(r) for r in history.with_note(notes, F.lit("a"), "z").collect()} == {("a", "z"), ("b", "y")}
    assert {tuple(r) for r in history.with_note(notes, F.lit("a"), "  ").collect()} == {("b", "y")}


def test_records(spark, tmp_path):
    rows = [
        {"conv": "1", "ord": 1, "type": "user", "is_prompt": True}, {"conv": "1", "ord": 2, "type": "tool", "is_prompt": False, "tool": "Edit", "file_path": "old.py"},
        {"conv": "1", "ord": 3, "type": "user", "is_prompt": True}, {"conv": "1", "ord": 4, "type": "tool", "is_prompt": False, "tool": "Write", "file_path": "a.py"},
        {"conv": "1", "ord": 5, "type": "tool", "is_prompt": False, "tool": "Edit", "file_path": "a.py"}, {"conv": "1", "ord": 6, "type": "tool", "is_prompt": False, "tool": "Edit", "file_path": "b.MD"},
        {"conv": "1", "ord": 7, "type": "tool", "is_prompt": False, "tool": "Edit", "file_path": "c.rs"}, {"conv": "2", "ord": 1, "type": "tool", "is_prompt": False, "tool": "Read", "file_path": "c.rs"},
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    log = records.transcripts(spark, str(tmp_path / "log.jsonl"))
    assert {tuple(r) for r in records.changed_since_prompt(log, ["md"]).collect()} == {("1", "a.py"), ("1", "c.rs")}
    assert [tuple(r) for r in records.stop_gate(log, ["md"]).collect()] == [("1", 2)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/1.json").write_text('{"id": "x", "pid": 1, "path": "/p"}')
    (tmp_path / "s/2.json").write_text('{"id": "y", "pid": 2, "path": "/q"}')
    assert [r["id"] for r in records.sessions(spark, str(tmp_path / "s"), spark.createDataFrame([(2,)], "pid long")).collect()] == ["y"]
    (tmp_path / "user.toml").write_text("a = 1\nl = [1]\n[t]\nx = 1\n")
    (tmp_path / "treeloom.toml").write_text("a = 2\nl = [2]\n[t]\ny = 2\n")
    layers = records.config(str(tmp_path / "user.toml"), str(tmp_path))
    assert records.merged(*layers) == {"a": 2, "l": [1, 2], "t": {"x": 1, "y": 2}}


def test_policies(spark):
    rows = spark.createDataFrame([("Read", 500, None, 100), ("Read", 500, 20, 100), ("Read", 50, None, 100), ("Read", 500, None, -1), ("Grep", 500, None, 100)], "tool string, n int, lim int, t int")
    assert [r["m"] for r in rows.select(policies.access_mode(F.col("tool"), F.col("n"), F.col("lim"), F.col("t")).alias("m")).collect()] == ["deny", "hint", "hint", "hint", "hint"]
    place = spark.createDataFrame([("abcab", "c"), ("abcab", "ab"), ("abc", "x")], "t string, w string").select(policies.unique_place(F.col("t"), F.col("w")).alias("p"))
    assert [r["p"] for r in place.collect()] == [2, None, None]
    edits = spark.createDataFrame([("f", 3, 3), ("f", 90, 90)], "path string, row_start long, row_end long")
    scopes = spark.createDataFrame([("f", 0, 50, "big"), ("f", 2, 8, "small"), ("f", 3, 4, "tiny"), ("f", 1, 9, None)], "path string, row_start long, row_end long, name string")
    assert {(r["first"], r["last"]) for r in policies.changed_range(edits, scopes).collect()} == {(3, 10), (91, 92)}
    procs = spark.createDataFrame([(10, 1, "sh"), (11, 10, "vim"), (12, 11, "x"), (13, 1, "y"), (14, 12, "git")], "pid long, ppid long, comm string")
    pids, dyn, sta = spark.createDataFrame([(10, "none")], "pid long, policy string"), spark.createDataFrame([("git", "all")], "comm string, policy string"), spark.createDataFrame([("vim", "some"), ("git", "none")], "comm string, policy string")
    chains = graph.ancestors(procs, "pid", "ppid", procs.select(F.col("pid").alias("start")))
    got = {r["pid"]: r["policy"] for r in policies.visibility(procs, pids, dyn, sta, chains, "default").collect()}
    assert got == {10: "none", 11: "some", 12: "none", 13: "default", 14: "all"}
    report = {tuple(r) for r in policies.visibility_report(procs, pids, dyn).collect()}
    assert report == {("pid", "10", "none"), ("name", "git", "all")}


def test_topological_depth(spark):
    items = spark.createDataFrame([("a", ["a"], []), ("b", ["b"], ["a"]), ("c", ["c", "c2"], ["b", "gone", "c2"]), ("d", ["d"], ["a", "c2"])], "item string, keys array<string>, deps array<string>")
    got = {r["item"]: r["depth"] for r in graph.depths(items, graph.item_edges(items)).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    circle = spark.createDataFrame([("x", "y"), ("y", "x")], "item string, needs string")
    with pytest.raises(graph.CycleError, match="x|y"):
        graph.depths(circle.select("item"), circle, levels=5)


def test_stashes(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *a], cwd=tmp_path, check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "f").write_text("one\n")
    run("add", "f")
    run("commit", "-qm", "first")
    assert git.read(spark, str(tmp_path), "stashes").count() == 0
    for text in ("two", "three"):
        (tmp_path / "f").write_text(text)
        run("stash", "push", "-q", "-m", text)
    got = git.read(spark, str(tmp_path), "stashes").orderBy("nth").collect()
    assert [r["nth"] for r in got] == [0, 1] and [r["message"].split(": ")[-1] for r in got] == ["three", "two"]
