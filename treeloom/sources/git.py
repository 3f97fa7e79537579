"""A git repository as a data source.

``spark.read.format("treeloom_git").option("repo", path).option("table", name)``
with the tables of :data:`TABLES`. Rows come from the ``git`` program, which
must be able to read the repository wherever a task runs. Changes and blame are
read in partitions of commits and files.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Tables and their columns.
TABLES = {
    "index": "path string",
    "commits": "hash string, author string, epoch_secs long, message string, parents array<string>, walk_idx long",
    "file_changes": "hash string, path string, hunk_new_start long, hunk_new_lines long",
    "tree": "path string, name string, is_dir boolean, hash string",
    "blobs": "path string, hash string, content binary",
    "blame": "path string, start_line long, end_line long, hash string",
    "status": "path string, flags long",
    "refs": "name string, kind string, target string, is_head boolean",
    "notes": "hash string, note string",
    "stashes": "nth int, hash string, message string",
}
#: Flags of a status entry, by the two letters of the short status.
INDEX_FLAGS = {"A": 1, "M": 2, "D": 4, "R": 8, "T": 16}
WORKTREE_FLAGS = {"?": 128, "M": 256, "D": 512, "T": 1024, "R": 2048}
CONFLICTED = 32768
NO_COMMIT = "0" * 40


class Part(InputPartition):
    def __init__(self, items: list[str]) -> None:
        self.items = items


class GitReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.table = options["repo"], options["table"]
        self.ref, self.size = options.get("ref", "HEAD"), int(options.get("partitionItems", 200))
        self.path = options.get("path", "")

    def git(self, *args: str, check: bool = True) -> bytes:
        done = subprocess.run(["git", "-c", "core.quotepath=off", "-C", self.repo, *args], capture_output=True)
        if done.returncode and check:
            raise OSError(done.stderr.decode("utf-8", "replace").strip() or f"git {args[0]} failed")
        return b"" if done.returncode else done.stdout

    def unborn(self) -> bool:
        return not self.git("rev-parse", "--verify", "-q", "HEAD", check=False)

    def partitions(self) -> list[Part]:
        if self.table == "file_changes":
            items = [] if self.unborn() else self.git("rev-list", self.ref).decode().split()
        elif self.table in ("blame", "blobs"):
            items = [p.decode() for p in self.git("ls-files", "-z").split(b"\0") if p] if not self.path else [self.path]
        else:
            return [Part([])]
        return [Part(items[i : i + self.size]) for i in range(0, len(items), self.size)] or [Part([])]

    def read(self, part: Part) -> Iterator[tuple]:
        return getattr(self, f"read_{self.table}")(part.items)

    def read_index(self, _: list[str]) -> Iterator[tuple]:
        for p in self.git("ls-files", "-z").split(b"\0"):
            try:
                if p:
                    yield (p.decode(),)
            except UnicodeDecodeError:
                continue  # tracked paths that aren't UTF-8 are left out

    def read_commits(self, _: list[str]) -> Iterator[tuple]:
        if self.unborn():
            return
        out = self.git("log", "--date-order", "--format=%H%x00%an%x00%ct%x00%P%x00%s%x01", self.ref).decode("utf-8", "replace")
        for i, row in enumerate(r for r in out.split("\x01") if r.strip()):
            hash_, author, secs, parents, message = row.strip("\n").split("\0")
            yield hash_, author or None, int(secs), message, parents.split(), i

    def read_file_changes(self, commits: list[str]) -> Iterator[tuple]:
        for c in commits:
            out = self.git("diff-tree", "--root", "-m", "--first-parent", "-r", "-p", "-U0", "--no-commit-id", "--no-renames", c).decode("utf-8", "replace")
            path, seen = None, False
            for line in out.split("\n"):
                if line.startswith("diff --git "):
                    if path is not None and not seen:
                        yield c, path, None, None
                    path, seen = line.rpartition(" b/")[2], False
                elif line.startswith("@@ "):
                    new = line.split(" ")[2][1:].split(",")
                    seen = True
                    yield c, path, int(new[0]), int(new[1]) if len(new) > 1 else 1
            if path is not None and not seen:
                yield c, path, None, None

    def read_tree(self, _: list[str]) -> Iterator[tuple]:
        if self.unborn():
            return
        spec = self.ref + (f":{self.path}" if self.path else "")
        for row in self.git("ls-tree", "-z", spec).split(b"\0"):
            if row:
                head, _, name = row.partition(b"\t")
                _, kind, hash_ = head.decode().split()
                full = f"{self.path}/{name.decode('utf-8', 'replace')}" if self.path else name.decode("utf-8", "replace")
                yield full, name.decode("utf-8", "replace"), kind == "tree", hash_

    def read_blobs(self, files: list[str]) -> Iterator[tuple]:
        if self.unborn():
            return
        for p in files:
            hash_ = self.git("rev-parse", "-q", "--verify", f"{self.ref}:{p}", check=False).decode().strip()
            if hash_:
                yield p, hash_, bytes(self.git("cat-file", "blob", hash_))

    def read_blame(self, files: list[str]) -> Iterator[tuple]:
        for p in files:
            out = self.git("blame", "--incremental", "--", p, check=False).decode("utf-8", "replace")
            for line in out.split("\n"):
                cells = line.split(" ")
                if len(cells) == 4 and len(cells[0]) == 40 and cells[1].isdigit():
                    start, n = int(cells[2]), int(cells[3])
                    yield p, start, start + n - 1, cells[0]

    def read_status(self, _: list[str]) -> Iterator[tuple]:
        rows = self.git("status", "--porcelain", "-z", "--untracked-files=all", "--no-renames").split(b"\0")
        for row in rows:
            if not row:
                continue
            x, y, path = chr(row[0]), chr(row[1]), row[3:].decode("utf-8", "replace")
            if "U" in (x, y) or (x, y) in (("A", "A"), ("D", "D")):
                yield path, CONFLICTED
            else:
                yield path, INDEX_FLAGS.get(x, 0) | WORKTREE_FLAGS.get(y, 0)

    def read_refs(self, _: list[str]) -> Iterator[tuple]:
        head = self.git("symbolic-ref", "-q", "--short", "HEAD", check=False).decode().strip()
        for line in self.git("for-each-ref", "--format=%(refname)%00%(objectname)", "refs/heads", "refs/tags").decode().splitlines():
            name, target = line.split("\0")
            kind = "branch" if name.startswith("refs/heads/") else "tag"
            short = name.split("/", 2)[2]
            yield short, kind, target, kind == "branch" and short == head

    def read_stashes(self, _: list[str]) -> Iterator[tuple]:
        out = self.git("stash", "list", "--format=%H%x00%s", check=False).decode("utf-8", "replace")
        for i, line in enumerate(out.splitlines()):
            hash_, _, message = line.partition("\0")
            yield i, hash_, message

    def read_notes(self, _: list[str]) -> Iterator[tuple]:
        for line in self.git("notes", "list", check=False).decode().splitlines():
            blob, commit = line.split()
            yield commit, self.git("cat-file", "blob", blob).decode("utf-8", "replace")


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "treeloom_git"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)


def read(spark: SparkSession, repo: str, table: str, **options: str) -> DataFrame:
    spark.dataSource.register(GitSource)
    return spark.read.format("treeloom_git").options(repo=repo, table=table, **options).load()
