"""Reading and writing plain files in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import BinaryIO, TypeVar

import pyarrow.fs as pafs

T = TypeVar("T")


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system that a path or URI belongs to, and the path in it."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri.removeprefix("file:")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class Appender:
    """A new file under ``folder`` whose name no other attempt of a task shares.

    Files of failed attempts stay behind unreferenced: only what a committed
    task returned names its files.
    """

    def __init__(self, folder: str, label: str, suffix: str) -> None:
        self.uri = f"{folder}/{label}-{uuid.uuid4().hex}{suffix}"
        fs, path = located(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out: BinaryIO = fs.open_output_stream(path, compression=None)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Appends ``data``; returns where it begins."""
        begin = self.at
        self.out.write(data)
        self.at += len(data)
        return begin

    def close(self) -> None:
        self.out.close()


class Ranges:
    """Range reads of files, keeping the last file open."""

    def __init__(self) -> None:
        self._uri: str | None = None
        self._file = None

    def size(self, uri: str) -> int:
        return self._open(uri).size()

    def _open(self, uri: str):
        if uri != self._uri:
            self.close()
            fs, path = located(uri)
            self._file, self._uri = fs.open_input_file(path), uri
        return self._file

    def read(self, uri: str, offset: int, length: int) -> bytes:
        data = self._open(uri).read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{uri}: {length} bytes wanted at {offset}, got {len(data)}")
        return data

    def close(self) -> None:
        if self._file is not None:
            self._file.close()
        self._file = self._uri = None


def again(attempt: Callable[[], T], reset: Callable[[], None], tries: int = 3) -> T:
    """``attempt()``, up to ``tries`` times, with ``reset()`` after each failure."""
    for left in range(tries - 1, -1, -1):
        try:
            return attempt()
        except (OSError, ValueError):
            reset()
            if not left:
                raise
    raise AssertionError("tries must be positive")
