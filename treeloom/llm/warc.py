"""WARC archives of pages, and a two-level index of their captures.

Each page becomes a record: a response with its payload, or, if a page with a
smaller id has the same payload, a revisit that refers to that page. Records
are compressed one by one, so each can be read alone at its offset.

The index is sorted by the URL's reversed-host key (``com,example,www)/path``)
and page id. Sorted lines go into compressed blocks; a sparse directory keeps
each block's first line. Looking a capture up is a binary search of the
directory's parts, then of one part's blocks, then of one block's lines, and
last a range read of the record. Blocks and directory parts are files; the
driver knows only one first line for each part.

Defined results for odd input: a null html is an empty payload; equal payloads
of any length share one response, also empty ones; rows that repeat the
smallest id of a payload are all responses; a null page_id comes after all
others and is never referred to if another page has the payload; a null or
unparsable url is its own text as key; very long pages are one record; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import looked_up, scratch, table, tidy, written
from treeloom.llm.files import Appender, Ranges, again

#: Default ports, which keys leave out.
PORTS = {"http": 80, "https": 443}
#: Greater than any page id, for pages without one.
LAST = 1 << 63
BLOCK_LINES = 512


def surt(url: str | None) -> str:
    """The URL with its host's labels reversed, so that hosts sort by domain."""
    try:
        u = urlsplit(url or "")
        host, port = u.hostname, u.port
    except ValueError:
        return url or ""
    if not host:
        return url or ""
    labels = ",".join(reversed(host.rstrip(".").split(".")))
    tail = f":{port}" if port and port != PORTS.get(u.scheme) else ""
    return f"{labels}{tail}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def sort_key(url: str | None, page_id: int | None) -> str:
    """One text that sorts by key, then by id."""
    return f"{surt(url)} {LAST if page_id is None else page_id + LAST // 2:020d}".replace("\n", "%0A").replace("\t", "%09")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str) -> bytes:
    """One compressed record."""
    digest = f"sha1:{base32_sha1(payload)}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>",
        "WARC-Date": date,
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": digest,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(body)),
        "Page-ID": "" if page_id is None else str(page_id),
    }
    if revisit:
        head |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "Refers-To-Page-ID": "" if first is None else str(first),
        }
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    squeeze = zlib.compressobj(1, wbits=31)
    return squeeze.compress(text.encode("utf-8", "surrogateescape") + body + b"\r\n\r\n") + squeeze.flush()


def parsed(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """(headers, payload, full payload's length) of a compressed record."""
    raw = zlib.decompress(data, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.partition(": ")[::2] for line in head.decode("utf-8").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    return fields, payload, length


def with_firsts(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, first, revisit): which page has the payload's response."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.encode(F.col("html").cast("string"), "utf-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    shared = written(
        rows.groupBy("digest").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.struct("least").alias("first"), "n"),
        "payloads",
    )
    total = shared.agg(F.sum("n")).first()[0] or 1
    found = looked_up(rows, shared, "digest", "first", "n", total, "page_id")
    revisit = F.col("first").isNotNull() & ~F.col("first.least").eqNullSafe(F.col("page_id"))
    return found.select("page_id", "url", "payload", F.col("first.least").alias("first"), revisit.alias("revisit"))


CAPTURES = "key string, page_id long, file string, offset long, length long"


def write_records(rows: DataFrame, folder: str, date: str, file_bytes: int) -> DataFrame:
    """Writes the records of :func:`with_firsts`; returns where each one lies."""

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = [x.split()[0] for x in CAPTURES.split(", ")], None
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        for batch in batches:
            made = []
            for page_id, url, payload, first, revisit in zip(*(c for c in batch.columns), strict=True):
                if out is None or out.at >= file_bytes:
                    if out is not None:
                        out.close()
                    out = Appender(folder, "pages", ".warc.gz")
                page_id, url = page_id.as_py(), url.as_py()
                data = record(page_id, url, payload.as_py(), first.as_py(), revisit.as_py(), date)
                made.append((sort_key(url, page_id), page_id, out.uri, out.write(data), len(data)))
            columns = list(zip(*made, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        if out is not None:
            out.close()

    return rows.mapInArrow(write, CAPTURES)


PARTS = "first string, blocks string, directory string, captures long"


def write_index(captures: DataFrame, folder: str, block_lines: int) -> DataFrame:
    """Blocks and a directory file for each sorted partition; one row for each part."""

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, entries, lines, first_line, n = None, [], [], None, 0

        def flush() -> None:
            data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
            entries.append((lines[0].partition("\t")[0], out.write(data), len(data)))
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, first_line = Appender(folder, "index", ".cdx"), row[0]
                lines.append("\t".join((row[0], row[2], str(row[3]), str(row[4]))))
                n += 1
                if len(lines) == block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        out.close()
        sparse = Appender(folder, "directory", ".json")
        sparse.write(json.dumps({"first": [e[0] for e in entries], "offset": [e[1] for e in entries], "length": [e[2] for e in entries]}).encode())
        sparse.close()
        yield pa.RecordBatch.from_pylist([{"first": first_line, "blocks": out.uri, "directory": sparse.uri, "captures": n}])

    return captures.select("key", "page_id", "file", "offset", "length").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(write, PARTS)


class Searcher:
    """Binary search for captures, given the parts in order of their first lines."""

    def __init__(self, parts: list[tuple[str, str, str]], blocks_kept: int = 8) -> None:
        self.parts, self.firsts = parts, [p[0] for p in parts]
        self.ranges, self.directories, self.blocks, self.kept = Ranges(), {}, {}, blocks_kept

    def _directory(self, part: int) -> dict:
        if part not in self.directories:
            uri = self.parts[part][2]
            data = again(lambda: self.ranges.read(uri, 0, self.ranges.size(uri)), self.ranges.close)
            self.directories = {part: json.loads(data)}  # lookups come in order: the last one is enough
        return self.directories[part]

    def _block(self, part: int, block: int) -> tuple[list[str], list[str]]:
        if (part, block) not in self.blocks:
            at, uri = self._directory(part), self.parts[part][1]
            data = again(lambda: zlib.decompress(self.ranges.read(uri, at["offset"][block], at["length"][block])), self.ranges.close)
            lines = data.decode("utf-8", "surrogatepass").split("\n")
            if len(self.blocks) >= self.kept:
                self.blocks.pop(next(iter(self.blocks)))
            self.blocks[part, block] = ([x.partition("\t")[0] for x in lines], lines)
        return self.blocks[part, block]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of every capture with this key, in order."""
        part = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while part < len(self.parts) and self.firsts[part] <= key:
            firsts = self._directory(part)["first"]
            block = max(0, bisect.bisect_left(firsts, key) - 1)
            while block < len(firsts) and firsts[block] <= key:
                keys, lines = self._block(part, block)
                for i in range(bisect.bisect_left(keys, key), bisect.bisect_right(keys, key)):
                    _, file, offset, length = lines[i].split("\t")
                    yield file, int(offset), int(length)
                block += 1
            part += 1


class CaptureIndex:
    """An index in the shared folder, and lookups by URL and page id."""

    def __init__(self, spark: SparkSession, parts: list[tuple[str, str, str]], captures: int = 0) -> None:
        self.spark, self.parts, self.captures = spark, parts, captures

    @classmethod
    def build(cls, captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> CaptureIndex:
        rows = written(write_index(captures, folder, block_lines), "parts").orderBy("first").collect()  # one row for each partition
        return cls(captures.sparkSession, [(r["first"], r["blocks"], r["directory"]) for r in rows], sum(r["captures"] for r in rows))

    def locate(self, wanted: DataFrame) -> DataFrame:
        """(file, offset, length) of the captures of ``wanted`` (page_id, url), each record once."""
        parts = self.spark.sparkContext.broadcast(self.parts)

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [sort_key(u, p) for p, u in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["key"])

        @tidy
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Searcher(parts.value)
            for batch in batches:
                found = [x for key in batch.column(0).to_pylist() for x in index.find(key)]
                columns = list(zip(*found, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "offset", "length"])

        sorted_keys = wanted.select("page_id", "url").mapInArrow(keys, "key string").distinct().repartitionByRange("key").sortWithinPartitions("key")
        return sorted_keys.mapInArrow(search, "file string, offset long, length long")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(places: DataFrame, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records at ``places`` (file, offset, length), by range reads.

    Neighbours less than ``gap`` bytes apart are read together, up to ``most``.
    A response's digest is computed from the payload that was read.
    """

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, names = Ranges(), [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in RECORDS.split(", ")]

        def one(data: bytes) -> tuple:
            fields, payload, length = parsed(data)
            kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and (base32_sha1(payload) != digest or len(payload) != length):
                raise ValueError("a record's payload and digest disagree")
            number = lambda s: int(s) if s else None
            return number(fields["Page-ID"]), fields["WARC-Target-URI"], length, digest, kind, number(fields.get("Refers-To-Page-ID", ""))

        def run(file: str, places: list[tuple[int, int]]) -> list[tuple]:
            begin, end = places[0][0], places[-1][0] + places[-1][1]
            data = ranges.read(file, begin, end - begin)
            return [one(data[o - begin : o - begin + n]) for o, n in places]

        def runs(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
            file, places = None, []
            for f, o, n in rows:
                if places and (f != file or o - sum(places[-1]) > gap or o + n - places[0][0] > most):
                    yield file, places
                    places = []
                file = f
                places.append((o, n))
            if places:
                yield file, places

        for batch in batches:
            made = []
            for file, places in runs(list(zip(*(c.to_pylist() for c in batch.columns), strict=True))):
                made += again(lambda f=file, p=places: run(f, p), ranges.close)
            columns = list(zip(*made, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        ranges.close()

    near = places.select("file", "offset", "length").repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return near.mapInArrow(read, RECORDS)


def archive(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 1 << 30, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Writes (page_id, url, html) as records under ``folder`` and indexes them."""
    captures = written(write_records(with_firsts(pages), folder, date, file_bytes), "captures")
    return CaptureIndex.build(captures, folder, block_lines)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    index = archive(pages, scratch(spark, "warc"))
    places = written(index.locate(pages), "places")
    if (found := places.count()) != index.captures:
        raise ValueError(f"{index.captures} records were written, {found} are found")
    read = read_records(places)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
