"""Media columns: payloads stored as images in archives, read by byte ranges.

A payload is a text's UTF-8 bytes, padded with zeros to a positive multiple of
64. It is stored as an 8-bit greyscale PNG image, 64 samples wide, and images
are collected in archives: members one after another, then a directory of
their places, then a footer that says where the directory begins.

The Spark data source ``treeloom_archives`` plans partitions as byte ranges of
archives, from their sizes alone, so planning is cheap however many members
there are. A task reads the directory of its archive and takes the members
that begin in its range, as payload batches in Arrow form. Each member is
checked against its checksum; one that fails is read again at its offset, on a
new connection, without the rest of the batch.

Archives are named in a manifest, a table that tasks commit; files of failed
attempts aren't in it.

Defined results for odd input: a null or empty text is 64 zero bytes with
``n_bytes`` 0; very long texts are stored whole, alone in their batch; repeated
rows and equal ids are members of their own; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from treeloom.llm.common import scratch, table, tidy
from treeloom.llm.files import Appender, Ranges, again, located

WIDTH = 64
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
#: An entry of an archive's directory: offset, length, checksum, id, whether there is an id.
ENTRY = np.dtype([("offset", "<i8"), ("length", "<i8"), ("crc", "<u4"), ("doc_id", "<i8"), ("has_id", "?")])
FOOTER, FOOTER_BYTES = "<qq8s", 24
MAGIC = b"TLARCH01"


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % WIDTH or (0 if payload else WIDTH))


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """An image whose samples are the padded payload; its true length is in a text chunk."""
    samples = np.frombuffer(padded(payload), np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(samples), WIDTH + 1), np.uint8)  # each line begins with its filter, 0
    lines[:, 1:] = samples
    head = struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)
    body = zlib.compress(lines.tobytes(), 1)
    parts = [chunk(b"IHDR", head), chunk(b"tEXt", b"payload bytes\0%d" % len(payload))]
    parts += [chunk(b"IDAT", body[i : i + (1 << 30)]) for i in range(0, len(body), 1 << 30)]
    return PNG_HEAD + b"".join(parts) + chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[np.ndarray, int]:
    """(samples, payload length) of an image that :func:`to_png` made."""
    if data[:8] != PNG_HEAD:
        raise ValueError("not a PNG image")
    at, body, length, height = 8, [], 0, 0
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + content):
            raise ValueError("a damaged PNG chunk")
        if kind == b"IHDR":
            height = struct.unpack(">IIBBBBB", content)[1]
        elif kind == b"IDAT":
            body.append(content)
        elif kind == b"tEXt" and content.startswith(b"payload bytes\0"):
            length = int(content.partition(b"\0")[2])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered images are stored")
    return np.ascontiguousarray(lines[:, 1:]), length


def feature(samples: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit hash of the picture's light and dark parts."""
    share = np.bincount(samples.ravel(), minlength=256) / samples.size
    values = np.arange(256)
    mean = float(share @ values)
    deviation = float(np.sqrt(max(0.0, share @ values**2 - mean**2)))
    some = share[share > 0]
    entropy = float(-(some * np.log2(some)).sum())
    columns = np.add.reduceat(samples, range(0, WIDTH, 8), axis=1, dtype=np.int64)
    rows = np.linspace(0, len(samples), 9).astype(int)
    cells = np.array([columns[a : max(a + 1, b)].mean(0) if a < len(samples) else np.zeros(8) for a, b in zip(rows[:-1], rows[1:], strict=True)])
    light = np.packbits(cells.ravel() > 8 * mean).tobytes().hex()
    return f"m{mean:.3f}:s{deviation:.3f}:e{entropy:.4f}:h{light}"


MANIFEST = "archive string, bytes long, members long"


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = 128 << 20) -> str:
    """Stores (doc_id, text) in archives under ``folder``; returns the manifest's path."""

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("bytes", pa.int64()), ("members", pa.int64())])
        out, entries = None, []

        def finish() -> pa.RecordBatch:
            begin = out.write(np.array(entries, ENTRY).tobytes())
            out.write(struct.pack(FOOTER, begin, len(entries), MAGIC))
            out.close()
            return pa.RecordBatch.from_pylist([{"archive": out.uri, "bytes": begin, "members": len(entries)}], schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                if out is None:
                    out, entries = Appender(folder, "media", ".tla"), []
                image = to_png(text.as_py() or b"")
                entries.append((out.write(image), len(image), zlib.crc32(image), doc_id.as_py() or 0, doc_id.is_valid))
                if out.at >= archive_bytes:
                    yield finish()
                    out = None
        if out is not None:
            yield finish()

    manifest = f"{folder}/manifest"
    docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(write, MANIFEST).write.parquet(manifest)
    return manifest


class ByteRange(InputPartition):
    """Members of ``archive`` that begin in [start, end)."""

    def __init__(self, archive: str, start: int, end: int) -> None:
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.manifest = options["manifest"]
        self.range_bytes = int(options.get("rangeBytes", 32 << 20))
        self.batch_bytes = int(options.get("batchBytes", 8 << 20))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[ByteRange]:
        fs, path = located(self.manifest)
        sizes = pads.dataset(path, filesystem=fs, format="parquet", exclude_invalid_files=False).to_table(columns=["archive", "bytes"])
        return [
            ByteRange(archive, start, min(start + self.range_bytes, size))
            for archive, size in zip(*(c.to_pylist() for c in sizes.columns), strict=True)
            for start in range(0, size, self.range_bytes)
        ] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        ranges = Ranges()
        entries = again(lambda: directory(ranges, partition.archive), ranges.close, self.tries)
        mine = entries[(entries["offset"] >= partition.start) & (entries["offset"] < partition.end)]
        rows, size = [], 0
        for e in mine:
            rows.append((partition.archive, int(e["offset"]), int(e["doc_id"]) if e["has_id"] else None, self.member(ranges, partition.archive, e)))
            size += len(rows[-1][3])
            if size >= self.batch_bytes:
                yield member_batch(rows)
                rows, size = [], 0
        if rows:
            yield member_batch(rows)
        ranges.close()

    def member(self, ranges: Ranges, archive: str, entry: np.void) -> bytes:
        """One member, read at its offset until its checksum is right."""

        def attempt() -> bytes:
            data = ranges.read(archive, int(entry["offset"]), int(entry["length"]))
            if zlib.crc32(data) != entry["crc"]:
                raise ValueError(f"{archive}: the member at {entry['offset']} is damaged")
            return data

        return again(attempt, ranges.close, self.tries)


def directory(ranges: Ranges, archive: str) -> np.ndarray:
    size = ranges.size(archive)
    begin, members, magic = struct.unpack(FOOTER, ranges.read(archive, size - FOOTER_BYTES, FOOTER_BYTES))
    if magic != MAGIC:
        raise ValueError(f"{archive} is not an archive")
    return np.frombuffer(ranges.read(archive, begin, members * ENTRY.itemsize), ENTRY)


MEMBERS = "archive string, offset long, doc_id long, media binary"


def member_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MEMBERS.split(", ")])


class ArchiveSource(DataSource):
    """``spark.read.format("treeloom_archives").option("manifest", path)``.

    Further options: rangeBytes (bytes of a partition), batchBytes (payload
    bytes of an Arrow batch), tries (for each member).
    """

    @classmethod
    def name(cls) -> str:
        return "treeloom_archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, manifest: str, **options: object) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("treeloom_archives").option("manifest", manifest).options(**{k: str(v) for k, v in options.items()}).load()


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(members: DataFrame) -> DataFrame:
    """What the stored images of ``members`` (doc_id, media) hold."""

    @tidy
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in FEATURES.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, media in zip(batch.column(0), batch.column(1), strict=True):
                data = media.as_py()
                samples, length = from_png(data)
                payload = samples.tobytes()
                digest, crc = hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:])
                rows.append((doc_id.as_py(), length, len(payload), digest, crc, len(data), hashlib.sha256(data).hexdigest(), feature(samples)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return members.select("doc_id", "media").mapInArrow(compute, FEATURES)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "documents", "doc_id", "text"), scratch(spark, "media"))
    return features(read_archives(spark, manifest))
