"""Archives: exact round trips, lookups, damaged reads."""

import base64
import hashlib
import zlib

import pytest

from treeloom.llm import files
from treeloom.llm.common import scratch
from treeloom.llm.files import Ranges
from treeloom.llm.media import ArchiveReader, features, from_png, padded, read_archives, to_png, write_archives
from treeloom.llm.warc import CaptureIndex, Searcher, archive, parsed, read_records, sort_key, surt

PAGES = [
    (5, "http://b.example.com/x?q=1#f", "<p>same</p>"),
    (2, "https://a.example.com:443/y", "<p>same</p>"),
    (9, "https://a.example.com:8443/y", "<p>same</p>"),
    (3, "http://a.example.com/y", "<p>é ü</p>"),
    (4, None, None),
    (6, "not a url\nat all", ""),
    (7, "http://[bad", "z" * 200_000),
    (7, "http://[bad", "z" * 200_000),
    (None, "http://n.example.com/", "<p>same</p>"),
    (None, "http://m.example.com/", "only here"),
    *[(100 + i, f"http://h{i % 7}.example.org/p/{i % 50}", f"page {i % 90}") for i in range(300)],
]


def plain(pages):
    least = {}
    for i, _, html in pages:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        first = least.get(html or "", i)
        kind = "response" if first == i else "revisit"
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if first == i else first))
    return sorted(out, key=repr)


def test_round_trip_and_lookup(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int")
    index = archive(pages, scratch(spark, "warc"), block_lines=16)
    got = read_records(index.locate(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == plain(PAGES)
    one = spark.createDataFrame([(120, "http://h6.example.org/p/20"), (121, "http://nowhere.example.org/")], "page_id long, url string")
    rows = read_records(index.locate(one)).collect()
    assert [(r["page_id"], r["url"], r["payload_bytes"]) for r in rows] == [(120, "http://h6.example.org/p/20", len("page 20"))]
    # every capture is found from the parts alone
    search, ranges = Searcher(index.parts), Ranges()
    for i, url, html in PAGES:
        found = [parsed(ranges.read(*place)) for place in search.find(sort_key(url, i))]
        assert len(found) == sum(1 for j, u, _ in PAGES if (j, u) == (i, url))
        assert all(p == (html or "").encode() for f, p, _ in found if f["WARC-Type"] == "response")


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    index = archive(pages, scratch(spark, "warc"))
    assert isinstance(index, CaptureIndex)
    assert read_records(index.locate(pages)).collect() == []


def test_tab_in_a_url_without_host(spark):
    pages = spark.createDataFrame([(1, "a\tb", "x"), (2, "a", "y"), (3, "a\tb\nc", "z"), (None, "\t", "w")], "page_id long, url string, html string")
    index = archive(pages, scratch(spark, "warc"))
    assert index.captures == 4
    assert sorted(r["url"] for r in read_records(index.locate(pages)).collect()) == ["\t", "a", "a\tb", "a\tb%0Ac"]


def test_surt():
    assert surt("HTTP://www.Example.com:80/a?b#c") == "com,example,www)/a?b"
    assert surt("https://example.com") == "com,example)/"
    assert surt("https://example.com:8080/") == "com,example:8080)/"
    assert surt(None) == ""
    assert surt("no host") == "no host"


TEXTS = [(1, "hello"), (2, None), (3, ""), (4, "é" * 32), (5, "x" * 64), (6, "y" * 500_000), (None, "no id"), (1, "hello"), (7, "z" * 65)]


def test_media(spark):
    docs = spark.createDataFrame([(*t, "c") for t in TEXTS], "doc_id long, text string, media string")
    manifest = write_archives(docs, scratch(spark, "media"), archive_bytes=2000)
    rows = features(read_archives(spark, manifest, rangeBytes=700, batchBytes=1000)).collect()
    want = []
    for i, text in TEXTS:
        raw = (text or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(to_png(raw)), hashlib.sha256(to_png(raw)).hexdigest()))
    assert sorted((tuple(r[:7]) for r in rows), key=repr) == sorted(want, key=repr)
    assert len({r["feature"] for r in rows if r["n_bytes"] == 5 and r["doc_id"] == 1}) == 1
    empty = write_archives(docs.limit(0), scratch(spark, "media"))
    assert read_archives(spark, empty).collect() == []


def test_png():
    for raw in (b"", b"a", bytes(range(256)) * 3):
        samples, length = from_png(to_png(raw))
        assert samples.tobytes() == padded(raw) and length == len(raw)
    with pytest.raises(ValueError):
        from_png(to_png(b"abc")[:-20] + b"0" * 20)


def test_members_are_retried_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string").coalesce(1)
    manifest = write_archives(docs, scratch(spark, "media"))
    reader, reads, failed = ArchiveReader({"manifest": manifest}), [], set()
    (part,) = reader.partitions()
    real = files.Ranges.read

    def flaky(self, uri, offset, length):
        data = real(self, uri, offset, length)
        reads.append(offset)
        if data[:4] == b"\x89PNG" and len(reads) % 2 and offset not in failed:
            failed.add(offset)
            return data[:-1] + b"!"
        return data

    monkeypatch.setattr(files.Ranges, "read", flaky)
    got = [i for batch in reader.read(part) for i in batch.column("doc_id").to_pylist()]
    assert sorted(got) == list(range(5)) and failed
    assert all(reads.count(o) == (2 if o in failed else 1) for o in set(reads[2:]) - set(reads[:2]) | failed)
