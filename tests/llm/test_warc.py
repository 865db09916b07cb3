import hashlib
import random

import pyarrow.fs as fs
import pytest
import zstandard

from plumbline.llm import warc
from plumbline.llm._spark import scratch


def brute(pages):
    groups = {}
    for i, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 1000:
            groups.setdefault(data, []).append(i)
    out = []
    for i, url, html in pages:
        data = (html or "").encode()
        last = max((x for x in groups.get(data, []) if x is not None), default=None)
        revisit = last is not None and i != last
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return out


def make(n=150):
    rng = random.Random(2)
    page = lambda: "<html>" + " ".join(rng.choice(["näme", "<p>", "value", "x\r\n\r\ny"]) for _ in range(rng.randrange(0, 500))) + "</html>"
    some = [page() for _ in range(40)]
    pages = [(i, f"http://h/{i}\n", rng.choice(some)) for i in range(n)]
    return pages + [(900, None, None), (901, "u", ""), (902, "u", "z" * 999), (903, "u", "z" * 999), (904, "u", "z" * 1000), (905, "u", "z" * 1000), (905, "u", "z" * 1000), (None, "u", "z" * 1000), (None, "u", "q" * 2000), (None, "u", "q" * 2000), (906, "u", "é" * 500_000)]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 50_000)
    pages = make()
    frame = spark.createDataFrame([(*p, 5) for p in pages], "page_id long, url string, html string, digest int")
    archives = warc.write_archives(frame, scratch(spark, "warc"))
    assert archives.count() > 3
    rows = warc.read_archives(spark, archives).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=key) == sorted(brute(pages), key=key)
    html = {p[0]: (p[2] or "").encode() for p in pages}
    assert all(bytes(r.payload) == html[r.page_id] for r in rows if r.record_type == "response" and r.page_id is not None)
    data = [fs.FileSystem.from_uri(r.path) for r in archives.collect()]
    raw = [store.open_input_stream(path, compression=None).read() for store, path in data]
    assert any(x[:4] == (warc.SKIPPABLE).to_bytes(4, "little") for x in raw)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(warc.unpack(raw[0][:-5]))


def test_archive_with_dictionary_is_smaller():
    rng = random.Random(1)
    records = [warc.encode(i, f"http://host/{i}", b"<html><body class='main content'>" + str(rng.random()).encode() * 20, 0, "00" * 20, None, False, "d") for i in range(2000)]
    packed = warc.pack(records)
    assert packed[:4] == b"\x5d\x2a\x4d\x18"
    assert list(warc.unpack(packed)) == records
    assert len(packed) < sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)


def test_empty(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    archives = warc.write_archives(frame, scratch(spark, "warc"))
    assert warc.read_archives(spark, archives).collect() == []
