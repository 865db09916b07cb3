"""Dictionary-compressed WARC archives (.warc.zst).

An archive begins with a skippable frame that holds a Zstandard dictionary, built from records of this very
archive; every record follows as a frame of its own, compressed with it. Tasks write their partition's
records into archives of bounded size, through the store of the shared folder, under a name of their own,
and rename an archive when it is whole; only archives that a task reported are read back.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._spark import scratch, written

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
LEAST_DUPLICATE = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'page:{page_id}')}>"


def clean(value: str | None) -> str:
    """A header's value: no line breaks."""
    return " ".join((value or "").split())


def encode(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header of the page, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {clean(url)}"] if url is not None else []), f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Profile: {PROFILE}", *([f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else [])] if revisit else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on evenly spread records of at most SAMPLE_BYTES; none where they are too few to train one."""
    share = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    samples = [r[: SAMPLE_BYTES // 8] for r in records[::share]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8)
    except (zstandard.ZstdError, ValueError):
        return None


def pack(records: list[bytes]) -> bytes:
    """An archive: the dictionary in a skippable frame (if there is one), then a frame for each record."""
    trained = dictionary(records)
    head = b""
    if trained is not None:
        data = trained.as_bytes()
        head = struct.pack("<II", SKIPPABLE, len(data)) + data
    press = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True)
    return head + b"".join(map(press.compress, records))


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    at, trained = 0, None
    if len(archive) >= 8:
        magic, size = struct.unpack_from("<II", archive)
        if magic == SKIPPABLE:
            trained, at = zstandard.ZstdCompressionDict(archive[8 : 8 + size]), 8 + size
    view = memoryview(archive)
    while at < len(archive):
        reader = zstandard.ZstdDecompressor(dict_data=trained).decompressobj()
        parts, begin = [], at
        while not reader.eof:
            if at >= len(archive):
                raise ValueError(f"the archive ends within the record at byte {begin}")
            parts.append(reader.decompress(view[at : at + (1 << 16)]))
            at += 1 << 16
        at = min(at, len(archive)) - len(reader.unused_data)
        yield b"".join(parts)


def decode(record: bytes) -> dict:
    """A record's fields; a payload that is there is held against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    body = rest[: int(fields["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = fields["warc-type"]
    if not version.startswith("WARC/") or kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"a damaged record: {fields.get('warc-record-id')}")
    number = lambda x: int(x) if x is not None else None
    return {
        "page_id": number(fields.get("x-page")), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None,
        "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("x-refers-to-page")),
    }


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest, revisit and refers_to of the record that each page gets.

    Payloads are equal when length, SHA-1 and a 64-bit hash are. Copies are counted before rows move: a
    payload that a third of all pages hold is one row of each task.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html")).withColumns(
        {"digest": F.sha1("html"), "key": F.xxhash64("html"), "length": F.octet_length("html").cast("long")}
    )
    same = ["digest", "key", "length"]
    shared = rows.where(F.col("length") >= LEAST_DUPLICATE).groupBy(*same).agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    revisit = F.col("response").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("response"), F.lit(False))
    return rows.join(shared, same, "left").select("page_id", "url", "html", "digest", "length", revisit.alias("revisit"), F.when(revisit, F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z", **columns: str) -> DataFrame:
    """Write a record for each page into archives below path (a URI of any store pyarrow knows).

    Returns a row for each archive: path, records, bytes, raw_bytes. Null html is an empty payload. Of pages
    with equal payloads of at least 1000 bytes, the one with the largest page_id is the response and the others
    revisit it; rows that repeat that page_id are responses too, a null page_id revisits any other. Where all
    ids of such a group are null, all are responses. An empty table writes no archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name, number, records, size = uuid.uuid4().hex, 0, [], 0

        def close() -> pa.RecordBatch:
            data = pack(records)
            at = f"{folder}/part-{name}-{number:05d}.warc.zst"
            with store.open_output_stream(f"{folder}/_writing-{name}", compression=None) as out:
                out.write(data)
            store.move(f"{folder}/_writing-{name}", at)
            return pa.RecordBatch.from_pydict({"path": [f"{path.rstrip('/')}/{at.rpartition('/')[2]}"], "records": pa.array([len(records)], pa.int64()), "bytes": pa.array([len(data)], pa.int64()), "raw_bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for r in batch.to_pylist():
                records.append(encode(r["page_id"], r["url"], r["html"].encode(), r["length"], r["digest"], r["refers_to"], r["revisit"], date))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, records, size = number + 1, [], 0
        if records:
            yield close()

    archives = plan_records(pages, **columns).mapInArrow(write, "path string, records long, bytes long, raw_bytes long")
    return written(archives, "archives")


def read_archives(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """The records of the archives that write_archives() reported, as page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as file:
                    data, rows, size = file.read(), [], 0
                for row in map(decode, unpack(data)):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(read, READ) if archives.take(1) else spark.createDataFrame([], READ)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the whole of pages as archives, read them back."""
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch(spark, "warc"))
    return read_archives(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT html, max(page_id) AS last, count(*) AS copies FROM p WHERE n >= 1000 GROUP BY html)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN copies > 1 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN copies > 1 AND page_id <> last THEN last END AS refers_to
FROM p LEFT JOIN g USING (html)
"""
