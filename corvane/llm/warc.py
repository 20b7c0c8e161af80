"""WARC archives compressed with a dictionary made from their own records.

A file begins with a skippable Zstandard frame that holds the dictionary; every record is a frame of its own after it. The dictionary is
trained on the first records of the file's task, up to a bound, and used as raw content where there are too few to train on.

Of records with equal payloads (of at least ``least`` bytes) the one with the largest page_id is a response, the others
revisit it. Only digests are grouped, after partial aggregation; pages then join their digest's row, and a payload that a third of all pages have
is split by the engine's skew join.

Edge cases: a null html is an empty payload; a null page_id is never the largest, revisits if its payload has another, and is
a response else; of repeated rows with the largest page_id each is a response; a null url gives no target; an empty table gives no file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import bound_batches, filesystem, work_folder

SKIPPABLE = 0x184D2A5D
DICTIONARY = 64 << 10
SAMPLE = 2 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
_FILES = "name string, records long"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def _uri(url: str) -> str:
    return quote(url, safe="%/:?#[]@!$&'()*+,;=-._~")


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, first_url: str | None) -> bytes:
    """``first``: the page_id of the response that this record revisits, else None."""
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _uri(url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Page-ID", "" if page_id is None else str(page_id)), ("Payload-Length", str(len(payload)))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if first is None:
        block = http + payload
    else:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first)), ("Refers-To-Page-ID", str(first))]
        if first_url is not None:
            head.append(("WARC-Refers-To-Target-URI", _uri(first_url)))
        block = http
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, and the payload after the block's HTTP head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Writer:
    def __init__(self, uri: str, name: str):
        self.system, folder = filesystem(uri)
        self.system.create_dir(folder)
        self.file = self.system.open_output_stream(f"{folder}/{name}")
        self.held: list[bytes] = []
        self.size = 0
        self.compressor: zstandard.ZstdCompressor | None = None
        self.records = 0

    def add(self, raw: bytes) -> None:
        self.records += 1
        if self.compressor:
            self.file.write(self.compressor.compress(raw))
            return
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= SAMPLE:
            self._start()

    def _start(self) -> None:
        words = train(self.held)
        data = words.as_bytes()
        self.file.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=words)
        for raw in self.held:
            self.file.write(self.compressor.compress(raw))
        self.held = []

    def close(self) -> None:
        if not self.compressor:
            self._start()
        self.file.close()


def read(uri: str, name: str) -> Iterator[bytes]:
    """The records of a file, one frame at a time."""
    system, folder = filesystem(uri)
    with system.open_input_stream(f"{folder}/{name}") as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{name} has no dictionary")
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(size)))
        left, out, frame = b"", [], decompressor.decompressobj()
        while left or (left := f.read(1 << 20)):
            out.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else b""
            if frame.eof:
                yield b"".join(out)
                out, frame = [], decompressor.decompressobj()
        if any(out):
            raise ValueError(f"{name} ends within a record")


def assign(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url and payload of every row, with ``first`` and ``first_url``: the response that it revisits, or null."""
    bound_batches(pages.sparkSession)
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = raw.withColumn("digest", F.sha1("payload"))
    best = keyed.select("digest", "page_id", "url").groupBy("digest").agg(F.max("page_id").alias("best"), F.max_by("url", "page_id").alias("best_url")).withColumnRenamed("digest", "best_digest")
    revisits = (F.octet_length("payload") >= least) & F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    joined = keyed.join(best, F.col("digest") == F.col("best_digest"))
    return joined.select("page_id", "url", "payload", F.when(revisits, F.col("best")).alias("first"), F.when(revisits, F.col("best_url")).alias("first_url"))


def write(pages: DataFrame, folder: str, least: int = 0) -> list[str]:
    """Archive every row; the names of the files of the attempts that ended well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out = f"pages-{uuid.uuid4().hex}.warc.zst", None
        for batch in batches:
            for row in zip(*(batch.column(k) for k in ("page_id", "url", "payload", "first", "first_url")), strict=True):
                out = out or Writer(folder, name)
                out.add(record(*(x.as_py() for x in row)))
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "records": [out.records]})

    return sorted(r.name for r in assign(pages, least).mapInArrow(run, _FILES).collect())  # a row for each file


def read_records(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """What the archives say of every page. A response's payload is hashed again and must have its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows: list[dict] = []
                for raw in read(folder, name):
                    fields, payload = parse(raw)
                    said, size, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["Payload-Length"]), fields["WARC-Type"]
                    if kind == "response" and (digest(payload), len(payload)) != (said, size):
                        raise ValueError(f"{name}: {fields['WARC-Record-ID']} has another payload")
                    refers = fields.get("Refers-To-Page-ID")
                    rows.append({"page_id": int(fields["Page-ID"]) if fields["Page-ID"] else None, "payload_bytes": size, "payload_digest": said, "record_type": kind, "refers_to": None if refers is None else int(refers)})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    files = spark.createDataFrame([(n,) for n in names], "name string")
    return files.repartition(max(1, len(names)), "name").mapInArrow(run, _RECORDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    folder = work_folder(pages.sparkSession, "warc")
    return read_records(pages.sparkSession, folder, write(pages, folder, least))
