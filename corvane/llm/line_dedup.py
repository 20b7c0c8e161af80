"""Line de-duplication across documents.

Every line has a key: the line without ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased. A key of at
least ``min_chars`` code points that at least two documents hold stays only in the smallest doc_id.

How: a task hashes the lines of its documents (128 bits) and settles what it can: of the documents it
holds for a key only the smallest can keep it. What remains, at most one document for a key and chunk, is
dealt out by ranges of the hash, sorted by hash, document and position, and streamed: the first document of
a hash keeps its lines, all later ones lose them. A key that a third of all lines has is thus as many rows
as there were chunks. The result is a compressed bitmap for each document that loses lines, never text.

Edge cases: a null or empty text is one empty line. Rows with one doc_id count as one document; a null
doc_id is one document too, after all others. Rows are told apart by doc_id and a hash of the text, so
repeated rows get the same decision. Documents that lose nothing have no bitmap.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import chunks, keyed_text, materialise, released

SPACES = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

_LINES = "h1 long, h2 long, doc_id long, row_hash long, n_lines int, positions array<int>, lost boolean"
_LOST = "doc_id long, row_hash long, n_lines int, positions array<int>"
_BITMAPS = "doc_id long, row_hash long, n_lines long, n_dropped long, keep_bitmap binary"


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8"))


def _ids(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    null = np.asarray(column.is_null())
    return null, np.asarray(column.fill_null(0)).astype(np.int64)


def _settle_chunks(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches, max_bytes=16 << 20, max_rows=100_000):
            digests: list[bytes] = []
            owner: list[int] = []
            position: list[int] = []
            n_lines = np.ones(table.num_rows, np.int32)
            for row, text in enumerate(table.column("text").to_pylist()):
                lines = (text or "").encode("utf-8").split(b"\n")
                n_lines[row] = len(lines)
                for at, line in enumerate(lines):
                    if len(line) >= min_chars:
                        key = line.strip(SPACES)
                        if len(key) >= min_chars and _code_points(key) >= min_chars:
                            digests.append(xxhash.xxh3_128_digest(key.translate(LOWER)))
                            owner.append(row)
                            position.append(at)
            if not digests:
                continue
            halves = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2)
            h1, h2 = halves[:, 0].astype(np.int64), halves[:, 1].astype(np.int64)
            own, pos = np.array(owner, np.int64), np.array(position, np.int32)
            null, ids = _ids(table.column("doc_id"))
            hashes = np.asarray(table.column("row_hash")).astype(np.int64)
            order = np.lexsort((pos, own, hashes[own], ids[own], null[own], h2, h1))
            h1, h2, own, pos = h1[order], h2[order], own[order], pos[order]
            new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_row = new_key | np.r_[True, own[1:] != own[:-1]]
            first = own[np.flatnonzero(new_key)][np.cumsum(new_key) - 1]
            lost = (ids[own] != ids[first]) | (null[own] != null[first])
            starts = np.flatnonzero(new_row)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(own)], pa.int32()), pa.array(pos, pa.int32()))
            at = own[starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[starts]), pa.array(h2[starts]), pa.array(ids[at], mask=null[at]), pa.array(hashes[at]), pa.array(n_lines[at]), lists, pa.array(lost[starts])],
                ["h1", "h2", "doc_id", "row_hash", "n_lines", "positions", "lost"],
            )

    return run


def _later_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hash, document and position: pass on those that are not of their hash's first document."""
    before: tuple[int, int, bool, int] | None = None  # hash, and the first document's null flag and id
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = (np.asarray(batch.column(k)) for k in ("h1", "h2"))
        null, ids = _ids(pa.chunked_array([batch.column("doc_id")]))
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        starts = np.flatnonzero(new)
        first_null, first_id = null[starts], ids[starts]
        if before and before[:2] == (h1[0], h2[0]):
            first_null[0], first_id[0] = before[2:]
        group = np.cumsum(new) - 1
        later = (ids != first_id[group]) | (null != first_null[group])
        before = (int(h1[-1]), int(h2[-1]), bool(first_null[-1]), int(first_id[-1]))
        if later.any():
            yield batch.filter(pa.array(later)).select(["doc_id", "row_hash", "n_lines", "positions"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for n, lists in zip(batch.column("n_lines").to_pylist(), batch.column("lists"), strict=True):
            keep = np.ones(n, np.uint8)
            keep[np.asarray(lists.values.flatten())] = 0
            maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            dropped.append(n - int(keep.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_hash"), batch.column("n_lines").cast(pa.int64()), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())],
            ["doc_id", "row_hash", "n_lines", "n_dropped", "keep_bitmap"],
        )


def _with_row_hash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed_text(docs, id_col, text_col).withColumn("row_hash", F.xxhash64("text"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """doc_id, row_hash, n_lines, n_dropped and keep_bitmap (zlib over bits, first line lowest) of rows that lose lines."""
    lines = materialise(_with_row_hash(docs, id_col, text_col).mapInArrow(released(_settle_chunks(min_chars)), _LINES), "line-hashes")
    streamed = (
        lines.filter(~F.col("lost")).select("h1", "h2", "doc_id", "row_hash", "n_lines", "positions")
        .repartitionByRange("h1", "h2")
        .sortWithinPartitions("h1", "h2", F.col("doc_id").asc_nulls_last(), "row_hash")
        .mapInArrow(_later_documents, _LOST)
    )
    lost = lines.filter("lost").select("doc_id", "row_hash", "n_lines", "positions").unionByName(streamed)
    return (
        lost.groupBy("doc_id", "row_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_list("positions").alias("lists"))
        .mapInArrow(_bitmaps, _BITMAPS)
    )


def kept_lines(text: str | None, bitmap: bytes | None) -> tuple[int, int, str]:
    """Lines, lines dropped, and the text that stays."""
    if bitmap is None:
        return (text or "").count("\n") + 1, 0, text or ""
    lines = (text or "").split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines), bitorder="little")
    stay = [line for line, k in zip(lines, keep.tolist(), strict=True) if k]
    return len(lines), len(lines) - len(stay), "\n".join(stay)


def _joined(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    marks = bitmaps.select(F.col("doc_id").alias("__b_id"), F.col("row_hash").alias("__b_hash"), F.col("keep_bitmap").alias("__bitmap"))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__b_id")) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("__b_hash"))
    return docs.join(marks, same, "left").drop("__b_id", "__b_hash")


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the bitmaps' lines gone; all columns and rows stay."""

    @F.pandas_udf("string")
    def stay(text: pd.Series, bitmap: pd.Series) -> pd.Series:
        return pd.Series([t if b is None else kept_lines(t, b)[2] for t, b in zip(text, bitmap, strict=True)], dtype=object)

    return _joined(docs, bitmaps, id_col, text_col).withColumn(text_col, stay(F.col(f"`{text_col}`").cast("string"), F.col("__bitmap"))).drop("__bitmap")


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (of the lines that stay, joined by \\n) for every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_lines(t, b) for t, b in zip(batch.column("text").to_pylist(), batch.column("__bitmap").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    texts = keyed_text(docs, id_col, text_col)
    return _joined(texts, keep_bitmaps(texts, min_chars=min_chars), "doc_id", "text").mapInArrow(released(digest), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
