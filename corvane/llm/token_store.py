"""Token ids in binary shards with a minimal perfect hash index.

A shard is a header (magic, id width), the raw little-endian ids of its documents one after the other, and an index: the
documents' first ids and keys in order, and a minimal perfect hash from key to slot with a stored 32-bit
fingerprint, the place of the key's first document and how many follow with that key. All parts have fixed-width entries at offsets
that the shard's tail names. A lookup (``Shard.get``) hashes the key twice at most and reads the entries of one bucket, one slot and one place and then
one range of ids, however large the shard: the tail is all that is read to open it. The fingerprint turns away nearly all absent
keys, the stored key the rest. ``manifest.json`` has the shards in ascending order of keys, with their key ranges and first ids; ``Store`` reads it once and keeps
the shards that it has opened.

Documents are dealt out by ranges of doc_id, a hash of the text and the input partition, so that neither a doc_id nor copies of one row that are a third of all
rows fill one shard. A
task streams its ids to a file of its own name; the manifest names the files of the attempts that ended well, and others are removed.

Edge cases: a null or empty text has the end id alone; null doc_ids come first and have no key; rows with one doc_id follow each other
and share a key; an empty table gives a manifest without shards. Ids are 16 bits wide if the vocabulary allows, else 32.
"""

from __future__ import annotations

import json
import struct
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import filesystem, keyed_text, work_folder
from corvane.llm.tokens import crc, encoded, encoder

MAGIC = b"CVTOKS01"
_MANIFEST = "part int, name string, documents long, tokens long, low long, high long, nulls long"
_DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"
_READ = 4 << 20


def mix(key: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """64 well-mixed bits of key and seed (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + (np.asarray(seed).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return z ^ z >> np.uint64(31)


class PerfectHash:
    """Keys to 0 .. n-1 by hash and displace: buckets of several keys get a seed that puts them to free slots, single keys their slot outright."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        table = np.zeros(n, np.int64)
        if not n:
            return cls(table)
        bucket = (mix(keys, 0) % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
        sizes = np.diff(np.r_[starts, n])
        free = np.ones(n, bool)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[sizes[by_size] > 1].tolist():
            own = keys[order[starts[b] : starts[b] + sizes[b]]]
            seed = 1
            while True:
                slot = mix(own, seed) % np.uint64(n)
                if free[slot].all() and len(set(slot.tolist())) == len(own):
                    break
                seed += 1
            free[slot] = False
            table[bucket[order[starts[b]]]] = seed
        single = by_size[sizes[by_size] == 1]
        table[bucket[order[starts[single]]]] = -1 - np.flatnonzero(free)[: len(single)]
        return cls(table)

    @staticmethod
    def slot(keys: np.ndarray, held: np.ndarray, n: int) -> np.ndarray:
        """The slots of keys whose buckets hold ``held``."""
        return np.where(held < 0, -1 - held, (mix(keys, np.maximum(held, 0)) % np.uint64(n)).astype(np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        n = len(self.table)
        return self.slot(keys, self.table[(mix(keys, 0) % np.uint64(n)).astype(np.int64)], n)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0xF1A9) >> np.uint64(32)).astype("<u4")


class _Writer:
    def __init__(self, uri: str, name: str, width: int):
        self.system, folder = filesystem(uri)
        self.system.create_dir(folder)
        self.file = self.system.open_output_stream(f"{folder}/{name}")
        self.width = width
        self.file.write(MAGIC + struct.pack("<I", width))
        self.keys: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, ids: np.ndarray, sizes: np.ndarray, keys: np.ndarray, nulls: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(ids, f"<u{self.width}").tobytes())
        self.keys.append(keys)
        self.nulls.append(nulls)
        self.sizes.append(sizes)

    def close(self) -> tuple[int, int, int | None, int | None, int]:
        keys, nulls = np.concatenate(self.keys), np.concatenate(self.nulls)
        starts = np.r_[0, np.cumsum(np.concatenate(self.sizes))].astype("<u8")
        there = np.flatnonzero(~nulls)
        distinct, first, count = np.unique(keys[there], return_index=True, return_counts=True)
        hashed = PerfectHash.build(distinct)
        slot = hashed.slots(distinct) if len(distinct) else np.empty(0, np.int64)
        prints, places, counts = (np.zeros(len(distinct), t) for t in ("<u4", "<u8", "<u4"))
        prints[slot], places[slot], counts[slot] = fingerprints(distinct), there[first] if len(there) else first, count
        parts = {"starts": starts, "keys": keys.astype("<i8"), "nulls": nulls.astype("u1"), "table": hashed.table.astype("<i8"), "prints": prints, "places": places, "counts": counts}
        for a in parts.values():
            self.file.write(a.tobytes())
        tail = json.dumps({k: [a.dtype.str, len(a)] for k, a in parts.items()}).encode()
        self.file.write(tail + struct.pack("<I", len(tail)))
        self.file.close()
        low, high = (int(distinct[0]), int(distinct[-1])) if len(distinct) else (None, None)
        return len(keys), int(starts[-1]), low, high, int(nulls.sum())


class Shard:
    """An open shard. Only its tail is in memory; entries and ids are read when asked for."""

    def __init__(self, uri: str, name: str):
        system, folder = filesystem(uri)
        self.file = system.open_input_file(f"{folder}/{name}")
        head = self.file.read_at(12, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{name} is no shard")
        self.width = struct.unpack("<I", head[8:])[0]
        size = self.file.size()
        n = struct.unpack("<I", self.file.read_at(4, size - 4))[0]
        at = size - 4 - n
        self.parts: dict[str, tuple[int, np.dtype, int]] = {}
        for k, (kind, count) in reversed(json.loads(self.file.read_at(n, at)).items()):
            at -= np.dtype(kind).itemsize * count
            self.parts[k] = (at, np.dtype(kind), count)

    def size(self, part: str) -> int:
        return self.parts[part][2]

    def entries(self, part: str, first: int, n: int) -> np.ndarray:
        at, kind, _ = self.parts[part]
        return np.frombuffer(self.file.read_at(n * kind.itemsize, at + first * kind.itemsize), kind)

    def _at(self, part: str, places: np.ndarray) -> np.ndarray:
        """Entries at any places: each read alone if they are few, all at once else."""
        if len(places) <= 4:
            return np.concatenate([self.entries(part, int(p), 1) for p in places]) if len(places) else self.entries(part, 0, 0)
        return self.entries(part, 0, self.size(part))[places]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key the place of its first document in the shard, or -1, and how many it has."""
        n = self.size("table")
        if not n:
            return np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        held = self._at("table", (mix(keys, 0) % np.uint64(n)).astype(np.int64))
        slot = PerfectHash.slot(keys, held, n)
        place = self._at("places", slot).astype(np.int64)
        there = self._at("prints", slot) == fingerprints(keys)
        there[there] = self._at("keys", place[there]) == keys[there]
        return np.where(there, place, -1), np.where(there, self._at("counts", slot), 0).astype(np.int64)

    def starts(self, first: int, last: int) -> np.ndarray:
        """Where the ids of the documents from place first to last begin; last may be one beyond the last document."""
        return self.entries("starts", first, last - first + 1).astype(np.int64)

    def ids(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - begin) * self.width, 12 + begin * self.width), f"<u{self.width}")

    def get(self, key: int) -> list[np.ndarray]:
        places, counts = self.find(np.array([key], np.int64))
        if places[0] < 0:
            return []
        starts = self.starts(int(places[0]), int(places[0] + counts[0])).tolist()
        return [self.ids(a, b) for a, b in zip(starts, starts[1:], strict=False)]


def write(docs: DataFrame, folder: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Write all documents' ids to ``folder`` in ascending order of doc_id; the manifest's shards."""
    spark = docs.sparkSession
    ordered = keyed_text(docs, id_col, text_col).withColumn("row_hash", F.xxhash64("text")).withColumn("input", F.spark_partition_id())
    ordered = ordered.repartitionByRange("doc_id", "row_hash", "input").sortWithinPartitions("doc_id", "row_hash", "input").drop("input")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        width = 2 if encoder(vocabulary).tokenizer.get_vocab_size() <= 1 << 16 else 4
        part = TaskContext.get().partitionId()
        name, out = f"shard-{part:05d}-{uuid.uuid4().hex}.ids", None
        for table, ids, ends in encoded(vocabulary, batches):
            out = out or _Writer(folder, name, width)
            keys = table.column("doc_id").combine_chunks()
            out.add(ids, np.diff(np.r_[0, ends]), np.asarray(keys.fill_null(0)).astype(np.int64), np.asarray(keys.is_null()))
        if out:
            documents, tokens, low, high, nulls = out.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "documents": documents, "tokens": tokens, "low": low, "high": high, "nulls": nulls}], pa.schema([("part", pa.int32()), ("name", pa.string()), *((k, pa.int64()) for k in ("documents", "tokens", "low", "high", "nulls"))]))

    shards, start = [], 0
    for r in sorted(ordered.mapInArrow(run, _MANIFEST).collect(), key=lambda r: r.part):  # a row for each shard
        shards.append(r.asDict() | {"start": start})
        start += r.tokens
    system, path = filesystem(folder)
    system.create_dir(path)
    with system.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps({"vocabulary": vocabulary.rpartition("/")[2], "tokens": start, "shards": shards}).encode())
    names = {s["name"] for s in shards} | {"manifest.json"}
    from pyarrow import fs

    for info in system.get_file_info(fs.FileSelector(path)):
        if info.type == fs.FileType.File and info.base_name not in names and info.base_name.startswith("shard-"):
            system.delete_file(info.path)
    return shards


def manifest(folder: str) -> dict:
    system, path = filesystem(folder)
    with system.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())


class Store:
    """Keyed access to a folder of shards."""

    def __init__(self, folder: str):
        self.folder = folder
        self.shards = [s for s in manifest(folder)["shards"] if s["low"] is not None]
        self.lows = [s["low"] for s in self.shards]
        self.open: dict[str, Shard] = {}

    def lookup(self, key: int) -> list[np.ndarray]:
        """The ids of every document with the key, from the shards whose range has it."""
        out: list[np.ndarray] = []
        for s in self.shards[max(0, bisect_left(self.lows, key) - 1) : bisect_right(self.lows, key)]:
            if s["low"] <= key <= s["high"]:
                if s["name"] not in self.open:
                    self.open[s["name"]] = Shard(self.folder, s["name"])
                out += self.open[s["name"]].get(key)
        return out


def lookup(folder: str, key: int) -> list[np.ndarray]:
    """One lookup in a folder that isn't open."""
    return Store(folder).lookup(key)


def read_digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files.

    A document with a key is read where its slot says: the place that the index gives its key, and as many on as rows with that key came before it.
    """
    shards = manifest(folder)["shards"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
                shard = Shard(folder, name)
                n = shard.size("keys")
                keys, null = shard.entries("keys", 0, n).astype(np.int64), shard.entries("nulls", 0, n).astype(bool)
                place = np.arange(n)
                there = np.flatnonzero(~null)
                found, _ = shard.find(keys[there])
                if (found < 0).any():
                    raise ValueError(f"the index of {name} misses a key")
                new = np.r_[True, np.diff(keys[there]) != 0][: len(there)]
                first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(there) else there
                place[there] = found + np.arange(len(there)) - first
                starts = shard.starts(0, n)
                begin, size = starts[place], starts[place + 1] - starts[place]
                upto = np.cumsum(size)
                at = 0
                while at < n:
                    to = max(at + 1, int(np.searchsorted(upto, upto[at] - size[at] + _READ, "right")))
                    low = int(begin[at:to].min())
                    ids = shard.ids(low, int((begin[at:to] + size[at:to]).max()))
                    sums = [crc(ids[a - low : a - low + k]) for a, k in zip(begin[at:to].tolist(), size[at:to].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[at:to], mask=null[at:to]), pa.array(begin[at:to] + start), pa.array(size[at:to]), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    at = to

    rows = spark.createDataFrame([(s["name"], s["start"]) for s in shards], "name string, start long")
    return rows.repartition(max(1, len(shards)), "name").mapInArrow(run, _DIGEST)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    folder = work_folder(docs.sparkSession, "token-shards")
    write(docs, folder, vocabulary)
    return read_digest(docs.sparkSession, folder)
