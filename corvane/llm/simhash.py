"""SimHash fingerprints and near-duplicate groups through a byte-position inverted index with count filtering.

A fingerprint has 64 bits in 8 bytes. Two fingerprints with at most MAX_BITS = 2 differing bits agree in at least 6 of the 8 positional
bytes: the guaranteed minimum. Lists of single positional bytes would hold a 256th of all fingerprints each, so the index posts a selective prefix:
of four couples of neighbouring bytes a qualifying pair shares at least two, and a fingerprint is posted under each of the 6 pairs of couples with
their four bytes. Within a list the shared positional bytes of each pair are tallied over all 8 positions, pairs below the minimum are left, and
the others are verified by their bits.

A list of up to ``LIST`` members is tallied in its task. A longer one is never held: its members stream on and are posted again under their list and each two of
the four other bytes, which a qualifying pair shares too. Such a list differs in two bytes only, so it has 65,536 members at most,
whatever the size of the corpus.

Equal fingerprints are one node of the graph before any list is made. A list gives edges from its members to
the smallest member of their group in the list, never all pairs.

Edge cases: null and empty texts have no shingles and fingerprint zero, linked like any other; fewer words than a
shingle has are one shingle; rows with one doc_id each keep their row; a null doc_id never becomes a component's id
unless all its members' are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import resemblance
from corvane.llm.common import keyed_text, materialise, released, settle
from corvane.llm.components import connected_components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
PIECE = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned. Words are split at ASCII white space (bytes.split does exactly that)."""
    found = (text or "").encode("utf-8").translate(LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(found) - shingle + 1)
    lo, hi = starts[:n].tolist(), ends[min(shingle, len(found)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(lo[at : at + PIECE], hi[at : at + PIECE], strict=False)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row_hash and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), pa.array(fp)], ["doc_id", "row_hash", "fp"])

    return keyed_text(docs, id_col, text_col).withColumn("row_hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, row_hash long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _bytes_mask(places: tuple[int, ...]) -> int:
    return _signed(sum(0xFF << 8 * p for p in places))


#: The four bytes of each list key, and for a long list the six that its members share.
PREFIXES = [(2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(4), 2)]
MINIMUM = 8 - MAX_BITS
LIST = 512


_PAIRS = list(combinations(range(8), 2))
_POINTS = np.arange(1 << 16)


def _groups(rest: np.ndarray) -> np.ndarray:
    """For distinct 16-bit values, the position of the first member of each one's group under MAX_BITS differing bits."""
    n = len(rest)
    if n <= 256:
        near = np.bitwise_count(rest[:, None] ^ rest[None, :]) <= MAX_BITS
        root = np.arange(n)
        while True:
            new = np.where(near, root[None, :], n).min(axis=1)
            if (new == root).all():
                return root
            root = new
    # Values within two bits share a point within one bit of both: labels go from members to points and back.
    member = np.full(1 << 16, n, np.int64)
    member[rest] = np.arange(n)
    there = member < n
    while True:
        point = member.copy()
        for bit in range(16):
            point = np.minimum(point, member[_POINTS ^ 1 << bit])
        new = point.copy()
        for bit in range(16):
            new = np.minimum(new, point[_POINTS ^ 1 << bit])
        new[~there] = n
        if (new == member).all():
            return member[rest]
        member = new


def _shared_bytes(fp: np.ndarray) -> np.ndarray:
    """For each pair of the fingerprints, how many positional bytes they share."""
    at = fp.view(np.uint8).reshape(-1, 8)
    return sum((at[:, None, k] == at[None, :, k]).astype(np.int8) for k in range(8))


def _tallied(fp: np.ndarray) -> np.ndarray:
    """The position of the first member of each one's group: pairs with MINIMUM shared bytes and at most MAX_BITS differing bits."""
    left, right = np.nonzero(np.triu(_shared_bytes(fp) >= MINIMUM, 1))
    u = fp.view(np.uint64)
    good = np.bitwise_count(u[left] ^ u[right]) <= MAX_BITS
    left, right = left[good], right[good]
    root = np.arange(len(fp))
    while True:
        new = root.copy()
        np.minimum.at(new, right, root[left])
        np.minimum.at(new, left, root[right])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _edges(fp: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = root != np.arange(len(fp))
    return fp[other], fp[root[other]]


class _Lists:
    """The lists of a task, which come sorted: edges of those of up to LIST members, and all members of longer ones."""

    def __init__(self):
        self.key: tuple[int, int] | None = None
        self.held = np.empty(0, np.int64)
        self.long = False
        self.src: list[np.ndarray] = []
        self.dst: list[np.ndarray] = []
        self.again: list[tuple[np.ndarray, int]] = []

    def close(self) -> None:
        if len(self.held) > 1:
            for to, x in zip((self.src, self.dst), _edges(self.held, _tallied(self.held)), strict=True):
                to.append(x)
        self.held, self.long = np.empty(0, np.int64), False

    def add(self, key: tuple[int, int], members: np.ndarray) -> None:
        if key != self.key:
            self.close()
            self.key = key
        self.long |= len(self.held) + len(members) > LIST
        self.held = np.concatenate([self.held, members])
        if self.long:
            self.again.append((self.held, key[0]))
            self.held = self.held[:0]

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = ["src", "dst", "combo"]
        if self.src:
            src = np.concatenate(self.src)
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(np.concatenate(self.dst)), pa.nulls(len(src), pa.int32())], names)
        for members, combo in self.again:
            yield pa.RecordBatch.from_arrays([pa.array(members), pa.nulls(len(members), pa.int64()), pa.array(np.full(len(members), combo, np.int32))], names)
        self.src, self.dst, self.again = [], [], []


def _prefix_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (src, dst), and (src, combo) for each member of a list that is posted again."""
    lists = _Lists()
    for batch in batches:
        if not batch.num_rows:
            continue
        combo, kept, fp = (np.asarray(batch.column(k)) for k in ("combo", "kept", "fp"))
        bounds = np.flatnonzero(np.r_[True, (kept[1:] != kept[:-1]) | (combo[1:] != combo[:-1]), True])
        last = len(bounds) - 2
        for k in [0, *(np.flatnonzero(np.diff(bounds)[1:last] > 1) + 1).tolist(), *([last] if last else [])]:  # a list of one has no pair
            lists.add((int(combo[bounds[k]]), int(kept[bounds[k]])), fp[bounds[k] : bounds[k + 1]])
        yield from lists.rows()
    lists.close()
    yield from lists.rows()


def _bounded_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings come sorted by list. Members of a list share six bytes; one list, 65,536 members at most, is held beyond a batch."""
    held = (np.empty(0, np.int64),) * 3

    def edges(left_out: np.ndarray, kept: np.ndarray, fp: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        src, dst = [], []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            one, two = _PAIRS[left_out[a]]
            u = fp[a:b].view(np.uint64)
            rest = (u >> np.uint64(8 * one) & np.uint64(255)) | (u >> np.uint64(8 * two) & np.uint64(255)) << np.uint64(8)
            for to, x in zip((src, dst), _edges(fp[a:b], _groups(rest.astype(np.int64))), strict=True):
                to.append(x)
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    def bounds(left_out: np.ndarray, kept: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.r_[True, (kept[1:] != kept[:-1]) | (left_out[1:] != left_out[:-1]), True])

    for batch in batches:
        if not batch.num_rows:
            continue
        held = tuple(np.concatenate([h, np.asarray(batch.column(k)).astype(np.int64)]) for h, k in zip(held, ("left_out", "kept", "fp"), strict=True))
        at = bounds(*held[:2])
        starts, ends = at[:-2], at[1:-1]
        many = ends - starts > 1
        yield from edges(*held, starts[many], ends[many])
        held = tuple(h[at[-2] :] for h in held)
    if len(held[0]) > 1:
        yield from edges(*held, np.array([0]), np.array([len(held[0])]))


def _bounded_keys() -> Column:
    """For each prefix the (left_out, kept) keys of its bounded lists: two of the four bytes outside the prefix are left out."""
    keys = []
    for prefix in PREFIXES:
        others = [p for p in range(8) if p not in prefix]
        keys.append(F.array(*[F.struct(F.lit(_PAIRS.index(pair)).alias("left_out"), F.col("src").bitwiseAND(F.lit(_bytes_mask(tuple(p for p in range(8) if p not in pair)))).alias("kept")) for pair in combinations(others, 2)]))
    return F.get(F.array(*keys), F.col("combo"))


def links(fps: DataFrame) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints ``fp`` that make the same groups as all pairs with MAX_BITS differing bits at most."""
    postings = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_bytes_mask(p))) for p in PREFIXES])).alias("combo", "kept"))
    met = materialise(postings.repartition("combo", "kept").sortWithinPartitions("combo", "kept").mapInArrow(_prefix_lists, "src long, dst long, combo int"), "lists")
    again = met.filter("combo is not null").select(F.col("src").alias("fp"), F.explode(_bounded_keys()).alias("key")).select("fp", "key.*").distinct()
    bounded = again.repartition("left_out", "kept").sortWithinPartitions("left_out", "kept").mapInArrow(_bounded_lists, "src long, dst long")
    return met.filter("combo is null").select("src", "dst").union(bounded)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row_hash, fp, root (a fingerprint that names the group) and component_id of every row."""
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    roots = settle(lambda: connected_components(links(rows.select("fp").distinct())), "roots").withColumnRenamed("node", "fp")
    grouped = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.join(grouped.groupBy("root").agg(F.min("first_doc").alias("component_id")), "root").select("fp", "root", "component_id")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id of the group) of every row."""
    return groups(docs, id_col, text_col, shingle).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _described(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, row_hash, fp, node, keys, sketch and text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node, keys, bytes_ = [], [], [], []
            for value in batch.column("text"):
                text = value.as_py()
                found = resemblance.shingles(text, words)
                told = resemblance.sketch(found)
                fp.append(fingerprint(text))
                node.append(resemblance.node_of(found))
                bytes_.append(told[0])
                keys.append(told[1])
            more = [pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(node, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "row_hash")), *more, batch.column("text")], ["doc_id", "row_hash", "fp", "node", "keys", "sketch", "text"])

    schema = "doc_id long, row_hash long, fp long, node long, keys array<long>, sketch binary, text string"
    return keyed_text(docs, id_col, text_col).withColumn("row_hash", F.xxhash64("text")).mapInArrow(released(run), schema)


def resemblance_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = resemblance.WORDS, similarity: float = resemblance.SIMILARITY) -> DataFrame:
    """doc_id, row_hash and root of every row: groups linked by fingerprints (MAX_BITS) or by shingle sets of ``words`` words at ``similarity``.

    A fingerprint is a node of its own beside the nodes of shingle sets, linked to each set it was made from.
    """
    rows = materialise(_described(docs, id_col, text_col, words), "described")
    tagged = lambda name: F.xxhash64(F.lit("fp"), F.col(name))
    same = rows.select(F.col("node").alias("src"), tagged("fp").alias("dst")).distinct()
    near = lambda: links(rows.select("fp").distinct()).select(tagged("src").alias("src"), tagged("dst").alias("dst"))
    roots = settle(lambda: connected_components(same.union(near()).union(resemblance.links(rows, words, similarity))), "roots")
    return rows.select("doc_id", "row_hash", "node").join(roots, "node").select("doc_id", "row_hash", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = resemblance.WORDS, similarity: float = resemblance.SIMILARITY) -> DataFrame:
    """Of each group of ``resemblance_groups`` the row with the smallest doc_id (a null one only if all are null), with its columns; of repeated rows, one."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("first")
    first = lambda: resemblance_groups(docs, id_col, text_col, words, similarity).groupBy("root").agg(least)
    stay = settle(lambda: first().select(F.col("first.doc_id").alias("__stay_id"), F.col("first.row_hash").alias("__stay_hash")), "stay")
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__stay_id")) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("__stay_hash"))
    return docs.join(stay, same).dropDuplicates(["__stay_id", "__stay_hash"]).drop("__stay_id", "__stay_hash")
