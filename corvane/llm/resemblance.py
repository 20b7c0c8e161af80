"""Links between texts whose sets of word shingles have a Jaccard similarity of at least a threshold.

A SimHash of 64 bits can't serve a similarity of 0.8: such texts differ in about 10 bits, and the guaranteed number
of shared positional bytes is then none. The byte-position index and its count filter stay, on a fingerprint whose
bytes each agree with the probability of the similarity: byte i of POSITIONS is the low byte of the smallest of the
shingles' hashes under function i. The index posts a text under BANDS groups of POSITIONS / BANDS positions (by
whole hashes, not bytes); two texts at 0.8 share none of these lists in two of 1,000 cases at most. Within a list the
shared positional bytes are tallied, and what reaches ``minimum_matches`` is verified on the whole shingle sets.

Texts with equal shingle sets are one node before any list is made. A list whose matching pairs are at most
PAIRS a member gives them all as candidates. Any other list is joined with its members' texts and worked off in
blocks: a list within BLOCK members and BLOCK_BYTES of text is one block; a longer one is dealt to several, and a task has one couple of
blocks, so that each two members still meet in a task, and no task holds more than two blocks (``joined_sets``). There, members are taken from the one closest
to the most frequent bytes on, each is verified with all members that match it and aren't joined to it yet, and an
edge is given for each group that it joins. So every matching pair of a list is either verified or already within one
group. The work of a list beyond a block grows with the square of its blocks.

Edge cases: null and empty texts have no shingles and one node, linked to nothing; fewer words than a shingle has are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialise, released

WORDS = 5
SIMILARITY = 0.8
POSITIONS = 80
BANDS = 16
CHUNK = 1024
BLOCK = 4096
BLOCK_BYTES = 24 << 20
PAIRS = 8
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
EMPTY_NODE = 0
_ODD = np.random.default_rng(5).integers(1, 1 << 63, POSITIONS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    found = (text or "").encode("utf-8").translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    each = _mixed(np.fromiter(map(digest, found), np.uint64, len(found)))
    n = max(1, len(found) - words + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(words, len(found))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
    return np.unique(_mixed(h))


def sketch(found: np.ndarray) -> tuple[bytes, list[int]]:
    """The positional bytes and the keys (signed) of a text's lists."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 256):
        least = np.minimum(least, (found[at : at + 256, None] * _ODD).min(axis=0))
    bands = least.reshape(BANDS, -1)
    keys = np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], np.uint64).view(np.int64).tolist()
    return (least & np.uint64(255)).astype(np.uint8).tobytes(), keys


def node_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64)) if len(found) else EMPTY_NODE


def minimum_matches(similarity: float) -> int:
    """Positions that texts at the threshold share, less four and a half standard deviations."""
    return max(POSITIONS // BANDS, int(POSITIONS * similarity - 4.5 * (POSITIONS * similarity * (1 - similarity)) ** 0.5))


def _tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.array([(b == one).sum(axis=1) for one in a]) if len(a) else np.empty((0, len(b)), np.int64)


def all_pairs(bytes_: np.ndarray, minimum: int, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All matching pairs of a list, as positions, or None if they are more than ``most``."""
    left, right, found = [], [], 0
    for at in range(0, len(bytes_), CHUNK):
        for from_ in range(at, len(bytes_), CHUNK):
            a, b = np.nonzero(_tally(bytes_[at : at + CHUNK], bytes_[from_ : from_ + CHUNK]) >= minimum)
            a, b = a + at, b + from_
            left.append(a[a < b])
            right.append(b[a < b])
            found += len(left[-1])
            if found > most:
                return None
    return np.concatenate(left), np.concatenate(right)


def joined_sets(sets: list[np.ndarray], bytes_: np.ndarray, minimum: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges, as positions, that make the same groups as all pairs with ``minimum`` shared bytes and the similarity on whole sets."""
    n = len(sets)
    usual = np.array([np.bincount(column, minlength=256).argmax() for column in bytes_.T])
    order = np.argsort(-(bytes_ == usual).sum(axis=1), kind="stable")
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), bool)
    group = np.arange(n)
    src, dst = [], []
    for k, i in enumerate(order.tolist()):
        others = order[k + 1 :]
        others = others[group[others] != group[i]]
        own = ids[ends[i] - sizes[i] : ends[i]]
        mark[own] = True
        for at in range(0, len(others), CHUNK):
            some = others[at : at + CHUNK]
            some = some[(bytes_[some] == bytes_[i]).sum(axis=1) >= minimum]
            if not len(some):
                continue
            of = np.repeat(np.arange(len(some)), sizes[some])
            place = np.arange(len(of)) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some]) + np.repeat(ends[some] - sizes[some], sizes[some])
            both = np.bincount(of[mark[ids[place]]], minlength=len(some))
            for j in some[both >= similarity * (sizes[i] + sizes[some] - both) - 1e-9].tolist():
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    src.append(i)
                    dst.append(j)
        mark[own] = False
    return np.array(src, np.int64), np.array(dst, np.int64)


def _by_list(batches: Iterator[pa.RecordBatch], links) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by list; only the list at the end of a batch is held beyond it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        if held and held[0].column("key")[0].as_py() == key[0]:
            if len(starts) == 1:
                held.append(batch)
                continue
            at = int(starts[1])
        else:
            at = 0
        if held:
            yield from links(pa.Table.from_batches([*held, batch.slice(0, at)] if at else held))
        last = int(starts[-1])
        if last > at:
            yield from links(pa.Table.from_batches([batch.slice(at, last - at)]))
        held = [batch.slice(last)]
    if held:
        yield from links(pa.Table.from_batches(held))


def _lists(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
    """Begin, end and bytes of each list of several members."""
    key, column = table.column("key").to_numpy(), table.column("sketch")
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a > 1:
            yield a, b, np.frombuffer(b"".join(column.slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, POSITIONS)


def _candidates(minimum: int):
    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Pairs of nodes; of a list with too many, a row for each member, with the list's key and no dst."""
        node, key = table.column("node").to_numpy(), table.column("key").to_numpy()
        out = []
        for a, b, bytes_ in _lists(table):
            pairs = all_pairs(bytes_, minimum, PAIRS * (b - a))
            if pairs is None:
                out.append((pa.array(node[a:b]), pa.nulls(b - a, pa.int64()), pa.array(key[a:b])))
            else:
                out.append((pa.array(node[a:b][pairs[0]]), pa.array(node[a:b][pairs[1]]), pa.nulls(len(pairs[0]), pa.int64())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([o[k] for o in out]) for k in (0, 1, 2)], ["src", "dst", "key"])

    return lambda batches: _by_list(batches, links)


def _joined(words: int, similarity: float, minimum: int):
    def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, text = table.column("node").to_numpy(), table.column("text")
        for a, b, bytes_ in _lists(table):
            i, j = joined_sets([shingles(t.as_py(), words) for t in text.slice(a, b - a)], bytes_, minimum, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(node[a:b][i]), pa.array(node[a:b][j])], ["src", "dst"])

    return lambda batches: _by_list(batches, links)


def _verified(words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by the left text's node, whose set is made once."""
        of, left = None, np.empty(0, np.uint64)
        for batch in batches:
            src, dst, keep = batch.column("src").to_pylist(), batch.column("dst"), []
            for i, node in enumerate(src):
                if node != of:
                    of, left = node, shingles(batch.column("left_text")[i].as_py(), words)
                right = shingles(batch.column("right_text")[i].as_py(), words)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(both >= similarity * (len(left) + len(right) - both) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("src").filter(mask), dst.filter(mask)], ["src", "dst"])

    return run


def _in_blocks(dense: DataFrame, texts: DataFrame) -> DataFrame:
    """``dense`` (node, key) with, for each couple of blocks that a member is in, a key of its own."""
    sized = dense.join(texts.select(F.col("of").alias("node"), "bytes"), "node")
    blocks = sized.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    own = dense.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Two blocks need no couples of one block with itself: a block's members meet beside those of the other.
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")))
    met = own.select("node", "key", "own", F.explode(others).alias("other"))
    return met.select("node", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))


def links(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Verified edges (src, dst) between nodes of ``rows`` (doc_id, row_hash, node, keys, sketch, text)."""
    nodes = rows.filter(F.col("node") != EMPTY_NODE).select("node", "sketch", "keys").dropDuplicates(["node"])
    postings = nodes.select("node", "sketch", F.explode("keys").alias("key")).repartition("key").sortWithinPartitions("key", "node")
    minimum = minimum_matches(similarity)
    met = materialise(postings.mapInArrow(released(_candidates(minimum)), "src long, dst long, key long"), "candidates")
    found = met.filter("key is null").select("src", "dst").distinct()
    dense = met.filter("key is not null").select(F.col("src").alias("node"), "key")
    ends = met.select(F.col("src").alias("node")).union(met.filter("dst is not null").select("dst")).distinct()
    first = rows.groupBy("node").agg(F.min(F.struct("doc_id", "row_hash")).alias("one")).join(ends, "node", "left_semi")
    first = first.select("one.*", F.col("node").alias("of")).withColumnsRenamed({"doc_id": "a", "row_hash": "b"})
    one = F.col("doc_id").eqNullSafe(F.col("a")) & F.col("row_hash").eqNullSafe(F.col("b"))
    texts = rows.select("doc_id", "row_hash", "sketch", "text").join(first, one).select("of", "sketch", F.octet_length("text").alias("bytes"), "text").dropDuplicates(["of"])
    texts = materialise(texts, "texts")
    pairs = found.join(texts.select(F.col("of").alias("src"), F.col("text").alias("left_text")), "src")
    pairs = pairs.join(texts.select(F.col("of").alias("dst"), F.col("text").alias("right_text")), "dst")
    verified = pairs.select("src", "dst", "left_text", "right_text").sortWithinPartitions("src").mapInArrow(released(_verified(words, similarity)), "src long, dst long")
    members = _in_blocks(dense, texts).join(texts.withColumnRenamed("of", "node"), "node").select("key", "node", "sketch", "text")
    return verified.union(members.repartition("key").sortWithinPartitions("key", "node").mapInArrow(released(_joined(words, similarity, minimum)), "src long, dst long"))
