"""Benchmark decontamination with a distributed positional inverted index of the training documents.

``build_index`` splits the documents to segments of bounded size and stores, for each segment, its terms, how
often each occurs and where: one sorted list of token positions for each term. The table needs no shuffle and
is independent of any benchmark. ``search`` takes windows of benchmark words to every segment: it starts from the
list of a window's rarest term there, shifted by the term's place in the window, and intersects it with the shifted
lists of the other terms from rare to frequent. What is left are exact phrase matches. ``proximity`` finds
phrases whose words all lie within a distance instead.

The benchmark's distinct windows are made on the executors and written as blocks of at most BLOCK_BYTES of text (or one item): a vocabulary, the windows
as numbers in it, and their items. A task reads the blocks one after the other for each of its segments and keeps up to KEPT_BYTES of them for the next
one, so a larger benchmark takes more reads, not more memory; neither the driver nor a broadcast holds it. The cost is segments times windows with
known words: a window any of whose words a segment lacks leaves by one look-up of its block's vocabulary.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Edge cases: null or empty texts have no words
and give a row with zeros; items without words match nothing; rows with one doc_id, or a null one, each give a row of their own;
item_ids count once however often they occur, null item_ids are left out. A document longer than a segment is a segment.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import chunks, filesystem, keyed_text, materialise, released, settle, work_folder

WINDOW = 10
SEGMENT_BYTES = 6 << 20
BLOCK_BYTES = 4 << 20
KEPT_BYTES = 48 << 20
CANDIDATES = 1 << 19

# A-Z to a-z; every ASCII byte but 0-9, a-z and A-Z to a space; bytes of other characters as they are.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

_SEGMENTS = "doc_ids array<long>, row_hashes array<long>, n_words array<int>, terms binary, counts binary, postings binary"
_REPORT = "doc_id long, row_hash long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TABLE).split()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in chunks(batches, max_bytes=SEGMENT_BYTES, max_rows=50_000):
        number: dict[bytes, int] = {}
        counts, tokens = [], []
        for text in table.column("text").to_pylist():
            found = words(text)
            for w in set(found).difference(number):
                number[w] = len(number)
            counts.append(len(found))
            tokens.append(np.fromiter(map(number.__getitem__, found), np.uint32, len(found)))
        # One place between documents stays empty, so that no phrase goes across.
        starts = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])[:-1]
        term = np.concatenate(tokens)
        place = np.concatenate([s + np.arange(n) for s, n in zip(starts, counts, strict=True)]).astype(np.uint32)
        postings = place[np.argsort(term, kind="stable")]
        tally = np.bincount(term, minlength=len(number)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([table.column("row_hash").to_pylist()], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([b" ".join(number)], pa.binary()), pa.array([tally.tobytes()], pa.binary()), pa.array([postings.tobytes()], pa.binary())],
            ["doc_ids", "row_hashes", "n_words", "terms", "counts", "postings"],
        )


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each segment, written to the shared folder."""
    return materialise(keyed_text(docs, id_col, text_col).withColumn("row_hash", F.xxhash64("text")).mapInArrow(released(_index), _SEGMENTS), "postings")


class _Segment:
    def __init__(self, row: dict):
        self.ids, self.row_hashes, self.n_words = row["doc_ids"], row["row_hashes"], np.array(row["n_words"], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n_words + 1)])[:-1].astype(np.int64)
        self.size = int((self.n_words + 1).sum())
        self.number = {w: i for i, w in enumerate(row["terms"].split(b" "))} if row["terms"] else {}
        self.counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.postings = np.frombuffer(row["postings"], np.uint32)
        # All lists after one another, as one ascending sequence of (term, place).
        self.lists = np.repeat(np.arange(len(self.counts)) * (self.size + WINDOW), self.counts) + self.postings

    def held(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each term's list has the place."""
        wanted = term * (self.size + WINDOW) + place
        at = np.minimum(np.searchsorted(self.lists, wanted), len(self.lists) - 1)
        return self.lists[at] == wanted

    def documents(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


def _matches(segment: _Segment, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of a window, place of its first word) of every exact occurrence, in bounded pieces."""
    number = np.array([segment.number.get(w, -2) for w in block.vocabulary] + [-1], np.int64)
    terms = number[block.windows]  # -1 pads, -2 is unknown here
    which = np.flatnonzero((terms > -2).all(axis=1))
    if not len(which):
        return
    terms = terms[which]
    counts = np.where(terms >= 0, segment.counts[terms], np.iinfo(np.int64).max)
    order = np.argsort(counts, axis=1, kind="stable")  # rarest first, padding last
    rows = np.arange(len(which))
    rarest = terms[rows, order[:, 0]]
    sizes = segment.counts[rarest]
    ends = np.cumsum(sizes)
    done = 0
    while done < len(which):
        # As many windows as have CANDIDATES postings in their rarest lists; a longer single list is cut.
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + CANDIDATES, "right")))
        part = rows[done:upto]
        done = upto
        n = sizes[part]
        total = int(n.sum())
        for cut in range(0, total, CANDIDATES):
            flat = np.arange(cut, min(total, cut + CANDIDATES))
            row_ends = np.cumsum(n)
            local = np.searchsorted(row_ends, flat, "right")
            row = part[local]
            at = segment.first[rarest[row]] + flat - (row_ends - n)[local]
            begin = segment.postings[at].astype(np.int64) - order[row, 0]
            row, begin = row[begin >= 0], begin[begin >= 0]
            for rank in range(1, terms.shape[1]):
                if not len(row):
                    break
                slot = order[row, rank]
                wanted = terms[row, slot]
                stay = wanted < 0
                stay[~stay] = segment.held(wanted[~stay], (begin + slot)[~stay])
                row, begin = row[stay], begin[stay]
            if len(row):
                yield which[row], begin


class Block:
    """Distinct windows of some benchmark items, and the items that have each."""

    def __init__(self, vocabulary: list[bytes], windows: np.ndarray, ends: np.ndarray, items: list[str]):
        self.vocabulary, self.windows, self.ends, self.items = vocabulary, windows, ends, items
        self.lengths = (windows >= 0).sum(axis=1)

    @classmethod
    def of(cls, rows: Iterable[tuple], window: int) -> Block:
        holders: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in rows:
            found = words(text)
            for i in range(max(1, len(found) - window + 1) if found else 0):
                held = holders.setdefault(tuple(found[i : i + window]), set())
                if item is not None:
                    held.add(item)
        number = {w: k for k, w in enumerate({w for x in holders for w in x})}
        windows = np.full((len(holders), window), -1, np.int32)
        for row, x in enumerate(holders):
            windows[row, : len(x)] = [number[w] for w in x]
        return cls(list(number), windows, np.cumsum([len(x) for x in holders.values()]).astype(np.int64), [x for held in holders.values() for x in held])

    def items_of(self, row: int) -> list[str]:
        return self.items[self.ends[row - 1] if row else 0 : self.ends[row]]


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int) -> tuple[str, list[str]]:
    """A folder with a file for each block of the benchmark, and the names of those that ended well."""
    folder = work_folder(items.sparkSession, "benchmark-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        system.create_dir(path)
        for table in chunks(batches, max_bytes=BLOCK_BYTES, max_rows=1 << 20):
            b = Block.of(zip(table.column("item").to_pylist(), table.column("text").to_pylist(), strict=True), window)
            if len(b.windows):
                name = f"{uuid.uuid4().hex}.block"
                with system.open_output_stream(f"{path}/{name}") as f:
                    f.write(pickle.dumps(b, 5))
                yield pa.RecordBatch.from_pydict({"name": [name]})

    named = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return folder, sorted(r.name for r in named.mapInArrow(run, "name string").collect())  # a row for each block


class _Reader:
    """The blocks, from the shared folder; the first KEPT_BYTES of them stay for the next segment."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names
        self.kept: dict[str, Block] = {}
        self.left = KEPT_BYTES

    def __iter__(self) -> Iterator[Block]:
        for name in self.names:
            block = self.kept.get(name)
            if block is None:
                system, path = filesystem(self.folder)
                with system.open_input_stream(f"{path}/{name}") as f:
                    raw = f.read()
                block = pickle.loads(raw)
                if len(raw) <= self.left:
                    self.left -= len(raw)
                    self.kept[name] = block
            yield block


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """For every indexed document: its words, those inside an occurrence of an item's window, and the items."""
    if window > WINDOW:
        raise ValueError(f"a window has {WINDOW} words at most")
    folder, names = _blocks(items, item_col, text_col, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Reader(folder, names)
        for batch in batches:
            for i in range(batch.num_rows):
                segment = _Segment(batch.slice(i, 1).to_pylist()[0])
                edge = np.zeros(segment.size + WINDOW + 1, np.int32)
                pairs: dict[int, set[str]] = {}
                for block in blocks:
                    for which, begin in _matches(segment, block):
                        np.add.at(edge, begin, 1)
                        np.add.at(edge, begin + block.lengths[which], -1)
                        docs = segment.documents(begin)
                        for d, w in set(zip(docs.tolist(), which.tolist(), strict=True)):
                            pairs.setdefault(d, set()).update(block.items_of(w))
                hit = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
                n_hit = hit[segment.starts + segment.n_words] - hit[segment.starts]
                found = [sorted(pairs.get(d, ())) for d in range(len(segment.ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment.ids, pa.int64()), pa.array(segment.row_hashes, pa.int64()), pa.array(segment.n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([hashlib.sha256(",".join(f).encode()).hexdigest() for f in found], pa.string()), pa.array(n_hit > 0)],
                    ["doc_id", "row_hash", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

    return index.mapInArrow(released(run), _REPORT)


def proximity(index: DataFrame, phrases: dict[str, str], within: int) -> DataFrame:
    """(phrase, doc_id, place): each place of a phrase's first word that has the phrase's other words, in any order, at most ``within`` words away in the same
    document; its list is intersected with the others from the rarest on. ``phrases`` is a short list of queries by name."""
    queries = [(name, found[0], sorted(set(found) - {found[0]})) for name, text in phrases.items() if (found := words(text))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                segment = _Segment(batch.slice(i, 1).to_pylist()[0])
                out: list[tuple] = []
                for name, first, others in queries:
                    if not all(t in segment.number for t in (first, *others)):
                        continue
                    held = lambda t: segment.postings[segment.first[segment.number[t]] : segment.first[segment.number[t] + 1]].astype(np.int64)  # noqa: B023, E731
                    near = held(first)
                    for other in sorted(map(held, others), key=len):
                        doc = segment.documents(near)
                        low = np.maximum(near - within, segment.starts[doc])
                        high = np.minimum(near + within, segment.starts[doc] + segment.n_words[doc] - 1)
                        near = near[np.searchsorted(other, high, "right") > np.searchsorted(other, low, "left")]
                    doc = segment.documents(near)
                    out += [(name, segment.ids[d], int(p)) for d, p in zip(doc.tolist(), (near - segment.starts[doc]).tolist(), strict=True)]
                yield pa.RecordBatch.from_pylist([dict(zip(("phrase", "doc_id", "place"), o, strict=True)) for o in out], pa.schema([("phrase", pa.string()), ("doc_id", pa.int64()), ("place", pa.int64())]))

    return index.mapInArrow(run, "phrase string, doc_id long, place long")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The report of ``search`` on all documents, through an index of all of them."""
    return settle(lambda: search(build_index(docs, id_col, text_col), items), "contamination")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with their columns."""
    hit = contamination(docs, items, id_col, text_col).filter("contaminated").select(F.col("doc_id").alias("__hit_id"), F.col("row_hash").alias("__hit_hash")).distinct()
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__hit_id")) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col("__hit_hash"))
    return docs.join(hit, same, "left_anti")
