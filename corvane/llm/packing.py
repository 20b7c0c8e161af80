"""Best-fit packing of token pieces to sequences of bounded length, by patterns.

All planning is on the histogram of piece lengths, at most ``CAPACITY`` counts whatever the corpus. Lengths are rounded
up to units; every pattern of at most three rounded lengths that fills a sequence is enumerated; non-negative least
squares fits how often each pattern is repeated so that the histogram is used up; repeats are rounded down. A
pattern's sequences then take exact lengths, and the pieces left over
are packed by best fit, longest first, to the room that patterns left and to new sequences. Copies of
equal length move together, so the plan is a bounded list of groups of equal sequences.

The pieces learn their place from the plan and their rank among pieces of their length. Ranks are counted within salted
parts of a length, so that a length that a third of all pieces have isn't ranked in one task; the salt is from a number that each piece
gets when it is made, so repeated rows are spread as well.

Edge cases: null and empty texts are pieces of the end id alone; rows with one doc_id, or a null one, are each packed. An empty
table gives an empty one. Only documents longer than a sequence are cut.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import keyed_text, materialise, released
from corvane.llm.tokens import crc, encoded

CAPACITY = 4096
UNITS = 64
#: Pieces of one length and salt that are ranked together, unless that made over MOST_PARTS parts.
PART = 1_000
MOST_PARTS = 50_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, spread long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", small: bool = False) -> DataFrame:
    """A row for each piece of each row's ids: where it starts in its document, its length and the checksum of its ids;
    ``spread`` is a number without meaning that differs from row to row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for table, ids, ends in encoded(vocabulary, batches, small=small):
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            sizes = ends - starts
            n = -(-sizes // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = piece * capacity
            length = np.minimum(capacity, sizes[row] - begin)
            at = starts[row] + begin
            sums = [crc(ids[a : a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            spread = (made + np.arange(len(row))) * 0x9E3779B1 % (1 << 31)
            made += len(row)
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks().take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (begin, length, sums, spread))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "spread"],
            )

    return keyed_text(docs, id_col, text_col).mapInArrow(released(run), _PIECES)


def patterns(units: int) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` with one, two or three lengths, longest first."""
    three = [(a, b, units - a - b) for a in range(1, units) for b in range(1, a + 1) if 1 <= units - a - b <= b]
    return [(units,), *((a, units - a) for a in range(units - 1, (units - 1) // 2, -1)), *three]


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, most: int = 1000) -> np.ndarray:
    """x >= 0 with the least |ax - b|, by an active set of columns. After ``most`` columns the fit is what it is: best fit packs whatever it leaves."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gram, target = a.T @ a, a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(most):
        gradient = np.where(active, -np.inf, target - gram @ x)
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        active[best] = True
        while True:
            held = np.flatnonzero(active)
            s = np.linalg.lstsq(gram[np.ix_(held, held)], target[held], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[held] = s
                break
            down = s <= 0
            step = min(x[held][down] / np.maximum(x[held][down] - s[down], 1e-300))
            x[held] += step * (s - x[held])
            active[held[x[held] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


@dataclass
class Group:
    """``count`` equal sequences, each with these (length, copies) in order."""

    content: tuple[tuple[int, int], ...]
    count: int


def _best_fit(left: np.ndarray, groups: list[Group], capacity: int) -> list[Group]:
    """Pack the counts ``left`` (by length), longest first, each to the sequence with the least room that has enough."""
    open_: dict[int, list[Group]] = {}
    rooms: list[int] = []
    done: list[Group] = []

    def put(group: Group) -> None:
        room = capacity - sum(n * k for n, k in group.content)
        if not room:
            done.append(group)
        elif group.count:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append(group)

    for g in groups:
        put(g)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                group = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, group = capacity, Group((), n)
            copies = room // length
            full = min(group.count, n // copies)
            if full:
                put(Group((*group.content, (length, copies)), full))
                n -= full * copies
            else:
                full = 1
                put(Group((*group.content, (length, n)), 1))
                n = 0
            if group.content:
                put(Group(group.content, group.count - full))
    return [*done, *(g for gs in open_.values() for g in gs)]


def _longest(left: np.ndarray, high: int, low: int, taken: list[int]) -> int:
    """The longest length in (low, high] that has a piece left besides those in ``taken``; 0 if none."""
    return next((n for n in range(high, low, -1) if left[n] > taken.count(n)), 0)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, units: int = UNITS) -> list[Group]:
    """Groups of sequences that hold exactly the histogram's pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    units = min(units, capacity)
    unit = -(-capacity // units)
    units = capacity // unit
    rounded = -(-np.arange(capacity + 1) // unit)
    counts = np.bincount(rounded, weights=left, minlength=units + 2)[1 : units + 1]
    shapes = patterns(units)
    a = np.zeros((units, len(shapes)))
    for k, shape in enumerate(shapes):
        for u in shape:
            a[u - 1, k] += 1
    fit = nonnegative_least_squares(a, counts)
    groups: list[Group] = []
    for k in np.argsort(-fit, kind="stable"):
        *first, last = shapes[k]
        repeats = int(fit[k])
        # The first slots take what their units have; the last takes the longest piece that the room left by
        # rounding allows, of its unit or one a little longer. What finds no such piece stays for best fit.
        while repeats:
            taken: list[int] = []
            for u in first:
                taken.append(_longest(left, u * unit, (u - 1) * unit, taken))
            taken.append(_longest(left, capacity - sum(taken), (last - 1) * unit, taken))
            if 0 in taken:
                break
            n = min(repeats, *(int(left[x]) // taken.count(x) for x in taken))
            for x in taken:
                left[x] -= n
            groups.append(Group(tuple((x, 1) for x in taken), n))
            repeats -= n
    return _best_fit(left, groups, capacity)


class Places:
    """The plan by length: which ranks go to which sequence and offset."""

    def __init__(self, groups: list[Group]):
        slots: dict[int, list[tuple[int, int, int, int]]] = {}
        ranks: dict[int, int] = {}
        sequence = 0
        for g in groups:
            offset = 0
            for length, copies in g.content:
                slots.setdefault(length, []).append((ranks.get(length, 0), g.count, sequence, offset))
                ranks[length] = ranks.get(length, 0) + copies * g.count
                offset += copies * length
            sequence += g.count
        self.sequences = sequence
        self.slots = {k: np.array(v, np.int64) for k, v in slots.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for k in np.unique(length):
            own = np.flatnonzero(length == k)
            slots = self.slots[int(k)]
            slot = slots[np.searchsorted(slots[:, 0], rank[own], "right") - 1]
            copy, at = np.divmod(rank[own] - slot[:, 0], slot[:, 1])
            sequence[own], offset[own] = slot[:, 2] + at, slot[:, 3] + copy * k
        return sequence, offset


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (a written table with doc_id, piece, length and spread) with sequence_id and offset."""
    spark = parts.sparkSession
    histogram = {int(r.length): int(r["n"]) for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))
    part = max(PART, sum(histogram.values()) // MOST_PARTS)
    salts = spark.createDataFrame([(k, -(-n // part)) for k, n in histogram.items()], "length long, salts long")  # a row for each length at most
    salted = parts.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.col("spread"), F.col("salts"))).drop("salts")
    before: dict[int, int] = {}
    ahead = []
    for r in sorted(salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()):
        ahead.append((r.length, r.salt, before.get(r.length, 0)))
        before[r.length] = before.get(r.length, 0) + r["n"]
    ahead = spark.createDataFrame(ahead, "length long, salt long, ahead long")  # MOST_PARTS rows and one for each length at most
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "spread"))).join(F.broadcast(ahead), ["length", "salt"])
    names = [n for n in parts.columns if n not in ("sequence_id", "offset", "spread")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.place(np.asarray(batch.column("length")), np.asarray(batch.column("rank")) - 1 + np.asarray(batch.column("ahead")))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {parts.schema[n].dataType.simpleString()}" for n in names)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", small: bool = False) -> DataFrame:
    """Pieces of all rows with their sequence and their place in it; ``small`` takes less of a worker's memory, and more time."""
    return pack(materialise(pieces(docs, vocabulary, capacity, id_col, text_col, small), "pieces"), capacity)
