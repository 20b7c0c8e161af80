"""Token ids of whole texts with the ``tokenizers`` library, memoised by word.

A vocabulary file that lower-cases, drops white space and splits to runs of letters, digits and the rest gives a text the ids
of its chunks between ASCII white space, one after the other. A worker keeps the ids of the chunks it has seen, and the
library encodes only new ones, many at once. The memo has a bound, and between tasks its older half goes; the ids don't depend on it. Texts of other files,
and texts with a special token's string, are encoded whole.

Edge cases: a null text is empty, and has no ids but the end id.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corvane.llm.common import chunks

END = 1
MEMO = 600_000
BATCH_BYTES = 6 << 20
#: The same for workers that have little memory beside other stages; it costs time.
SMALL_MEMO = 200_000
SMALL_BATCH_BYTES = 3 << 20


#: A chunk of these letters alone is one piece.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kept = json.loads(self.tokenizer.to_str())
        self.word_by_word = self._word_by_word(kept)
        self.specials = [t["content"].lower() for t in kept["added_tokens"]]
        self.memo = MEMO
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _word_by_word(kept: dict) -> bool:
        """Whether the file lower-cases, drops white space, and splits to runs of letters, single digits and runs of the rest."""
        steps = (kept.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        pattern = (steps[0].get("pattern") or {}).get("Regex", "")
        lowers = "Lowercase" in [n.get("type") for n in (kept.get("normalizer") or {}).get("normalizers", [])]
        return bool(lowers and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and kept["post_processor"] is None)

    def _learn(self, chunks: list[str]) -> None:
        """Add chunks to the memo. One full stop or comma after an ASCII letter ends a chunk as a piece of its own for the pre-tokenizer."""
        ended = [c for c in chunks if len(c) > 1 and c[-1] in ".," and "a" <= c[-2] <= "z"]
        parts = {x for c in ended for x in (c[:-1], c[-1])}.union(c for c in chunks if not (len(c) > 1 and c[-1] in ".," and "a" <= c[-2] <= "z"))
        simple, other = [], []
        for c in parts:
            if c not in self.new:
                (simple if _LETTERS.fullmatch(c) else other).append(c)
        for at in range(0, len(simple), 512):
            part = simple[at : at + 512]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            piece, raw = np.array(e.word_ids), np.array(e.ids, "<u4").tobytes()
            cuts = (np.searchsorted(piece, np.arange(len(part) + 1)) * 4).tolist()
            assert piece[-1] == len(part) - 1
            self.new.update(zip(part, (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
        for at in range(0, len(other), 1024):
            part = other[at : at + 1024]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.new.update(zip(part, (np.array(e.ids, "<u4").tobytes() for e in found), strict=True))
        for c in ended:
            self.new[c] = self.new[c[:-1]] + self.new[c[-1]]

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks."""
        unknown = [c for c in chunks if c not in self.new]
        if len(self.new) + len(unknown) > self.memo:
            self.old, self.new, unknown = self.new, {}, chunks
        again = {c: ids for c in unknown if (ids := self.old.get(c)) is not None}
        self.new.update(again)
        self._learn([c for c in unknown if c not in again])
        return [self.new[c] for c in chunks]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts, each with the end id, and where each text's ids end."""
        texts = pc.fill_null(texts, "")
        low = pc.ascii_lower(texts)
        whole = np.zeros(len(texts), bool)
        for s in self.specials if self.word_by_word else ():
            whole |= np.asarray(pc.match_substring(low, s))
        if not self.word_by_word:
            whole[:] = True
        if whole.any():
            low = pc.if_else(pa.array(whole), "", low)
        split = pc.ascii_split_whitespace(low)
        words = split.flatten().dictionary_encode()
        per_text = np.diff(np.asarray(split.offsets)).astype(np.int64)
        distinct = [b"", np.array([END], "<u4").tobytes(), *self._ids(words.dictionary.to_pylist())]
        sizes = (np.fromiter(map(len, distinct), np.int32, len(distinct)) // 4).astype(np.int32)
        starts = (np.cumsum(sizes) - sizes).astype(np.int32)
        pool = np.frombuffer(b"".join(distinct), "<u4")
        ends = np.cumsum(per_text)
        index = np.insert(np.asarray(words.indices) + np.int32(2), ends, np.int32(1))  # the end id closes each text
        length = sizes[index]
        after = np.cumsum(length)
        total = int(after[-1]) if len(after) else 0
        shift = starts[index] - (after - length).astype(np.int32 if total < 1 << 31 else np.int64)
        ids = pool[np.repeat(shift, length) + np.arange(total, dtype=shift.dtype)]
        text_ends = after[ends + np.arange(len(ends))] if len(ends) else ends
        if whole.any():
            cut = np.split(ids, text_ends[:-1])
            for i in np.flatnonzero(whole):
                cut[i] = np.append(np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4"), np.uint32(END))
            ids, text_ends = np.concatenate(cut).astype("<u4"), np.cumsum([len(c) for c in cut])
        return ids, text_ends


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each vocabulary file and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(path: str, batches: Iterable[pa.RecordBatch], column: str = "text", small: bool = False) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of bounded bytes with the ids and the ends of their texts."""
    own = encoder(path)
    own.memo = SMALL_MEMO if small else MEMO
    for table in chunks(batches, column, SMALL_BATCH_BYTES if small else BATCH_BYTES, 50_000):
        yield table, *own.encode(table.column(column).combine_chunks())
    own.old = {}


def crc(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
