"""A growing table from chunks of text to their token ids, looked up in bulk.

Texts repeat their words, so a worker encodes each distinct chunk once and assembles texts from the table's rows.
When a table passes a stated number of chunks, those met most often stay and the others are forgotten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


_TAIL = np.zeros(256, bool)
_TAIL[[ord("."), ord(",")]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


class _Index(dict):
    """Gives a key that it has not met the next row, and keeps it in ``fresh`` until it is encoded."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, key):
        row = len(self)
        self[key] = row
        self.fresh.append(key)
        return row


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every piece, one piece after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def flattened(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum())), lengths


def merged(first: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of a where ``first`` is true and of b elsewhere, each in their order."""
    lengths = np.zeros(len(first), np.int64)
    lengths[first], lengths[~first] = a[1], b[1]
    starts = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()), np.int32)
    flat[ragged(starts[first], a[1])] = a[0]
    flat[ragged(starts[~first], b[1])] = b[0]
    return flat, lengths


class ChunkTable:
    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], most_chunks: int = 400_000) -> None:
        self.encode, self.most_chunks = encode, most_chunks
        self.index = _Index()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths, self.rows = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0
        self.uses = np.zeros(1 << 14, np.int32)

    def _shrink(self) -> None:
        """Keep the chunks met most often (twice at least), at most half of the bound; forget the rest."""
        uses = self.uses[: self.rows]
        least = max(2, int(np.partition(uses, -(self.most_chunks // 2))[-(self.most_chunks // 2)]) + 1)
        kept = np.flatnonzero(uses >= least)
        names = compress(self.index, (uses >= least).tolist())
        index = _Index()
        dict.update(index, zip(names, range(len(kept)), strict=True))
        flat, lengths = self.flat[ragged(self.starts[kept], self.lengths[kept])], self.lengths[kept]
        self.index, self.flat, self.used = index, np.concatenate([flat, np.zeros(1 << 16, np.int32)]), len(flat)
        self.rows, room = len(kept), np.zeros(1 << 14, np.int32)
        self.lengths, self.uses = np.concatenate([lengths, room]), np.concatenate([uses[kept] // 2, room])
        self.starts = np.concatenate([np.cumsum(lengths, dtype=np.int64) - lengths, room.astype(np.int64)])

    def rows_of(self, chunks: Iterable, count: int) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, chunks), np.int64, count)

    def rows_of_split(self, texts: pa.Array) -> list[np.ndarray]:
        """Rows of the chunks between ASCII white space, text by text, each text's with that of ``None`` behind.

        For encoders that part words at white space and before punctuation. Chunks are counted off in Arrow first, so that only the distinct ones of a batch are looked up.
        """
        split = pc.ascii_split_whitespace(texts.cast(pa.string()))
        offsets, values = split.offsets.to_numpy().astype(np.int64), split.values
        if len(values):
            # a full stop or comma behind an ASCII letter or digit is a chunk of its own: one more bound, no copy
            bounds = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
            data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
            ends = bounds[1:]
            tail = np.diff(bounds) >= 2
            tail[tail] = _TAIL[data[ends[tail] - 1]] & _PLAIN[data[ends[tail] - 2]]
            at = np.flatnonzero(tail)
            values = pa.StringArray.from_buffers(len(values) + len(at), pa.py_buffer(np.insert(bounds, at + 1, ends[at] - 1)), values.buffers()[2])
            offsets = offsets + np.concatenate([[0], np.cumsum(tail)])[offsets]
        coded = values.dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        rows = self.rows_of(distinct, len(distinct))[coded.indices.to_numpy(zero_copy_only=False)] if distinct else np.zeros(0, np.int64)
        return np.split(np.insert(rows, offsets[1:], self.index[None]), (offsets[1:] + np.arange(1, len(offsets)))[:-1])

    def _learn(self) -> None:
        fresh = self.index.fresh
        if not fresh:
            return
        flat, lengths = self.encode(fresh)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.rows + len(lengths) > len(self.starts):
            self.starts, self.lengths, self.uses = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.uses))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[self.rows : self.rows + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.rows : self.rows + len(lengths)] = lengths
        self.used, self.rows = self.used + len(flat), self.rows + len(lengths)
        self.index.fresh = []

    def gather(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, given each text's rows: all ids one text after the other, and every text's number of ids."""
        self._learn()
        every = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        lengths = self.lengths[every].astype(np.int64)
        self.uses[: self.rows] += np.bincount(every, minlength=self.rows).astype(np.int32)
        ids = self.flat[ragged(self.starts[every], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        counts = np.diff(ends[bounds])
        if self.rows > self.most_chunks:
            self._shrink()
        return ids, counts


def label_bytes(labels: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels as one byte array with starts and lengths, for ``ragged``."""
    lengths = np.fromiter(map(len, labels), np.int64, len(labels))
    return np.frombuffer(b"".join(labels), np.uint8), np.cumsum(lengths) - lengths, lengths


def emit(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the ids' labels make, and the end of each id's label in them."""
    flat, starts, lengths = table
    n = lengths[ids]
    return flat[ragged(starts[ids], n)], np.cumsum(n)
