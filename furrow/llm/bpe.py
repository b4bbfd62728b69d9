"""BPE as a deterministic automaton over tokens (operator 4).

The merges are compiled one after the other. The automaton starts with a state for every byte symbol, all arcs
present. The gadget of a merge (a, b) -> c

* takes the arc labelled b from the state after a, since that pair is always merged from here on,
* gives the state after c the arcs that the state after b had before the gadget,
* lets an arc labelled c leave every state that an arc labelled a leaves after the cut.

A token sequence is the BPE encoding of the bytes it spells exactly if the automaton accepts it, and there is one such
path for any bytes. The full table of states times labels would have 50,000 x 50,000 cells, nearly all of them copies,
so it is stored with default transitions: the cells that gadgets cut are listed, and every other cell defers to the row
(of the right part of the state's token) or the column (of the left part of the label) that it was copied from, with
the gadget from which on it was a copy. Following defaults to a listed cell or to a byte symbol's decides an arc.

Bytes drive the automaton from left to right. A prefix of an accepted sequence is accepted, so after any bytes there is
one state: the one token among those ending there (found by the transitions of a trie of all labels) whose arc leaves the
state at the place where it begins. So a word is encoded by table transitions alone, without search or steps back, and all
words of a batch at once. Decoding emits the labels of the ids' arcs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common
from .chunks import ChunkTable, emit, flattened, label_bytes, merged, ragged

#: Where the public vocabulary files are, unless a caller names another folder.
TOKENIZERS = os.environ.get("FURROW_TOKENIZERS", "/opt/tokenizers")

#: The published pre-splitting pattern of this vocabulary (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space beside a space: there, splitting at spaces would not give the pattern's pieces.
_GAP = rb"[\t-\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81]|\xe3\x80\x80"
_HAZARD = re.compile(rb" (?: |" + _GAP + rb")|(?:[\t-\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81].|\xe3\x80\x80) ", re.S)

#: Words of more bytes than this are encoded one by one, others all at once.
LONG = 64


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Cells:
    """A fixed map from whole numbers (0 or more) to whole numbers, in two arrays; -1 for what it lacks."""

    def __init__(self, cells: dict[int, int]) -> None:
        self.mask = (1 << max(4, (2 * len(cells)).bit_length())) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        keys, values = np.fromiter(cells, np.int64, len(cells)), np.fromiter(cells.values(), np.int32, len(cells))
        at = self._home(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            put = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(36)).astype(np.int64) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        at, out = self._home(keys), np.full(len(keys), -1, np.int32)
        here = self.keys[at]
        hit = here == keys
        out[hit] = self.values[at[hit]]
        open_ = np.flatnonzero(~hit & (here >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            here = self.keys[at]
            hit = here == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            going = ~hit & (here >= 0)
            open_, at = open_[going], at[going]
        return out


@dataclass
class Automaton:
    """The compiled tables; a few MB of arrays. States are named by the token that leads to them, the start state by -1.

    ``made``: the gadget that made each token, -1 for byte symbols. ``left``, ``right``: the merged pair. ``cut``: state and
    label of each cut cell to the gadget that cut it. ``step``: the trie's transitions, node and byte to node. ``token``: the
    token that a node of the trie spells, or -1. ``sizes``: bytes of each token's label.
    """

    made: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cut: Cells
    step: Cells
    token: np.ndarray
    sizes: np.ndarray
    gadgets: int

    def arcs(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Whether an arc with the label leaves the state, for many pairs at once."""
        out = np.ones(len(states), bool)
        live = np.flatnonzero(states >= 0)
        a, b, limit = states[live].astype(np.int64), labels[live].astype(np.int64), np.full(len(live), self.gadgets, np.int32)
        while len(live):
            k = self.cut.get(a << 32 | b)
            gone = (k >= 0) & (k < limit)
            out[live[gone]] = False
            ma, mb = self.made[a], self.made[b]
            column = mb >= ma
            go = ~gone & ~(column & (mb < 0))
            live, a, b, ma, mb, column = live[go], a[go], b[go], ma[go], mb[go], column[go]
            # a column is copied after the gadget's cut, a row before it
            limit = np.where(column, mb + 1, ma)
            a, b = np.where(column, a, self.right[a]), np.where(column, self.left[b], b)
        return out

    def _tokens_at(self, data: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens in bytes: the place each begins at, its length and its number; ``room``: bytes left from each place on."""
        live, node = np.arange(len(data)), np.zeros(len(data), np.int64)
        found, k = [], 0
        while len(live):
            node = self.step.get(node << 8 | data[live + k]).astype(np.int64)
            k += 1
            on = node >= 0
            live, node = live[on], node[on]
            token = self.token[node]
            hit = token >= 0
            found.append((live[hit], np.full(int(hit.sum()), k), token[hit]))
            on = room[live] > k
            live, node = live[on], node[on]
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate([f[i] for f in found] or [empty]) for i in range(3))

    def _states(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after every byte of short words, and each word's first node; a word of n bytes has n + 1 nodes."""
        first = np.cumsum(sizes + 1) - sizes - 1
        word = np.repeat(np.arange(len(sizes)), sizes)
        node = np.arange(len(data)) + word
        begin, k, token = self._tokens_at(data, np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data)))
        begin, end, depth = node[begin], node[begin] + k, node[begin] + k - first[word[begin]]
        order = np.argsort(depth, kind="stable")
        begin, end, token = begin[order], end[order], token[order]
        cuts = np.searchsorted(depth[order], np.arange(1, int(sizes.max(initial=0)) + 2))
        state = np.full(len(data) + len(sizes), -1, np.int64)
        reached = np.zeros(len(state), bool)
        reached[first] = True
        for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            on = self.arcs(state[begin[i:j]], token[i:j]) & reached[begin[i:j]]
            at = end[i:j][on]
            state[at], reached[at] = token[i:j][on], True
        if not reached.all():
            raise ValueError("the vocabulary lacks a byte")
        return state, first

    def paths(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The one accepted sequence of tokens of every word, word after word, and their numbers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        if len(words) and sizes.max() > LONG:
            short = sizes <= LONG
            long_ = flattened([self._long(words[i]) for i in np.flatnonzero(~short).tolist()])
            return merged(short, self.paths([w for w in words if len(w) <= LONG]), long_)
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        state, first = self._states(data, sizes)
        # back from the last state, all words at once: a token's length leads to the place where it begins
        at, word, made = first + sizes, np.arange(len(words)), []
        while len(word):
            on = at > first[word]
            at, word = at[on], word[on]
            made.append((word, at, state[at]))
            at = at - self.sizes[state[at]]
        word, at, ids = (np.concatenate([m[i] for m in made] or [np.zeros(0, np.int64)]) for i in range(3))
        return ids[np.argsort(at, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(words))

    def _long(self, word: bytes, stretch: int = 1 << 16) -> list[int]:
        """The path of one long word: tokens are found a stretch at a time, states one byte after the other."""
        state, known = np.full(len(word) + 1, -1, np.int64), {}
        longest = int(self.sizes.max())
        for low in range(0, len(word), stretch):
            start, stop = max(0, low - longest), min(len(word), low + stretch)
            data = np.frombuffer(word[start:stop], np.uint8).astype(np.int64)
            begin, k, token = self._tokens_at(data, len(data) - np.arange(len(data)))
            begin, end = begin + start, begin + start + k
            mine = np.flatnonzero(end > low)
            mine = mine[np.argsort(end[mine], kind="stable")]
            after = state[start : stop + 1].tolist()
            done = low
            for b, e, t in zip(begin[mine].tolist(), end[mine].tolist(), token[mine].tolist(), strict=True):
                if e == done:
                    continue  # one token alone ends at a place
                pair = after[b - start] << 32 | t
                ok = known.get(pair)
                if ok is None:
                    if len(known) > 100_000:
                        known.clear()
                    ok = known[pair] = bool(self.arcs(np.array([after[b - start]]), np.array([t]))[0])
                if ok and b <= done:
                    after[e - start], done = t, e
            if done < stop:
                raise ValueError("the vocabulary lacks a byte")
            state[start : stop + 1] = after
        out, at = [], len(word)
        while at:
            t = int(state[at])
            out.append(t)
            at -= int(self.sizes[t])
        return out[::-1]


class MergeAutomaton:
    """Compiles merges, one gadget after the other."""

    def __init__(self, base: dict[bytes, int]) -> None:
        self.labels: dict[int, bytes] = {i: b for b, i in base.items()}
        self.made: dict[int, tuple[int, int, int]] = {i: (-1, -1, -1) for i in base.values()}
        self.cut: dict[int, int] = {}

    def add_gadget(self, a: int, b: int, c: int) -> None:
        if c in self.made:
            raise ValueError(f"two merges make token {c}")
        self.cut[a << 32 | b] = k = len(self.cut)
        self.made[c] = (k, a, b)
        self.labels[c] = self.labels[a] + self.labels[b]

    def compiled(self) -> Automaton:
        size = max(self.made) + 1
        columns = np.full((3, size), -1, np.int32)
        for t, row in self.made.items():
            columns[:, t] = row
        step: dict[int, int] = {}
        ends: dict[int, int] = {}
        for t, label in self.labels.items():
            node = 0
            for byte in label:
                node = step.setdefault(node << 8 | byte, len(step) + 1)
            ends[node] = t
        token = np.full(len(step) + 1, -1, np.int32)
        token[list(ends)] = list(ends.values())
        sizes = np.zeros(size, np.int64)
        sizes[list(self.labels)] = [len(x) for x in self.labels.values()]
        return Automaton(*columns, Cells(self.cut), Cells(step), token, sizes, len(self.cut))


@dataclass
class Vocabulary:
    """What workers need of a vocabulary file: compiled once on the driver and broadcast, some MB whatever the corpus."""

    key: str
    automaton: Automaton
    special: dict[str, int]
    labels: tuple[np.ndarray, np.ndarray, np.ndarray]


def compile_merges(tokenizer_json: str) -> Vocabulary:
    """The automaton, special tokens and labels of a byte-level BPE file."""
    spec = json.loads(tokenizer_json)
    vocab, symbols = spec["model"]["vocab"], byte_symbols()
    made = MergeAutomaton({bytes([b]): vocab[s] for s, b in symbols.items() if s in vocab})
    for pair in spec["model"]["merges"]:
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        made.add_gadget(vocab[a], vocab[b], vocab[a + b])
    special = {t["content"]: t["id"] for t in spec["added_tokens"] if t.get("special")}
    labels = [b""] * (max([*made.labels, *special.values()]) + 1)
    for i, b in made.labels.items():
        labels[i] = b
    for s, i in special.items():
        labels[i] = s.encode()
    return Vocabulary(hashlib.sha256(tokenizer_json.encode()).hexdigest(), made.compiled(), special, label_bytes(labels))


class Codec:
    """Encodes and decodes texts in bulk; one lives in each Python worker."""

    def __init__(self, vocabulary: Vocabulary, most_chunks: int = 100_000) -> None:
        self.automaton, self.special = vocabulary.automaton, vocabulary.special
        self.split = regex.compile(SPLIT)
        self.special_bytes = {s.encode(): i for s, i in self.special.items()}
        self.at_special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special_bytes, key=len, reverse=True))) + b")") if self.special else None
        self.chunks = ChunkTable(self._encode_chunks, most_chunks)
        self.labels, self.decimals = vocabulary.labels, label_bytes([b"%d," % i for i in range(len(vocabulary.labels[1]))])

    def _encode_chunks(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        """A chunk is bytes that follow a space, or a 1-tuple of bytes that follow nothing, or a special token's id."""
        flat, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(chunks), 20_000):
            part = self._encode_part(chunks[at : at + 20_000])
            flat.append(part[0])
            lengths.append(part[1])
        return np.concatenate(flat), np.concatenate(lengths)

    def _encode_part(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        words: dict[bytes, int] = {}
        pieces: list[int] = []
        numbers = np.ones(len(chunks), np.int64)
        for n, c in enumerate(chunks):
            if type(c) is bytes:
                core = c.rstrip(b".,")
                if core.isalpha():  # ASCII letters, with full stops and commas behind: the pattern's pieces are plain
                    pieces.append(words.setdefault(b" " + core, len(words)))
                    if len(core) < len(c):
                        pieces.append(words.setdefault(c[len(core) :], len(words)))
                        numbers[n] = 2
                    continue
                text = " " + c.decode()
            elif type(c) is tuple:
                text = c[0].decode()
            else:
                pieces.append(-1 - c)
                continue
            own = [text] if text[1:].isalpha() and max(text) < "\u0590" and (text[0] == " " or text[0].isalpha()) else self.split.findall(text)
            numbers[n] = len(own)
            pieces += [words.setdefault(w.encode(), len(words)) for w in own]
        ids, counts = self.automaton.paths(list(words))
        # special tokens are rows behind the words
        which = np.fromiter(pieces, np.int64, len(pieces))
        extra = np.flatnonzero(which < 0)
        ids, starts, counts = np.concatenate([ids, (-1 - which[extra]).astype(np.int32)]), np.concatenate([np.cumsum(counts) - counts, len(ids) + np.arange(len(extra))]), np.concatenate([counts, np.ones(len(extra), np.int64)])
        which[extra] = len(words) + np.arange(len(extra))
        ends = np.concatenate([[0], np.cumsum(counts[which])])
        bounds = np.concatenate([[0], np.cumsum(numbers)])
        return ids[ragged(starts[which], counts[which])], np.diff(ends[bounds])

    def _rows(self, text: bytes) -> np.ndarray:
        if self.at_special is not None and self.at_special.search(text):
            parts = [np.array([self.chunks.index[self.special_bytes[x]]]) if x in self.special_bytes else self._rows(x) for x in self.at_special.split(text) if x]
            return np.concatenate(parts)
        if _HAZARD.search(text):
            pieces = [(x.encode(),) for x in self.split.findall(text.decode())]
        else:
            pieces = text.split(b" ")
            pieces[0] = (pieces[0],)
        return self.chunks.rows_of(pieces, len(pieces))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, text after text, and the number of each text's ids."""
        return self.chunks.gather([self._rows(t) if t else np.zeros(0, np.int64) for t in texts])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The label bytes of each text's ids; bytes that are not UTF-8 become U+FFFD."""
        flat, ends = emit(ids, self.labels)
        data = flat.tobytes()
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out = (data[i:j] for i, j in zip(at, at[1:], strict=False))
        return [x if _is_utf8(x) else x.decode("utf-8", "replace").encode() for x in out]

    def decimal(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each text's ids in decimal, joined by commas."""
        flat, ends = emit(ids, self.decimals)
        data = flat.tobytes()
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[i : max(i, j - 1)] for i, j in zip(at, at[1:], strict=False)]


def _is_utf8(x: bytes) -> bool:
    try:
        x.decode()
    except UnicodeDecodeError:
        return False
    return True


def codec(vocabulary: Vocabulary) -> Codec:
    """This worker's codec of a vocabulary."""
    return common.held("bpe", vocabulary.key, lambda: Codec(vocabulary))


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _shared(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(compile_merges(read_vocabulary(path)))


def texts_as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The texts in UTF-8; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.schema.field(column).type) else pa.binary()
    return [x or b"" for x in batch.column(column).cast(kind).to_pylist()]


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str = f"{TOKENIZERS}/byte_bpe_50k.json", digest: str | None = None) -> DataFrame:
    """``docs`` with a column of token ids (``array<int>``) instead of the text.

    Null and empty texts have no ids. Special tokens' strings in a text become their ids. Other columns, repeated
    rows and rows of any order pass unchanged; the new column replaces one of the same name. Nothing is shuffled.
    ``digest`` names one more column: the SHA-256 of the text that the ids decode to.
    """
    shared = _shared(docs.sparkSession, path)
    keep = [f for f in docs.schema.fields if f.name not in (text, ids, digest)]
    more = [T.StructField(digest, T.StringType(), False)] if digest else []
    schema = T.StructType([*keep, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False), *more])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for part in common.slices(batch, text, 1 << 20):
                flat, counts = c.encode(texts_as_bytes(part, text))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                made = [pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))]
                if digest:
                    made.append(pa.array([hashlib.sha256(x).hexdigest() for x in c.decode(flat, counts)]))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], names=schema.names)

    return common.map_arrow(docs.select(*names, text), run, schema, holds="bpe")


def decode(coded: DataFrame, ids: str = "ids", text: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """The opposite of ``encode``; a null list of ids gives a null text, ids outside the vocabulary an error."""
    shared = _shared(coded.sparkSession, path)
    keep = [f for f in coded.schema.fields if f.name not in (text, ids)]
    schema = T.StructType([*keep, T.StructField(text, T.StringType())])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(ids).to_pylist()
                counts = np.fromiter((len(x or ()) for x in lists), np.int64, len(lists))
                flat = np.fromiter((i for x in lists for i in x or ()), np.int64, int(counts.sum()))
                out = [None if x is None else t.decode() for x, t in zip(lists, c.decode(flat, counts), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(out, pa.string())], names=[*names, text])

    return common.map_arrow(coded.select(*names, ids), run, schema, holds="bpe")


def round_trip_digests(docs: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; the ids stay in the worker.

    A null text counts as empty: no tokens, and the digest of nothing in both columns.
    """
    shared = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for part in common.slices(batch, "text"):
                flat, counts = c.encode(texts_as_bytes(part, "text"))
                said = [hashlib.sha256(x).hexdigest() for x in c.decimal(flat, counts)]
                back = [hashlib.sha256(x).hexdigest() for x in c.decode(flat, counts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(said), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return common.map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", holds="bpe")
