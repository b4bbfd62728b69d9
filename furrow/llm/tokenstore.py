"""Token ids in files of patched frame-of-reference blocks (operator 9).

A file holds documents in ascending order of their id:

    magic "PFOR1\\n" | blocks | document table | block starts | footer

* Blocks hold ``BLOCK`` ids each (the last one fewer) across document bounds. A block is: minimum (4 bytes), width
  (1 byte), number of exceptions (2 bytes), the differences from the minimum in ``width`` bits each, packed into 64-bit
  little-endian words, then the exceptions' positions (2 bytes each) and high parts (4 bytes each). The width is that of
  a stated percentile of the block's differences; larger ones keep their low bits in place and are listed as exceptions.
* The document table has every document's id (8 bytes) and number of ids (8 bytes). The block starts are byte offsets
  (8 bytes each), so that a reader can seek to the block that holds any position. Behind them is one byte for each
  document, 1 where its id is null (and written as 0); such documents come last.
* The footer has the numbers of documents, ids and blocks and the offset of the document table (8 bytes each), then magic.

Rows are dealt by ranges of the document id, and each task writes one file; its name and totals come back as one row
of the manifest. A task that is tried again writes another file, and only the file of the attempt whose row arrives is
ever read. Positions before a file are running sums of the manifest, one row a file.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .bpe import TOKENIZERS, read_vocabulary
from .chunks import ChunkTable, flattened, merged

MAGIC = b"PFOR1\n"
BLOCK = 1024
FOOTER = struct.Struct("<4q6s")
HEAD = struct.Struct("<IBH")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values below 2 ** width, each row packed into 64-bit words."""
    rows, n = values.shape
    out = np.zeros((rows, -(-n * width // 64)), np.uint64)
    v = values.astype(np.uint64)
    for i in range(n if width else 0):
        word, bit = divmod(i * width, 64)
        out[:, word] |= v[:, i] << np.uint64(bit)
        if bit + width > 64:
            out[:, word + 1] |= v[:, i] >> np.uint64(64 - bit)
    return out


def _unpack(words: np.ndarray, width: int, n: int) -> np.ndarray:
    out = np.zeros((len(words), n), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(n if width else 0):
        word, bit = divmod(i * width, 64)
        x = words[:, word] >> np.uint64(bit)
        if bit + width > 64:
            x = x | (words[:, word + 1] << np.uint64(64 - bit))
        out[:, i] = x & mask
    return out


def _bits(values: np.ndarray) -> np.ndarray:
    """The number of bits of each value below 2 ** 32."""
    return np.where(values > 0, np.frexp(values.astype(np.float64))[1], 0)


def encode_blocks(ids: np.ndarray, percentile: float = 95.0) -> list[bytes]:
    """Blocks of ``BLOCK`` ids below 2 ** 32. ``percentile`` of a block's differences fit its width."""
    if not len(ids):
        return []
    ids = ids.astype(np.int32 if ids.dtype == np.int32 else np.int64, copy=False)
    n_full, rest = divmod(len(ids), BLOCK)
    groups = [ids[: n_full * BLOCK].reshape(n_full, BLOCK)] if n_full else []
    if rest:
        groups.append(ids[n_full * BLOCK :].reshape(1, rest))
    out: list[bytes] = []
    for g in groups:
        n = g.shape[1]
        low = g.min(axis=1)
        diff = g - low[:, None]
        at = min(n - 1, int(np.ceil(n * percentile / 100)) - 1)
        widths = _bits(np.partition(diff, at, axis=1)[:, at])
        coded: list[bytes] = [b""] * len(g)
        for width in np.unique(widths).tolist():
            which = np.flatnonzero(widths == width)
            d = diff[which]
            packed = _pack(d & ((1 << width) - 1), width)
            for row, k in enumerate(which.tolist()):
                far = np.flatnonzero(d[row] >> width)
                head = HEAD.pack(int(low[k]), width, len(far))
                coded[k] = head + packed[row].tobytes() + far.astype("<u2").tobytes() + (d[row][far] >> width).astype("<u4").tobytes()
        out += coded
    return out


def decode_blocks(data: bytes, starts: np.ndarray, n_ids: int) -> np.ndarray:
    """All ids of blocks that begin at the given offsets of ``data``."""
    out = np.zeros(n_ids, np.int64)
    heads = [HEAD.unpack_from(data, s) for s in starts.tolist()]
    full = n_ids // BLOCK
    by: dict[tuple[int, int], list[int]] = {}
    for k, (_, width, _) in enumerate(heads):
        by.setdefault((width, BLOCK if k < full else n_ids - full * BLOCK), []).append(k)
    for (width, n), which in by.items():
        words = -(-n * width // 64)
        rows = np.stack([np.frombuffer(data, "<u8", words, int(starts[k]) + HEAD.size) for k in which]) if words else np.zeros((len(which), 0), np.uint64)
        values = _unpack(rows, width, n).astype(np.int64)
        for row, k in enumerate(which):
            low, _, n_far = heads[k]
            if n_far:
                at = int(starts[k]) + HEAD.size + words * 8
                far = np.frombuffer(data, "<u2", n_far, at).astype(np.int64)
                values[row, far] |= np.frombuffer(data, "<u4", n_far, at + 2 * n_far).astype(np.int64) << width
            out[k * BLOCK : k * BLOCK + n] = values[row] + low
    return out


class FileWriter:
    """Writes one file; ids come in document order and leave in whole blocks."""

    def __init__(self, sink) -> None:
        self.sink, self.at, self.n_ids = sink, len(MAGIC), 0
        self.rest = np.zeros(0, np.int32)
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.starts: list[int] = []
        sink.write(MAGIC)

    def _put(self, ids: np.ndarray) -> None:
        for b in encode_blocks(ids):
            self.starts.append(self.at)
            self.at += len(b)
            self.sink.write(b)

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, nulls: np.ndarray | None = None) -> None:
        self.docs.append(doc_ids.astype("<i8"))
        self.nulls.append(np.zeros(len(doc_ids), "u1") if nulls is None else nulls.astype("u1"))
        self.counts.append(counts.astype("<i8"))
        self.n_ids += len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // BLOCK * BLOCK
        if whole >= 64 * BLOCK:
            self._put(self.rest[:whole])
            self.rest = self.rest[whole:]

    def close(self) -> None:
        self._put(self.rest)
        docs, counts = (np.concatenate([*x, np.zeros(0, "<i8")]) for x in (self.docs, self.counts))
        for x in (docs, counts, np.array(self.starts, "<i8")):
            self.sink.write(x.astype("<i8").tobytes())
        self.sink.write(np.concatenate([*self.nulls, np.zeros(0, "u1")]).tobytes())
        self.sink.write(FOOTER.pack(len(docs), self.n_ids, len(self.starts), self.at, MAGIC))


def read_parts(source, size: int, most_ids: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents of a file, some at a time: ids of documents, numbers of ids, all their ids, and whether documents' ids are null.

    ``source`` has ``read_at(n, offset)``. A part has about ``most_ids`` ids; a longer document stands alone.
    """
    n_docs, n_ids, n_blocks, table, magic = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
    if magic != MAGIC or source.read_at(len(MAGIC), 0) != MAGIC:
        raise ValueError("not a file of this format, or cut short")
    numbers = np.frombuffer(source.read_at(8 * (2 * n_docs + n_blocks), table), "<i8")
    nulls = np.frombuffer(source.read_at(n_docs, table + 8 * (2 * n_docs + n_blocks)), "u1").astype(bool)
    docs, counts, starts = numbers[:n_docs], numbers[n_docs : 2 * n_docs], np.append(numbers[2 * n_docs :], table)
    ends = np.cumsum(counts)
    first = 0
    while first < n_docs:
        begin = int(ends[first] - counts[first])
        last = max(first + 1, int(np.searchsorted(ends, begin + most_ids, "right")))
        end = int(ends[last - 1])
        b0, b1 = begin // BLOCK, max(begin // BLOCK, -(-end // BLOCK))
        ids = np.zeros(0, np.int64)
        if end > begin:
            data = source.read_at(int(starts[b1] - starts[b0]), int(starts[b0]))
            held = min(n_ids, b1 * BLOCK) - b0 * BLOCK
            ids = decode_blocks(data, starts[b0:b1] - starts[b0], held)[begin - b0 * BLOCK : end - b0 * BLOCK]
        yield docs[first:last], counts[first:last], ids, nulls[first:last]
        first = last


def _library_table(tokenizer_json: str, end_id: int = 2) -> ChunkTable:
    """Chunks between white space, encoded by the tokenizers library; white space is dropped and parts words there.

    The chunk ``None`` is the end of a document.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    t = Tokenizer.from_str(tokenizer_json)
    t.no_truncation()
    t.no_padding()

    # words of lower-case letters pass the library's normalising and splitting whole; many go to its model in one call
    plain = Tokenizer(t.model)
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    suffix = json.loads(tokenizer_json)["model"]["end_of_word_suffix"]
    vocabulary = t.get_vocab()
    is_end = np.zeros(max(vocabulary.values()) + 1, bool)
    is_end[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def plain_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of lower-case letters, in order, and their numbers; the mark of a word's end parts them."""
        parts, numbers = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 4000):
            part = words[at : at + 4000]
            ids = np.array(plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(is_end[ids]) + 1
            if len(cuts) != len(part):
                raise ValueError("the vocabulary does not mark the ends of words")
            parts.append(ids)
            numbers.append(np.diff(cuts, prepend=0))
        return np.concatenate(parts), np.concatenate(numbers)

    def encode(chunks: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters go to the library's model; all else through the whole library. ``None`` ends a document."""
        words, rest, lists = [], [], []
        for i, c in enumerate(chunks):
            if c:
                text = c.decode()
                if text.isalpha() and (text.isascii() or (max(text) < "\u0590" and text == text.lower() and unicodedata.is_normalized("NFC", text))):
                    words.append(text.lower())
                    continue
            rest.append(i)
        for at in range(0, len(rest), 20_000):
            part = [chunks[i] for i in rest[at : at + 20_000]]
            coded = t.encode_batch_fast([(c or b"").decode() for c in part], add_special_tokens=False)
            lists += [[end_id] if c is None else e.ids for c, e in zip(part, coded, strict=True)]
        whole = np.ones(len(chunks), bool)
        whole[rest] = False
        return merged(whole, plain_ids(words), flattened(lists))

    return ChunkTable(encode, most_chunks=350_000)


def write_files(docs: DataFrame, folder: str, path: str = f"{TOKENIZERS}/word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Encode ``text`` and write files into ``folder``; the manifest, materialised: file, bytes, n_docs, n_ids and where its first document stands in the order.

    Null and empty texts have the end id alone. Rows with a null doc_id come last. Rows with equal doc_id are kept, in the
    order of a hash of their text. Other columns are not read. An empty table writes no file.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = common.held("tokenstore", f"{end_id}|{hash(shared.value)}", lambda: _library_table(shared.value, end_id))
        writer, name, fs, first = None, "", None, None
        for batch in batches:
            for part in common.slices(batch, "text", 8 << 20):
                doc = part.column("doc_id")
                ids, nulls = pc.fill_null(doc, 0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False)
                if writer is None:
                    fs, at = pa.fs.FileSystem.from_uri(folder)
                    fs.create_dir(at, recursive=True)
                    name = f"{at}/{uuid.uuid4().hex}.pfor"
                    sink = fs.open_output_stream(name)
                    writer, first = FileWriter(sink), (bool(nulls[0]), int(ids[0]), part.column("mark")[0].as_py())
                flat, counts = table.gather(table.rows_of_split(pc.fill_null(part.column("text"), "")))
                writer.add(ids, counts, flat, nulls)
        if writer is not None:
            writer.close()
            sink.close()
            size = fs.get_file_info(name).size
            n_docs = sum(map(len, writer.docs))
            yield pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "n_docs": [n_docs], "n_ids": [writer.n_ids], "first_null": [first[0]], "first_doc": [first[1]], "first_mark": [first[2]]})

    # by ranges of id and a hash of the text, so that an id with very many rows is parted as well
    order = [F.col("doc_id").asc_nulls_last(), F.col("mark")]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    dealt = keyed.repartitionByRange(common.partitions_for(docs), *order).sortWithinPartitions(*order, "text")
    return common.materialise(common.map_arrow(dealt, run, "file string, bytes long, n_docs long, n_ids long, first_null boolean, first_doc long, first_mark long", holds="tokenstore"), "pfor-manifest", batch_rows=2500)


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("first_null", "first_doc", "first_mark", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("file", "bytes", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                fs, _ = pa.fs.FileSystem.from_uri(folder)
                at = f["before"]
                with fs.open_input_file(f["file"]) as source:
                    for docs, counts, ids, nulls in read_parts(source, f["bytes"]):
                        data = ids.astype("<u4").tobytes()
                        ends = np.cumsum(counts)
                        cuts = [0, *(4 * ends).tolist()]
                        crc = [zlib.crc32(data[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
                        yield pa.RecordBatch.from_arrays([pa.array(docs, mask=nulls), pa.array(at + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        at += int(ends[-1]) if len(ends) else 0

    n = max(1, min(10_000, manifest.count()))
    return common.map_arrow(files.repartition(n), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_round_trip(docs: DataFrame) -> DataFrame:
    """Write all documents into a scratch folder and read them back."""
    folder = common.scratch_path(docs.sparkSession, "pfor")
    return read_files(write_files(docs, folder), folder)
