"""Near-duplicate detection with fast similarity sketches (operator 8).

A sketch has ``T`` coordinates. In round i every shingle is hashed to one of ``T`` bins with a value, and a bin that no
earlier round filled takes the least value. After ``T`` such rounds, round T + j puts all shingles into bin j, so every
coordinate is filled and two sets agree in a coordinate with the probability of their Jaccard similarity, with the
concentration of independent draws. Work is about T log T plus the set's size, not T times the size.

Bands of ``ROWS`` coordinates propose candidates. Exact copies (equal shingle sets) are one class from the start. In
each bucket everything is compared with its least class first, on full sets. Clusters of candidates that then still lie
in different components compare those across components, block by block, by sketch and then on full sets. Components
are found by iterated joins. No bucket, link or component is ever gathered in one place or written out as all pairs.

A pair of similarity 0.8 misses all bands with probability below 3e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .bpe import texts_as_bytes
from .chunks import ragged

BANDS, ROWS = 42, 6
T = BANDS * ROWS
#: Documents of a cluster that are compared with each other in one task, about.
BLOCK = 400
#: Pairs whose sketches agree in a lower share than this are not verified: a pair of similarity 0.8 is below it with probability under 1e-9.
LEAST_AGREEMENT = 0.62

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = _mix(np.arange(1, 257, dtype=np.uint64) * _M1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (lower-cased A-Z, parted at white space) and the number of words of each text."""
    data = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    gap = _GAP[data]
    edge = np.diff(np.concatenate([[True], gap]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    out = np.zeros(len(begin), np.uint64)
    sizes = end - begin
    live = np.arange(len(begin))
    h = sizes.astype(np.uint64) * _M1
    k = 0
    while len(live):  # one step for each place in a word, over all words that are that long
        h[live] = (h[live] ^ _BYTE_CODES[data[begin[live] + k]]) * _M2
        h[live] ^= h[live] >> np.uint64(29)
        k += 1
        live = live[sizes[live] > k]
        if k == 64 and len(live):
            for i in live.tolist():
                h[i] = np.frombuffer(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
            break
    out[:] = _mix(h)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return out, np.diff(np.concatenate([[0], np.searchsorted(begin, ends)]))


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, text after text, and their numbers.

    A text with fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    words, counts = word_hashes(texts)
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    first = np.cumsum(counts) - counts
    at = ragged(first, n)
    text = np.repeat(np.arange(len(texts)), n)
    short = counts[text] < width
    h = np.zeros(len(at), np.uint64)
    last = len(words) - 1
    for k in range(width):
        w = words[np.minimum(at + k, last)] if len(words) else words
        inside = ~short | (k < counts[text])
        h = np.where(inside, _mix(h * _M1 + w), h)
    h = np.where(short, _mix(h + counts[text].astype(np.uint64)), h)
    sets, sizes = [], np.zeros(len(texts), np.int64)
    ends = np.cumsum(n)
    for i, (a, b) in enumerate(zip((ends - n).tolist(), ends.tolist(), strict=True)):
        if b > a:
            s = np.unique(h[a:b])
            sets.append(s)
            sizes[i] = len(s)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes


def sketches(flat: np.ndarray, sizes: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketches, one row of ``t`` 64-bit values for each set that is not empty (rows of empty sets are 0)."""
    n = len(sizes)
    out = np.zeros((n, t), np.uint64)
    filled = np.zeros((n, t), bool)
    todo = np.flatnonzero(sizes > 0)
    starts = np.cumsum(sizes) - sizes
    for i in range(2 * t):
        if not len(todo):
            break
        where = ragged(starts[todo], sizes[todo])
        row = np.repeat(np.arange(len(todo)), sizes[todo])
        h = _mix(flat[where] + np.uint64((i + 1) * int(_M1) % 2**64))
        if i < t:
            cell = row * t + ((h >> np.uint64(32)) % np.uint64(t)).astype(np.int64)
        else:
            cell = row * t + (i - t)
        value = _mix(h ^ _M2)
        least = np.full(len(todo) * t, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, cell, value)
        hit = np.zeros(len(todo) * t, bool)
        hit[cell] = True
        new = hit.reshape(-1, t) & ~filled[todo]
        out[todo] = np.where(new, least.reshape(-1, t), out[todo])
        filled[todo] |= new
        todo = todo[~filled[todo].all(axis=1)]
    return out


def band_keys(rows: np.ndarray) -> np.ndarray:
    """A 64-bit key of every band, different for different bands."""
    h = np.zeros((len(rows), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _M1
    for r in range(ROWS):
        h = _mix(h * _M2 + rows[:, r::ROWS][:, :BANDS])
    return h.astype(np.int64)


def set_key(data: bytes) -> bytes | None:
    """The digest of a set; none of an empty one."""
    return hashlib.blake2b(data, digest_size=16).digest() if data else None


def _sketch_table(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set; null if empty), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", 2 << 20):
                flat, sizes = shingle_sets(texts_as_bytes(part, "text"), width)
                ends = np.cumsum(sizes)
                keys = [set_key(flat[a:b].tobytes()) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                bands = band_keys(sketches(flat, sizes))
                listed = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(keys, pa.binary()), listed], names=["doc_id", "n_shingles", "set_key", "bands"])

    return common.map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    """id (of the document), set (sorted 64-bit hashes as bytes), set_key, and sketch (16 bits of each coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", 2 << 20):
                flat, sizes = shingle_sets(texts_as_bytes(part, "text"), width)
                ends = np.cumsum(sizes)
                sets = [flat[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                short = (sketches(flat, sizes) >> np.uint64(48)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.binary()), pa.array(map(set_key, sets), pa.binary()), pa.array([x.tobytes() for x in short], pa.binary())], names=["id", "set", "set_key", "sketch"])

    return common.map_arrow(docs.select("doc_id", "text"), run, "id long, set binary, set_key binary, sketch binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union for two ascending sets."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if not small or 100 * small < percent * large:
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that full sets confirm. Each pair reads two sets; a set shared by many pairs is not gathered with them."""
    left = sets.select(F.col("set_key").alias("_a"), F.col("set").alias("set_a")).hint("merge")
    right = sets.select(F.col("set_key").alias("_b"), F.col("set").alias("set_b")).hint("merge")
    both = pairs.join(left, F.col("a") == F.col("_a")).drop("_a").join(right, F.col("b") == F.col("_b")).drop("_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column("set_a"), batch.column("set_b")
            ok = [similar(np.frombuffer(sa[i].as_py(), np.uint64), np.frombuffer(sb[i].as_py(), np.uint64), percent) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return common.map_arrow(both.select("a", "b", "set_a", "set_b"), run, "a binary, b binary")


def connected(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of (a, b) links reaches.

    Most links lie around a few hubs, the lower ends. Each higher end first goes to its least hub, and only links among
    hubs remain; their labels shrink by joins until none changes.
    """
    lo, hi = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
    links = common.materialise(links.select(lo, hi).filter("lo != hi").distinct(), "cc-links")
    first = common.materialise(links.groupBy("hi").agg(F.min("lo").alias("hub")), "cc-hubs")
    lows = links.select(F.col("lo").alias("low")).distinct()
    across = links.join(first.withColumnRenamed("hi", "h"), F.col("hi") == F.col("h")).filter("lo != hub").select(F.col("hub").alias("a"), F.col("lo").alias("b"))
    steps = first.join(lows, F.col("hi") == F.col("low"), "left_semi").select(F.col("hub").alias("a"), F.col("hi").alias("b"))
    roots = _shrunk(across.union(steps).distinct()).withColumnRenamed("node", "h")
    tops = lows.join(first, F.col("low") == F.col("hi"), "left_anti").select(F.col("low").alias("node"), F.col("low").alias("hub"))
    nodes = first.select(F.col("hi").alias("node"), "hub").union(tops)
    return common.materialise(nodes.join(roots, F.col("hub") == F.col("h"), "left").select("node", F.coalesce("root", "hub").alias("root")), "cc")


def _shrunk(links: DataFrame) -> DataFrame:
    """(node, root) of links, by taking the least label of all neighbours and then the label's own label."""
    edges = common.materialise(links.union(links.select("b", "a")), "cc-edges")
    labels = common.materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "cc-0")
    k = 0
    while True:
        k += 1
        at = labels.select(F.col("node").alias("n"), F.col("root").alias("r"))
        near = edges.join(at, F.col("b") == F.col("n")).groupBy(F.col("a").alias("n2")).agg(F.min("r").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("n2"), "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        step = lower.join(at, F.col("root") == F.col("n"), "left").select("node", "old", F.least("root", F.coalesce("r", "root")).alias("root"))
        step = common.materialise(step, f"cc-{k}")
        labels = step.select("node", "root")
        if not step.filter("old != root").head(1):
            return labels


def _cross_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of a cluster of candidates.

    ``members``: cluster, n_blk, blk, id, comp, set, sketch; a large cluster lies in ``n_blk`` blocks, and a task compares
    two of them: pairs of different components whose sketches don't rule them out are verified on full sets, the
    likeliest first, until their components are joined. So all pairs are decided, but only links that join components
    leave a task.
    """
    # block i meets blocks i, i + 1, ...: one row of the pair's lower and higher block each
    dealt = members.groupBy("cluster", "blk").agg(F.first("n_blk").alias("n_blk"), F.collect_list(F.struct("id", "comp", "set", "sketch")).alias("rows"))
    low = dealt.select("cluster", F.col("blk").alias("i"), F.explode(F.sequence("blk", F.col("n_blk") - 1)).alias("j"), F.col("rows").alias("left"))
    high = dealt.select(F.col("cluster").alias("c"), F.col("blk").alias("jj"), F.col("rows").alias("right"))
    pairs = low.join(high, (F.col("cluster") == F.col("c")) & (F.col("j") == F.col("jj"))).select("i", "j", "left", "right")

    def arrays(rows, number: dict[bytes, int]) -> tuple:
        sets = [np.frombuffer(x, np.uint64) for x in rows.field("set").to_pylist()]
        sk = np.stack([np.frombuffer(x, np.uint16) for x in rows.field("sketch").to_pylist()])
        comps = np.array([number.setdefault(c, len(number)) for c in rows.field("comp").to_pylist()], np.int64)
        return rows.field("id").to_pylist(), comps, np.fromiter(map(len, sets), np.int64, len(sets)), sk, sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                same_block = batch.column("i")[r].as_py() == batch.column("j")[r].as_py()
                number: dict[bytes, int] = {}
                a_id, a_comp, a_size, a_sk, a_sets = left = arrays(batch.column("left")[r].values, number)
                b_id, b_comp, b_size, b_sk, b_sets = left if same_block else arrays(batch.column("right")[r].values, number)
                joined: dict[int, int] = {}

                def find(c: int, joined: dict[int, int] = joined) -> int:
                    while c in joined:
                        c = joined[c]
                    return c

                found: list[tuple[bytes, bytes]] = []
                for x in range(len(a_id)):
                    ok = (b_comp != a_comp[x]) & (100 * np.minimum(b_size, a_size[x]) >= percent * np.maximum(b_size, a_size[x]))
                    if same_block:
                        ok[: x + 1] = False
                    y = np.flatnonzero(ok)
                    if not len(y):
                        continue
                    agree = (b_sk[y] == a_sk[x]).mean(axis=1)
                    for z in y[np.argsort(-agree, kind="stable")[: int((agree >= LEAST_AGREEMENT).sum())]].tolist():
                        p, q = find(int(a_comp[x])), find(int(b_comp[z]))
                        if p != q and similar(a_sets[x], b_sets[z], percent):
                            joined[max(p, q)] = min(p, q)
                            found.append((a_id[x], b_id[z]))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in range(2)], names=["a", "b"])

    return common.map_arrow(pairs, run, "a binary, b binary")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Words are lower-cased (A-Z) and parted at white space; a document's set holds its distinct ``width``-word shingles, or
    its whole sequence if it has fewer words. Documents are linked from ``percent`` percent Jaccard similarity on.
    ``component_id`` is the least doc_id reachable by links and ``kept`` tells whether it is the document's own. Null
    and empty texts have no shingles and link nothing. doc_id must be whole numbers. Nodes of the graph are distinct sets,
    so rows with equal doc_id and different texts link independently. A null doc_id is never linked: its component is
    null and it is kept.
    """
    table = common.materialise(_sketch_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width), "nd-sketches")
    # exact copies: one class for each set, named by the set's digest
    classes = table.filter("set_key is not null and doc_id is not null").groupBy(F.col("set_key").alias("rep")).agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"))
    classes = common.materialise(classes, "nd-classes")
    entries = classes.select("rep", F.explode("bands").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("k"), "leader")
    shared = entries.join(buckets.hint("merge"), F.col("key") == F.col("k")).filter("rep != leader")
    pairs = common.materialise(shared.select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct(), "nd-pairs")
    clusters = connected(pairs)
    # texts meet the ids by a shuffle at any size; only these documents' sets are made
    names = classes.select("rep", "doc").join(clusters.select("node").hint("merge"), F.col("rep") == F.col("node"), "left_semi")
    involved = names.select(F.col("doc").alias("id")).hint("merge")
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(involved, F.col("doc_id") == F.col("id"), "left_semi")
    # of rows with an equal id, the one whose set is the class's stands for it
    made = _full_sets(wanted, width).join(names.select(F.col("doc"), F.col("rep").alias("sk")), (F.col("id") == F.col("doc")) & (F.col("set_key") == F.col("sk")), "left_semi")
    sets = common.materialise(made.dropDuplicates(["set_key"]).select("set_key", "set", "sketch"), "nd-sets")
    links = common.materialise(_verify(pairs, sets, percent), "nd-links")
    roots = connected(links)

    comps = clusters.select(F.col("node").alias("id"), F.col("root").alias("cluster")).join(roots, F.col("id") == F.col("node"), "left").select("id", "cluster", F.coalesce("root", "id").alias("comp"))
    # a cluster of two has met already
    mixed = comps.groupBy("cluster").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo != hi and n > 2").select(F.col("cluster").alias("c"), "n")
    # members fall into blocks by a hash before they carry their sets, so that no cluster meets in one task
    n_blk = F.ceil(F.col("n") / BLOCK).cast("int")
    open_ = comps.join(mixed, F.col("cluster") == F.col("c")).select("cluster", "id", "comp", n_blk.alias("n_blk"), F.pmod(F.xxhash64("id"), n_blk).cast("int").alias("blk"))
    met = open_.join(sets.hint("merge"), F.col("id") == F.col("set_key")).drop("set_key")
    extra = common.materialise(_cross_links(met, percent), "nd-cross-links")
    if extra.head(1):
        roots = connected(links.union(extra))
    # a component is named by its least document
    placed = classes.select("rep", "doc").join(roots, F.col("rep") == F.col("node"), "left").select("rep", "doc", F.coalesce("root", "rep").alias("root"))
    least = placed.groupBy(F.col("root").alias("r")).agg(F.min("doc").alias("component"))
    root_of = placed.join(least, F.col("root") == F.col("r")).select(F.col("rep").alias("sk"), "component")
    out = table.select("doc_id", "n_shingles", "set_key").join(root_of, F.col("set_key") == F.col("sk"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component.isNull() | (component == F.col("doc_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one of least doc_id. Columns are unchanged.

    Of rows that agree in doc_id and text one stays (the least by its other columns' text). Rows without an id all stay.
    """
    told = common.materialise(near_duplicates(docs, width, percent), "nd-told")
    gone_, again_, place_ = common.fresh(docs, "_gone", "_again", "_place")
    ids = F.col("doc_id").cast("long")
    gone = told.filter("not kept").select(F.col("doc_id").alias(gone_)).distinct()
    stay = docs.join(gone, ids == F.col(gone_), "left_anti")
    again = told.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select(F.col("doc_id").alias(again_))
    if not again.head(1):  # every id names one row
        return stay
    once = stay.join(again, ids == F.col(again_), "left_anti")
    order = Window.partitionBy("doc_id", "text").orderBy(F.to_json(F.struct(*docs.columns)))
    twice = stay.join(again, ids == F.col(again_), "left_semi").withColumn(place_, F.row_number().over(order)).filter(F.col(place_) == 1)
    return once.unionByName(twice.select(*docs.columns))
