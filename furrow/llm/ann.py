"""Approximate nearest neighbours by multi-index hashing (operator 7).

Vectors are centred, rotated and cut to signs: several rotations learned by iterative quantisation (principal axes, then
the rotation that loses least by taking signs) give ``BITS`` bits. A code is split into 8-bit substrings, each indexed
by its value. Two codes within Hamming distance r = 32 a + b agree within a in one of the first b + 1 substrings or
within a - 1 in one of the others, so probing these buckets retrieves every code within r. Retrieved codes beyond r are
dropped, and the rest are ranked by exact distance.

Rows are packed into index blocks and dealt to buckets; the query set is packed too, and every bucket meets it in
blocks. A block returns at most k rows for each query. Queries that find fewer than k codes within r meet all vectors.

The rotations and r are fitted on a sample of at most ``SAMPLE`` rows (smallest hash of the id), where r is the distance
that holds ``SHARE`` of true neighbours; in more rows true neighbours are nearer. Every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BITS = 256
PARTS = BITS // 8
SAMPLE = 4000
SHARE = 0.97
BLOCK = 8192
QUERY_BLOCK = 256


@dataclass
class Codes:
    """How vectors become codes: the centre, the rotations side by side, and the radius to search."""

    size: int
    centre: np.ndarray
    turn: np.ndarray
    radius: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """One row of ``PARTS`` bytes for each vector."""
        return np.packbits((vectors - self.centre) @ self.turn > 0, axis=1)


def _rotation(y: np.ndarray, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """The rotation of principal coordinates that taking signs hurts least, from a random start."""
    r, _ = np.linalg.qr(rng.normal(size=(y.shape[1], y.shape[1])))
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.sign(y @ r).T @ y)
        r = (u @ vt).T
    return r


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of one code from many."""
    return np.bitwise_count(b.view(np.uint64) ^ a.view(np.uint64)).sum(axis=1, dtype=np.int64)


def fit(sample: np.ndarray, k: int, seed: int = 5, share: float = SHARE) -> Codes:
    rng = np.random.default_rng(seed)
    n, size = sample.shape
    centre = sample.mean(axis=0) if n else np.zeros(size)
    axes = np.linalg.eigh(np.cov((sample - centre).T).reshape(size, size))[1] if n > 1 else np.eye(size)
    y = (sample - centre) @ axes
    turns = [axes @ _rotation(y, rng) for _ in range(-(-BITS // size))]
    codes = Codes(size, centre, np.concatenate(turns, axis=1)[:, :BITS], BITS)
    if n > 1:
        coded, far = codes.of(sample), []
        for i in rng.permutation(n)[:200].tolist():
            d = ((sample - sample[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            near = np.argsort(d, kind="stable")[: min(k, n - 1)]
            far += distances(coded[i], coded[near]).tolist()
        codes.radius = int(np.quantile(far, share, method="higher"))
    return codes


_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None])


class Block:
    """Rows of the index with a table of every substring's values."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray) -> None:
        self.ids, self.vectors, self.codes = ids, vectors, codes
        self.order = np.argsort(codes, axis=0, kind="stable").T
        self.counts = np.stack([np.bincount(codes[:, j], minlength=256) for j in range(PARTS)])
        self.starts = np.cumsum(self.counts, axis=1) - self.counts

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose codes lie within a Hamming distance: probe substrings, then check whole codes."""
        from .chunks import ragged

        whole, rest = divmod(radius, PARTS)
        hit = np.zeros(len(self.ids), bool)
        for j in range(PARTS):
            most = whole if j <= rest else whole - 1
            if most < 0:
                continue
            probes = np.flatnonzero(_NEAR[code[j]] <= most)
            hit[self.order[j][ragged(self.starts[j][probes], self.counts[j][probes])]] = True
        rows = np.flatnonzero(hit)
        return rows[distances(code, self.codes[rows]) <= radius]


def nearest(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of some rows in double precision, ties to the smaller id, without the query's own."""
    keep = ids != query_id
    vectors, ids = vectors[keep], ids[keep]
    diff = vectors.astype(np.float64) - query
    d = np.sqrt((diff * diff).sum(axis=1))
    order = np.lexsort((ids, d))[:k]
    return ids[order], d[order]


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _pack(rows: DataFrame, size: int, block: int, codes: Codes) -> DataFrame:
    """blk, ids, vectors (doubles) and codes of up to ``block`` rows, as bytes."""
    import uuid

    shared = rows.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value

        def out(ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"blk": [uuid.uuid4().hex], "n": [len(ids)], "ids": [ids.tobytes()], "vectors": [v.tobytes()], "codes": [c.of(v).tobytes()]})

        ids, vectors = np.zeros(0, np.int64), np.zeros((0, size))
        for batch in batches:
            if batch.num_rows:
                ids = np.concatenate([ids, batch.column("id").to_numpy(zero_copy_only=False)])
                vectors = np.concatenate([vectors, np.asarray(batch.column("v").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)])
            while len(ids) >= block:
                yield out(ids[:block], vectors[:block])
                ids, vectors = ids[block:], vectors[block:]
        if len(ids):
            yield out(ids, vectors)

    return common.map_arrow(rows, run, "blk string, n long, ids binary, vectors binary, codes binary")


def _search(index: DataFrame, queries: DataFrame, buckets: int, codes: Codes, k: int, every: bool) -> DataFrame:
    """At most k rows of each block for each query: query_id, vec_id, score, found. ``every``: rank all vectors instead."""
    shared = index.sparkSession.sparkContext.broadcast(codes)
    placed = index.withColumn("bucket", F.pmod(F.xxhash64("blk"), F.lit(buckets)))
    asked = queries.select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("codes").alias("q_codes"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("b"))
    met = placed.join(asked, F.col("bucket") == F.col("b")).select("blk", "ids", "vectors", "codes", "q_ids", "q_vectors", "q_codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        name, block = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["blk"] != name:
                    name = r["blk"]
                    block = Block(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, c.size), np.frombuffer(r["codes"], np.uint8).reshape(-1, PARTS))
                q_ids = np.frombuffer(r["q_ids"], np.int64)
                q_vectors, q_codes = np.frombuffer(r["q_vectors"]).reshape(-1, c.size), np.frombuffer(r["q_codes"], np.uint8).reshape(-1, PARTS)
                parts = []
                for i, q in enumerate(q_ids.tolist()):
                    rows = np.arange(len(block.ids)) if every else block.within(q_codes[i], c.radius)
                    ids, d = nearest(block.vectors[rows], block.ids[rows], q_vectors[i], q, k)
                    parts.append((np.full(len(ids), q), ids, d))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[j] for p in parts])) for j in range(3)], names=["query_id", "vec_id", "score"])

    return common.map_arrow(met, run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query by Euclidean distance, nearest first.

    Both tables have the id and the vector. Null, empty and zero vectors, those with null or non-finite components and
    those of another length than most of the sample take no part; nor do rows with a null id. A query never finds its
    own id. Ties go to the smaller id; with fewer than k candidates all are returned. Repeated queries count once.
    """
    clean = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = clean(vectors)
    drawn = [r["v"] for r in rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(sample).collect()]
    if not drawn:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = [len(v) for v in drawn]
    size = max(set(sizes), key=lambda s: (sizes.count(s), -s))
    codes = fit(np.array([v for v in drawn if len(v) == size], np.float64), k)
    fits = F.size("v") == size
    index = common.materialise(_pack(rows.filter(fits), size, BLOCK, codes), "ann-index")
    asked = common.materialise(_pack(clean(queries).filter(fits).dropDuplicates(["id"]), size, QUERY_BLOCK, codes), "ann-queries")
    buckets = max(8, -(-index.count() // 8))
    found = common.materialise(_ranked(_search(index, asked, buckets, codes, k, False), k), "ann-found")
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("e"))
    poor = clean(queries).filter(fits).dropDuplicates(["id"]).join(enough, F.col("id") == F.col("e"), "left_anti")
    poor = common.materialise(_pack(poor, size, QUERY_BLOCK, codes), "ann-poor")
    if not poor.head(1):
        return found
    rest = _ranked(_search(index, poor, buckets, codes, k, True), k)
    return found.join(enough, F.col("query_id") == F.col("e"), "left_semi").unionByName(rest)
