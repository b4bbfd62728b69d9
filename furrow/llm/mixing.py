"""Mixing overlapping sources to target weights by min-cost flow (operator 10).

Documents are summed by their membership pattern (the set of sources they belong to). In the flow network every
pattern offers its words once at cost 0, again at cost 1, and so on up to the most repeats (convex costs, so a second
use comes only when first uses no longer help); a pattern's words may flow to any of its sources, each up to its quota.
Successive shortest paths solve it on a graph of patterns and sources, never of documents. Then every pattern takes
whole documents in the order of a seeded hash until its flow is met.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WEIGHTS = (3, 1, 2)
BINS = 4096


def targets_of(sizes: dict, weights: dict, share: float = 1.5, most: float = 2.0) -> dict:
    """Quotas: ``share`` of all sizes by weight, none above ``most`` times its source's size, the excess reshared.

    What no source can hold stays unplaced. Sources of size 0 have target 0.
    """
    total = share * sum(sizes.values())
    out = dict.fromkeys(sizes, 0.0)
    open_ = [k for k in sizes if sizes[k] > 0]
    left = total
    while open_:
        weight = sum(weights[k] for k in open_)
        over = [k for k in open_ if left * weights[k] / weight > most * sizes[k]]
        if not over:
            for k in open_:
                out[k] = left * weights[k] / weight
            break
        for k in over:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return out


@dataclass
class Flow:
    """amounts: (pattern, source) -> words."""

    amounts: dict
    placed: float
    cost: float


def min_cost_flow(patterns: dict, quotas: dict, most: int = 2) -> Flow:
    """Route words of patterns (tuples of sources -> words) to quotas, as much as fits, at the least repeats.

    Shortest augmenting paths over patterns, sources and a sink; an amount below a millionth of a word ends a path's use.
    The graph has as many nodes as there are patterns and sources.
    """
    names = sorted(patterns, key=repr)
    sources = sorted({s for p in names for s in p}, key=repr)
    nodes = 2 + len(names) + len(sources)
    to: list[int] = []
    cap: list[float] = []
    cost: list[int] = []
    out: list[list[int]] = [[] for _ in range(nodes)]

    def edge(a: int, b: int, c: float, w: int) -> int:
        for x, y, k, v in ((a, b, c, w), (b, a, 0.0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(v)
        return len(to) - 2

    start, sink = 0, 1
    place = {s: 2 + len(names) + i for i, s in enumerate(sources)}
    routes = {}
    for i, p in enumerate(names):
        for repeat in range(most):
            edge(start, 2 + i, float(patterns[p]), repeat)
        for s in p:
            routes[p, s] = edge(2 + i, place[s], float("inf"), 0)
    for s in sources:
        edge(place[s], sink, float(quotas.get(s, 0.0)), 0)
    placed = spent = 0.0
    while True:
        far, via, queue, queued = [float("inf")] * nodes, [-1] * nodes, deque([start]), {start}
        far[start] = 0
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in out[a]:
                if cap[e] > 1e-6 and far[a] + cost[e] < far[to[e]]:
                    far[to[e]], via[to[e]] = far[a] + cost[e], e
                    if to[e] not in queued:
                        queue.append(to[e])
                        queued.add(to[e])
        if via[sink] < 0:
            break
        path, at = [], sink
        while at != start:
            path.append(via[at])
            at = to[via[at] ^ 1]
        amount = min(cap[e] for e in path)
        for e in path:
            cap[e] -= amount
            cap[e ^ 1] += amount
        placed, spent = placed + amount, spent + amount * far[sink]
    return Flow({k: cap[e ^ 1] for k, e in routes.items()}, placed, spent)


def _order(doc: Column, seed: int) -> tuple[Column, Column]:
    """A document's place in the seeded order: the bin, and the digest within it."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") % BINS).cast("int"), digest


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2, seed: int = 11, text: str = "text", source: str = "source") -> DataFrame:
    """What the mix takes of every document: doc_id, source, size, source_size, target, copies, taken.

    ``source`` is a string, or an array of strings for documents of several sources; null (or an empty array) is a source
    of its own that sorts last. Sizes are words of the text (null and empty texts: 0, never taken). ``copies`` is 0 to
    ``most`` and ``taken`` is copies times size. The order depends on doc_id and seed alone; rows with equal doc_id are
    told apart by their size, and equal rows are taken in either order with the same totals. For several sources, ``source_size`` and
    ``target`` are sums over the document's sources. Sources are a small table (one row each on the driver); documents
    are summed where they lie, and put in order within one of ``BINS`` bins of a pattern.
    """
    several = docs.schema[source].dataType.typeName() == "array"
    bin_, digest = _order(F.col("doc_id"), seed)
    member = F.array_sort(F.array_distinct(F.filter(F.col(source), lambda x: x.isNotNull()))) if several else F.when(F.col(source).isNotNull(), F.array(F.col(source)))
    pattern = F.coalesce(member, F.array().cast("array<string>"))
    narrow = docs.select("doc_id", F.col(source).alias("source"), pattern.alias("pattern"), common.n_words_of(F.col(text)).alias("size"))
    narrow = common.materialise(narrow.withColumns({"bin": bin_, "digest": digest}), "mix-sizes")

    by_pattern = {tuple(r["pattern"]) or (None,): r["size"] for r in narrow.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
    sources = sorted({s for p in by_pattern for s in p}, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(v for p, v in by_pattern.items() if s in p) for s in sources}
    # a document counts in each of its sources, but all sizes are those of documents
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    scale = sum(by_pattern.values()) / max(1, sum(sizes.values()))
    targets = targets_of(sizes, weight, share * scale, float(most))
    flow = min_cost_flow(by_pattern, targets, most)
    spark = docs.sparkSession
    rows = []
    for p, size in by_pattern.items():
        words = sum(flow.amounts.get((p, s), 0.0) for s in p)
        whole = min(most, int(words // size)) if size else 0
        rows.append(([s for s in p if s is not None], whole, float(words - whole * size), sum(sizes[s] for s in p), float(sum(targets[s] for s in p))))
    plan = spark.createDataFrame(rows, "p array<string>, whole int, rest double, source_size long, target double")

    joined = narrow.join(plan, F.col("pattern") == F.col("p")).drop("p")
    per_bin = narrow.groupBy("pattern", "bin").agg(F.sum("size").alias("in_bin"))
    running = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = per_bin.withColumn("before", F.coalesce(F.sum("in_bin").over(running), F.lit(0))).select(F.col("pattern").alias("p"), F.col("bin").alias("b"), "in_bin", "before")
    placed = joined.join(bins, (F.col("pattern") == F.col("p")) & (F.col("bin") == F.col("b"))).drop("p", "b")
    upto = F.sum("size").over(Window.partitionBy("pattern", "bin").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, 0))
    # the document that crosses the mark is taken if that comes nearer to it
    placed = placed.withColumn("more", F.col("before") + upto - F.col("size") / 2 <= F.col("rest"))
    placed = common.materialise(placed.select("doc_id", "pattern", "digest", "size", "source", "source_size", "target", "whole", "rest", (F.col("more") & (F.col("size") > 0) & (F.col("whole") < most)).alias("more")), "mix-taken")
    # one document is added or dropped where that brings a pattern's total nearer to its mark
    gaps = placed.groupBy("pattern").agg((F.first("rest") - F.sum(F.when(F.col("more"), F.col("size")).otherwise(0))).alias("gap")).select(F.col("pattern").alias("p"), "gap")
    swap = placed.join(gaps, F.col("pattern") == F.col("p")).filter((F.col("size") > 0) & (F.col("whole") < most) & (F.col("more") == (F.col("gap") < 0)))
    off = F.abs(F.abs(F.col("gap")) - F.col("size"))
    best = swap.filter(off < F.abs(F.col("gap"))).groupBy("pattern").agg(F.min_by(F.struct("digest", "size"), F.struct(off, "digest", "size")).alias("best"))
    best = best.select(F.col("pattern").alias("p"), F.col("best.digest").alias("best_digest"), F.col("best.size").alias("best_size"))
    placed = placed.join(best, F.col("pattern") == F.col("p"), "left")
    flip = F.coalesce((F.col("digest") == F.col("best_digest")) & (F.col("size") == F.col("best_size")), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("more") != flip, 1).otherwise(0)).otherwise(0).cast("int")
    out = placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, a document taken twice as two equal rows, with the columns of ``docs``.

    Rows that agree in doc_id (or have none) are taken alike, as often as the mix takes any of them; documents without
    words are left out, as they can't fill a target.
    """
    d, copies, k = common.fresh(docs, "_d", "_copies", "_k")
    taken = mix(docs, **options).groupBy(F.col("doc_id").alias(d)).agg(F.max("copies").alias(copies)).filter(F.col(copies) > 0)
    repeated = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(d))).withColumn(k, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.select(*docs.columns)
