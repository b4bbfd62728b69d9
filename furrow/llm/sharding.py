"""Sharding by balanced label propagation (operator 5).

Documents are nodes and a shared link key (by default the digest of the text) ties them together; a key with n members
stands for all pairs of them and is never written out as pairs. Labels are shards; nodes start at a hash of their id,
those of a key too large for one shard on as few shards as can hold it. Each round

* every key counts its members by shard (summed before the shuffle, at most one row for each key, shard and task),
* every document looks up the shard that holds most of its keys' members and asks to move there,
* each pair of shards has a quota: as many moves as the target has room for, counting the moves that leave it in the same
  round, so that full shards exchange documents; moves are admitted by gain, then by a hash of the key.

Ties go by a hash of the key, the shard and the round: members of a key agree, and asks between two shards go both ways.
A shard may hold half more than its capacity while labels move; the last step parts what is beyond it between keys.

A last step makes the law exact: ``rows``, where shard sizes differ by one document at most. Within a shard, linked
documents come first, key by key; what lies beyond the shard's capacity takes the free places of the other shards in
order, so it is first of all documents without links that move. A document's place is its slot.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SALTS = 256


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1)


def _flows(asked: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many of the ``asked`` moves (from, to) each pair of shards admits: what comes in is at most ``room`` and what goes out."""
    flow = asked.astype(np.int64)
    while True:
        comes, may = flow.sum(axis=0), np.maximum(0, room + flow.sum(axis=1))
        over = comes > may
        if not over.any():
            return flow
        flow[:, over] = flow[:, over] * may[over] // comes[over]


def _admitted(asks: DataFrame, flow: np.ndarray) -> DataFrame:
    """The last rank that each pair of shards admits: (ok_from, ok_to, ok_rank), where the running count is within the pair's flow."""
    quota = [(int(s), int(t), int(flow[s, t])) for s, t in zip(*np.nonzero(flow), strict=True)]
    pairs = asks.sparkSession.createDataFrame(quota, "ok_from int, ok_to int, quota long")
    counts = asks.groupBy("shard", "ask_to", "rank").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("shard", "ask_to").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    within = counts.withColumn("upto", upto).join(F.broadcast(pairs), (F.col("shard") == F.col("ok_from")) & (F.col("ask_to") == F.col("ok_to"))).filter(F.col("upto") <= F.col("quota"))
    return within.groupBy("ok_from", "ok_to").agg(F.max("rank").alias("ok_rank"))


def propagate(nodes: DataFrame, links: DataFrame, shards: int, capacity: list[int], rounds: int = 3, bins: int = 1024) -> DataFrame:
    """Labels after ``rounds`` rounds, and more while the cut falls by a thousandth: (node, shard) of the nodes that have links.

    ``nodes``: node (unique, long or string). ``links``: (node, key), where nodes of one key are linked; a node may have
    several keys. Keys with one member tie nothing. The cut is the number of nodes that ask to move; at none, rounds end.
    """
    members = links.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("key", "k")
    tied = links.join(members, F.col("key") == F.col("k")).drop("k")
    # what is moved together: documents of a key that fits into a shard ask as one, larger keys document by document
    whole = F.col("n") <= F.lit(max(1, min(capacity) // 8))
    ask_bin = F.pmod(F.when(whole, F.xxhash64("key", F.lit(3))).otherwise(F.xxhash64("node", F.lit(3))), F.lit(bins)).cast("int")
    # a key that no shard can hold starts on as few shards as can
    parts = F.ceil(F.col("n") / F.lit(max(1, min(capacity))))
    few = F.pmod(F.xxhash64("key", F.lit(7)) + F.pmod(F.xxhash64("node", F.lit(7)), parts), F.lit(shards))
    start = F.when(whole, F.pmod(F.xxhash64("node"), F.lit(shards))).otherwise(few).cast("int")
    begun = tied.groupBy("node").agg(F.max_by(start, F.struct("n", "key")).alias("shard")).withColumnRenamed("node", "m")
    state = common.materialise(tied.select("node", "key", ask_bin.alias("ask_bin")).join(begun, F.col("node") == F.col("m")).drop("m"), "lp-0")
    slack = max(1, min(capacity) // 2)
    before = None
    for k in count():
        load = {r["shard"]: r["c"] for r in state.groupBy("shard").agg(F.countDistinct("node").alias("c")).collect()}
        room = np.array([capacity[s] + slack - load.get(s, 0) for s in range(shards)])
        votes = state.groupBy("key", "shard").agg(F.count(F.lit(1)).alias("c"))
        lists = votes.groupBy("key").agg(F.collect_list(F.struct(F.col("shard").alias("to"), "c")).alias("votes")).withColumnRenamed("key", "k")
        # at most one entry for each shard in a list
        wishes = state.join(lists, F.col("key") == F.col("k")).select("node", "key", "ask_bin", "shard", F.explode("votes").alias("v"))
        sums = wishes.groupBy("node", "shard", "v.to").agg(F.sum(F.col("v.c")).alias("c"), F.min("ask_bin").alias("ask_bin"), F.min("key").alias("key"))
        stay = F.max(F.when(F.col("to") == F.col("shard"), F.col("c")))
        best = sums.groupBy("node", "shard").agg(F.max_by(F.struct("to", "ask_bin", "c"), F.struct(F.col("c"), F.xxhash64("key", "to", F.lit(k)), F.col("to"))).alias("b"), stay.alias("stay"))
        # gains beyond 15 rank alike
        rank = ((15 - F.least(F.lit(15), F.col("b.c") - F.col("stay"))) * bins + F.col("b.ask_bin")).cast("int")
        asks = common.materialise(best.select("node", "shard", F.col("b.to").alias("ask_to"), rank.alias("rank")), f"lp-asks-{k}")
        moves = asks.filter("ask_to != shard")
        asked = np.zeros((shards, shards), np.int64)
        for r in moves.groupBy("shard", "ask_to").agg(F.count(F.lit(1)).alias("c")).collect():
            asked[r["shard"], r["ask_to"]] = r["c"]
        cut = int(asked.sum())
        if not cut or (k >= rounds and cut > 0.999 * before):
            break
        before = cut
        ok = _admitted(moves, _flows(asked, room))
        admitted = (F.col("shard") == F.col("ok_from")) & (F.col("ask_to") == F.col("ok_to")) & (F.col("rank") <= F.col("ok_rank"))
        moved = asks.join(F.broadcast(ok), admitted, "left")
        moved = moved.select(F.col("node").alias("m"), F.when(F.col("ok_to").isNotNull(), F.col("ask_to")).otherwise(F.col("shard")).alias("to"))
        state = common.materialise(state.join(moved, F.col("node") == F.col("m")).select("node", "key", "ask_bin", F.col("to").alias("shard")), f"lp-{k + 1}")
    return state.groupBy("node").agg(F.min("shard").alias("shard"), F.min("key").alias("key"))


def shard_documents(docs: DataFrame, shards: int = 24, rounds: int = 3) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    Size is the text's bytes plus 8 (null: 8) and ``text_crc32`` the text's unsigned CRC-32 (null: that of nothing, 0).
    Documents with equal texts are linked; null texts link nothing. The law is ``rows``: counts differ by one at most,
    and ``grown_shard`` is null. Rows with equal doc_id are different documents. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.when(F.col("text").isNotNull(), F.md5("text")).alias("key"))
    # rows that agree in doc_id are told apart by a number, so that every row is a node
    order = Window.partitionBy("doc_id").orderBy("key")
    narrow = common.materialise(narrow.withColumn("again", F.row_number().over(order) - 1), "shard-docs")
    node = F.when(F.col("again") == 0, F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).otherwise(F.concat_ws("#", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "again"))
    nodes = narrow.withColumn("node", node)
    total = narrow.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    labels = propagate(nodes, nodes.filter("key is not null").select("node", "key"), shards, capacity, rounds).select(F.col("node").alias("n"), F.col("shard").alias("lp"))
    free = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")
    placed = nodes.join(labels, F.col("node") == F.col("n"), "left")
    linked = F.col("lp").isNotNull()
    half = SALTS // 2
    salt = F.when(linked, F.pmod(F.xxhash64("key"), F.lit(half))).otherwise(half + F.pmod(F.xxhash64("node", F.lit(5)), F.lit(half))).cast("int")
    # keys with very many members are numbered in pieces of their own
    sub = F.pmod(F.xxhash64("node", F.lit(9)), F.lit(64)).cast("int")
    placed = placed.select("doc_id", "size", "text_crc32", "node", "key", F.coalesce("lp", free).alias("want"), salt.alias("salt"), sub.alias("sub"))
    many = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 4096).select(F.col("key").alias("big"))
    placed = placed.join(many, F.col("key") == F.col("big"), "left").withColumn("piece", F.col("salt") * 64 + F.when(F.col("big").isNotNull(), F.col("sub")).otherwise(0)).drop("big", "sub", "salt")
    numbered = common.materialise(common.with_position(placed, ["want"], [F.col("key"), F.col("node")], F.col("piece"), "place").drop("key", "node", "piece"), "shard-places")

    held = {r["want"]: r["c"] for r in numbered.groupBy("want").agg(F.count(F.lit(1)).alias("c")).collect()}
    load = [held.get(s, 0) for s in range(shards)]
    over = [max(0, n - c) for n, c in zip(load, capacity, strict=True)]
    room = [max(0, c - n) for n, c in zip(load, capacity, strict=True)]
    over_before = [sum(over[:s]) for s in range(shards)]
    room_before = [sum(room[:s]) for s in range(shards)]
    beyond = F.col("place") >= _pick(capacity, F.col("want"))
    index = _pick(over_before, F.col("want")) + F.col("place") - _pick(capacity, F.col("want"))
    # the shard whose range of free places holds the index: the last one that begins at or before it and has any
    goal = reduce(lambda made, s: F.when(index >= room_before[s], F.lit(s)).otherwise(made) if room[s] else made, range(shards), F.lit(0))
    out = numbered.withColumn("_index", F.when(beyond, index)).withColumn("shard", F.when(beyond, goal).otherwise(F.col("want")).cast("int"))
    slot = F.when(F.col("_index").isNotNull(), _pick(load, F.col("shard")) + F.col("_index") - _pick(room_before, F.col("shard"))).otherwise(F.col("place"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
