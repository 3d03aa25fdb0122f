"""Sharding on a consistent-hash ring with virtual nodes and bounded loads; DataFrame operations only.

A row's key hashes to a point of the ring; every shard owns ``nodes`` virtual
nodes, and a key belongs to the first node clockwise. A shard takes no more
than its capacity; keys beyond it go on clockwise to the next node whose shard
has room. With ``slack`` 0 the capacities are the row count dealt evenly (they
differ by one at most), so shards hold equal counts to within one row; more
slack moves fewer keys off their own node.

The walk needs only the number of keys at each node, so the counts (one row for
a virtual node, whatever the input) are planned on the driver and rows learn
their place from their rank at their node. ``slot`` numbers a shard's rows from
0 without a gap.

Defined results: a null text has no bytes; rows with a null id are
placed by their text, equal ones of them over many places; repeated rows are placed each, one after another; an empty table
gives an empty result; further columns stay as they are and play no part.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluvio.llm.common import need, table, write_table

#: Points of the ring; node positions and keys are spread over them.
POINTS = 1 << 62
#: Places over which equal rows without an id are dealt.
SPREAD = 4096


def node_ring(spark: SparkSession, shards: int, nodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, in ring order; positions depend on shard and node number only."""
    ring = spark.range(shards * nodes).select(
        F.shiftrightunsigned(F.xxhash64(F.lit("node"), F.expr(f"id div {nodes}"), F.expr(f"id % {nodes}")), 2).alias("at"), F.expr(f"id div {nodes}").alias("shard"))
    return sorted((r.at, r.shard) for r in ring.collect())  # shards * nodes rows


def capacities(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """The most rows that each shard takes: an even deal, times 1 + ``slack``."""
    even = [rows // shards + (s < rows % shards) for s in range(shards)]
    return even if slack == 0 else [int(-(-rows * (1 + slack) // shards))] * shards


def walk(loads: list[int], owners: list[int], capacity: list[int]) -> list[list[tuple[int, int, int, int]]]:
    """For each node its pieces (first rank, end rank, shard, first slot).

    First every node, in ring order, gives its shard what the shard has room
    for; then the rest of each node goes on clockwise.
    """
    room, used = list(capacity), [0] * len(capacity)
    pieces: list[list[tuple[int, int, int, int]]] = [[] for _ in loads]

    def place(node: int, start: int, shard: int) -> int:
        n = min(loads[node] - start, room[shard])
        if n > 0:
            pieces[node].append((start, start + n, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return start + max(n, 0)

    placed = [place(node, 0, owner) for node, owner in enumerate(owners)]
    open_ = [node for node, owner in enumerate(owners) if room[owner] > 0]
    for node, start in enumerate(placed):
        while start < loads[node]:
            i = bisect_left(open_, node) % len(open_)
            if room[owners[open_[i]]] == 0:
                open_.pop(i)
                continue
            start = place(node, start, owners[open_[i]])
    return pieces


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of the plan (its size is bounded by the ring) as a relation of literals."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{_colons(schema)}>>")))


def _colons(schema: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (c.split(" ", 1) for c in schema.split(", ")))


def on_ring(docs: DataFrame, key: Column, tie: list[Column], shards: int, nodes: int = 128, slack: float = 0.0) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; ``tie`` orders rows of one ring point."""
    spark = docs.sparkSession
    ring = node_ring(spark, shards, nodes)
    # The node of a point: the ring is cut into equal arcs, each knowing the few nodes inside it.
    arcs = 1 << max(1, (shards * nodes - 1).bit_length())
    width = POINTS // arcs
    positions = [at for at, _ in ring]
    inside = [(bisect_left(positions, a * width), bisect_left(positions, (a + 1) * width)) for a in range(arcs)]
    plan = _rows(spark, [{"arc": a, "first": lo, "inside": positions[lo:hi]} for a, (lo, hi) in enumerate(inside)],
                 "arc int, first int, inside array<bigint>")
    point = F.shiftrightunsigned(key, 2)
    rows = docs.withColumn("__at", point).withColumn("__arc", F.expr(f"cast(__at div {width} as int)"))
    rows = rows.join(F.broadcast(plan), rows["__arc"] == plan.arc).withColumn(
        "__node", ((F.col("first") + F.size(F.filter("inside", lambda p: p < F.col("__at")))) % len(ring)).cast("int")).drop("arc", "first", "inside", "__arc")
    loads = [0] * len(ring)
    for r in rows.groupBy("__node").count().collect():  # shards * nodes rows at most
        loads[r["__node"]] = r["count"]
    pieces = walk(loads, [s for _, s in ring], capacities(sum(loads), shards, slack))
    names = ("start", "end", "shard", "slot")
    placed = _rows(spark, [{"node": node, "parts": [dict(zip(names, p)) for p in parts]} for node, parts in enumerate(pieces) if parts],
                   "node int, parts array<struct<start:bigint,end:bigint,shard:int,slot:bigint>>")
    rank = F.row_number().over(Window.partitionBy("__node").orderBy("__at", *tie)) - 1
    rows = rows.withColumn("__rank", rank).join(F.broadcast(placed), F.col("__node") == F.col("node"))
    part = F.filter("parts", lambda p: (p["start"] <= F.col("__rank")) & (F.col("__rank") < p["end"]))[0]
    return rows.withColumn("__part", part).select(
        *docs.columns, F.col("__part.shard").alias("shard"), (F.col("__part.slot") + F.col("__rank") - F.col("__part.start")).alias("slot"))


def sharded(docs: DataFrame, shards: int = 40, nodes: int = 128, slack: float = 0.0) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``, one row for a row of ``docs``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = need(docs, doc_id="doc_id", text="text").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # Rows without an id may be many and alike: they are counted, and numbered anew, so that they are dealt over many places.
    alike = rows.where("doc_id IS NULL").groupBy("doc_id", "size", "text_crc32").count()
    many = alike.select("*", F.explode(F.expr(f"sequence(0L, (count - 1) DIV {SPREAD})")).alias("part")).repartition("size", "text_crc32", "part")
    anew = many.select("doc_id", "size", "text_crc32", F.explode(F.expr(f"sequence(0L, least({SPREAD}, count - part * {SPREAD}) - 1)")).alias("spread"))
    rows = write_table(rows.where("doc_id IS NOT NULL").withColumn("spread", F.lit(None).cast("long")).union(anew), "shard-rows")
    key = F.xxhash64(F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32", "size", "spread")).otherwise(F.xxhash64("doc_id")))
    out = on_ring(rows, key, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards, nodes, slack)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_hash_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))
