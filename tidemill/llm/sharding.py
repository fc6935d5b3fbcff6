"""Shards of near equal bytes by Karmarkar-Karp differencing.

Documents of equal text are one group that isn't divided. Groups are dealt
into blocks; in each block the differencing method runs on its groups: the two
partial partitions with the largest spread are combined, the largest part of
one with the smallest of the other, until one is left. Blocks are combined the
same way, BLOCK_FAN at a time, in a tree. What a task holds is a block of
groups or BLOCK_FAN lists of sums.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.ids import any_id
from tidemill.staging import parallelism, stage

#: Groups in a block, on average.
BLOCK_GROUPS = 2048
#: Blocks that are combined in a task.
BLOCK_FAN = 256


def difference(parts: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """Combine partial partitions, each a list of k sums.

    Returns for each of them where its parts go, an array (len(parts), k), and
    the k sums. Deterministic: of equal spreads, what came first goes first.
    """
    k = len(parts[0])
    heap = [(min(p) - max(p), i) for i, p in enumerate(parts)]
    heapq.heapify(heap)
    nodes, merges = list(parts), []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = nodes[a], nodes[b]
        down, up = sorted(range(k), key=x.__getitem__, reverse=True), sorted(range(k), key=y.__getitem__)
        total = [x[i] + y[j] for i, j in zip(down, up, strict=True)]
        merges.append((a, down, b, up))
        nodes[a] = nodes[b] = None
        heapq.heappush(heap, (min(total) - max(total), len(nodes)))
        nodes.append(total)
    goes = [None] * len(nodes)
    goes[heap[0][1]] = list(range(k))
    for at in range(len(merges) - 1, -1, -1):
        a, down, b, up = merges[at]
        own = goes[len(parts) + at]
        for child, order in ((a, down), (b, up)):
            to = [0] * k
            for place, part in zip(own, order, strict=True):
                to[part] = place
            goes[child] = to
        goes[len(parts) + at] = None
    return np.array(goes[: len(parts)], np.int32), nodes[heap[0][1]]


def _block(shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h1", "h2", "size", "unknown"], kind="stable")
        goes, sums = difference([[int(w)] + [0] * (shards - 1) for w in rows["weight"]])
        out = rows[["block", "h1", "h2", "size", "unknown"]].assign(part=goes[:, 0], sums=None)
        whole = pd.DataFrame({"block": rows["block"].iloc[:1].to_numpy(), "h1": 0, "h2": 0, "size": 0, "unknown": False, "part": -1, "sums": [sums]})
        return pd.concat([out.astype({"part": "int32"}), whole.astype({"part": "int32"})])

    return run


def _fan(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("block")
    goes, sums = difference([list(map(int, x)) for x in rows["sums"]])
    out = pd.DataFrame({"block": rows["block"].to_numpy(), "upper": rows["upper"].to_numpy(), "goes": list(goes), "sums": None})
    whole = pd.DataFrame({"block": rows["upper"].iloc[:1].to_numpy(), "upper": -1, "goes": None, "sums": [sums]})
    return pd.concat([out, whole])


def assign_groups(groups: DataFrame, shards: int) -> DataFrame:
    """``groups(h1, h2, size, unknown, weight)`` to ``(h1, h2, size, unknown, shard)``."""
    blocks = max(1, round(groups.count() / BLOCK_GROUPS))
    dealt = groups.withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.lit(blocks)))
    own = dealt.groupBy("block").applyInPandas(_block(shards), "block long, h1 long, h2 long, size long, unknown boolean, part int, sums array<long>")
    own = stage(own, "blocks")
    placed = own.where("part >= 0").drop("sums")
    tops = own.where("part < 0").select("block", "sums")
    while blocks > 1:
        blocks = -(-blocks // BLOCK_FAN)
        level = tops.withColumn("upper", F.floor(F.col("block") / BLOCK_FAN).cast("long"))
        level = stage(level.groupBy("upper").applyInPandas(_fan, "block long, upper long, goes array<int>, sums array<long>"), "fan")
        step = level.where("upper >= 0").select("block", "upper", "goes")
        placed = placed.join(step, "block").select("h1", "h2", "size", "unknown", F.col("upper").alias("block"), F.element_at("goes", F.col("part") + 1).alias("part"))
        tops = level.where("upper < 0").select("block", "sums")
    return placed.select("h1", "h2", "size", "unknown", F.col("part").alias("shard"))


@any_id()
def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 1; a null text has size 1 and CRC 0,
    and null texts are a group apart from empty ones. Equal texts share a shard.
    Slots number the rows of a shard from 0 without gaps, in an order fixed by
    id within hashed buckets; rows with a null id or with the same id are told
    apart by their row. More shards than groups leaves shards empty. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), F.md5(text.cast("binary"))).alias("h2"), text.isNull().alias("unknown"), F.monotonically_increasing_id().alias("row"),
    )
    rows = stage(rows, "sizes")
    key = ["h1", "h2", "size", "unknown"]
    groups = rows.groupBy(*key).agg(F.sum("size").alias("weight"))
    placed = rows.join(assign_groups(groups, shards), key)
    buckets = parallelism(spark)
    placed = stage(placed.select("id", "size", "crc", "row", "shard", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int").alias("bucket")), "placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("id", "row")
    return placed.join(offsets, ["shard", "bucket"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("base") + F.row_number().over(inside) - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
