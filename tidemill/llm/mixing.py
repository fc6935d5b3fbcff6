"""Mixing sources to target weights by pivotal dependent rounding.

A source's target gives each of its documents the same expected number of
copies: a whole part, and a fraction that is rounded. Two fractions duel: words
are moved at random from one document to the other until one of them has a
whole number of copies, so that the words taken in expectation, and the sum of
both, stay the same. What is left of a duel meets the next document. Blocks of
a source's documents do this side by side; the one fraction that is left of
each goes on to the next level, up a tree with BLOCK branches. A source's taken
words differ from its target by less than the size of one document.

All of it is DataFrame expressions; a duel is a step of ``aggregate`` over a
block's array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.ids import any_id
from tidemill.staging import stage

#: Fractions in a block, on average.
BLOCK = 96
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0

_UNIT = "struct<key:bigint,id:bigint,row:bigint,size:bigint,whole:bigint,p:double>"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes(source, size)`` to one row a source: rank, source, source_size, weight, target.

    Sources are numbered by code point, null last, and weigh ``weights`` over
    and over. Targets share ``share`` times all sizes by weight; none exceeds
    ``most`` times its source's size, and the excess is shared by weight among
    the others. Sources sorted by cap / weight, the level at which the rest is
    shared rises until the first that isn't capped and falls after it.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")
    own = own.withColumn("rank", rank).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    own = own.withColumn("cap", F.lit(most) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    own = own.withColumn("level", level).withColumn("best", F.max("level").over(everything))
    return own.select("rank", "source", "source_size", "weight", F.least("cap", F.col("best") * F.col("weight")).alias("target"))


def _duel(state: Column, x: Column, seed: int) -> Column:
    """The next unit meets what is left; one of them gets a whole number of copies."""
    a = state["left"]
    gain = F.least((1 - a["p"]) * a["size"], x["p"] * x["size"])
    loss = F.least(a["p"] * a["size"], (1 - x["p"]) * x["size"])
    chance = (F.pmod(F.xxhash64(F.lit(seed), a["key"], x["key"]), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    up = chance * (gain + loss) < loss
    unit = lambda u, p: F.struct(u["key"].alias("key"), u["id"].alias("id"), u["row"].alias("row"), u["size"].alias("size"), u["whole"].alias("whole"), p.alias("p"))
    one, zero = F.lit(1.0), F.lit(0.0)
    # Which of the two is settled, at what, and what remains of the other.
    a_full, a_empty = up & (gain >= (1 - a["p"]) * a["size"]), ~up & (loss >= a["p"] * a["size"])
    settled = F.when(a_full, unit(a, one)).when(a_empty, unit(a, zero)).when(up, unit(x, zero)).otherwise(unit(x, one))
    bounded = lambda p: F.greatest(zero, F.least(one, p))
    rest = F.when(a_full, unit(x, bounded(x["p"] - gain / x["size"]))).when(a_empty, unit(x, bounded(x["p"] + loss / x["size"])))
    rest = rest.when(up, unit(a, bounded(a["p"] + gain / a["size"]))).otherwise(unit(a, bounded(a["p"] - loss / a["size"])))
    return F.struct(F.concat(state["done"], F.array(settled)).alias("done"), rest.alias("left"))


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    """``key``: a hash of the id, or of the row where the id is null or repeated, so that no key has many rows."""
    repeated = stage(rows.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("again")), "repeated")
    if repeated.isEmpty():
        rows = rows.withColumn("again", F.lit(False))
    else:
        rows = rows.join(repeated, "id", "left")
    alone = F.col("id").isNotNull() & ~F.coalesce("again", F.lit(False))
    return rows.withColumn("key", F.when(alone, F.xxhash64(F.lit(seed), "id")).otherwise(F.xxhash64(F.lit(seed), F.lit("row"), "row"))).drop("again")


@any_id()
def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, copies, taken.

    ``size`` is the number of runs without ASCII white space, 0 for null. A
    document is taken a whole number of times, the floor or the ceiling of its
    source's target / source_size, so never more than ``most`` times if that is
    whole. ``taken`` is copies * size; documents of no words have no copies.
    A null source is a source. Reruns agree, whatever the layout of files, where
    ids are known and differ; rows with a null or repeated id are told apart by
    their row, so that reruns agree on the same files, and one id may have any
    number of rows. An empty table gives an
    empty result. Other columns aren't looked at.
    """
    rows = stage(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")), "sizes"
    )
    targets = stage(source_targets(rows, weights, share, most), "targets")
    counts = rows.where("size > 0").groupBy("source").agg(F.count("*").alias("units")).withColumnRenamed("source", "own")
    known = stage(targets.join(counts, F.col("source").eqNullSafe(F.col("own")), "left").drop("own"), "sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = known.select("rank", F.col("source").alias("own"), "source_size", "target", F.coalesce("units", F.lit(0)).alias("units"), F.floor(rate + 1e-12).alias("whole"), F.greatest(F.lit(0.0), rate - F.floor(rate + 1e-12)).alias("p"))
    named = _keyed(rows, seed).join(known, F.col("source").eqNullSafe(F.col("own"))).drop("own", "source")
    rounded = (F.col("size") > 0) & (F.col("p") > 0)
    units = named.where(rounded).select("rank", F.pmod("key", F.ceil(F.col("units") / BLOCK)).alias("block"), F.struct("key", "id", "row", "size", "whole", "p").cast(_UNIT).alias("unit"))
    decided = [named.where(~rounded).select("rank", "id", "row", "size", F.when(F.col("size") > 0, F.col("whole")).otherwise(0).cast("long").alias("copies"))]
    blocks = -(-(known.agg(F.max("units")).first()[0] or 0) // BLOCK)
    while True:
        array = F.array_sort(F.transform(F.collect_list("unit"), lambda u: F.struct(u["key"].alias("order"), u.alias("unit"))))
        met = units.groupBy("rank", "block").agg(F.transform(array, lambda x: x["unit"]).alias("units"))
        start = F.struct(F.slice("units", 1, 0).alias("done"), F.element_at("units", 1).alias("left"))
        met = met.select("rank", "block", F.aggregate(F.slice("units", 2, F.greatest(F.size("units") - 1, F.lit(0))), start, lambda s, x: _duel(s, x, seed)).alias("state"))
        met = stage(met, "duels")
        done = met.select("rank", F.explode("state.done").alias("unit"))
        decided.append(done.select("rank", "unit.id", "unit.row", "unit.size", (F.col("unit.whole") + F.col("unit.p").cast("long")).alias("copies")))
        if blocks <= 1:
            break
        blocks = -(-blocks // BLOCK)
        units = met.select("rank", F.floor(F.col("block") / BLOCK).alias("block"), F.col("state.left").alias("unit"))
    # One fraction is left of a source, and rounded to the nearer side.
    last = F.col("unit.whole") + F.when(F.col("unit.p") >= 0.5, 1).otherwise(0)
    decided.append(met.select("rank", F.col("state.left").alias("unit")).select("rank", "unit.id", "unit.row", "unit.size", last.cast("long").alias("copies")))
    every = decided[0]
    for d in decided[1:]:
        every = every.unionByName(d)
    out = every.join(known.select("rank", "source_size", "target"), "rank")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")
