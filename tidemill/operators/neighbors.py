"""Exact nearest neighbours by cosine, and local outlier factors.

Up to BLOCK queries go to the partitions of the index; each gives its own k best
from a matrix product, and the best of those are taken by a window. More queries,
such as all items of the index, are a table of blocks of stacked vectors, and so
is the index: each block of one meets each of the other in a matrix product in
some task. Nothing passes through the driver and no pair of vectors is
materialised; the work is that of all products, as it must be for exact answers,
and each block is sent once for each block of the other side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemill.staging import setting, stage

#: Queries that go out as one, and vectors in a block on average.
BLOCK = 4096


def _unit(rows: pd.Series) -> np.ndarray:
    """Rows of length 1; a zero vector stays zero, so that it is like nothing."""
    x = np.stack([np.asarray(v, np.float64) for v in rows]) if len(rows) else np.zeros((0, 1))
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _top(names: np.ndarray, vectors: np.ndarray, items: np.ndarray, others: np.ndarray, k: int, other: bool) -> pd.DataFrame:
    """The k best of these items for each query, of equals the least item."""
    like = vectors @ others.T
    if other:
        like[names[:, None] == items[None, :]] = -np.inf
    rank = np.argsort(np.argsort(items.astype(str) if items.dtype == object else items, kind="stable"))
    order = np.lexsort((np.broadcast_to(rank, like.shape), -like), axis=1)[:, :k]
    sim = np.take_along_axis(like, order, 1)
    out = pd.DataFrame({"query": np.repeat(names, order.shape[1]), "item": items[order].ravel(), "sim": sim.ravel()})
    return out[out["sim"] > -np.inf]


def _best(queries, k: int, other: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, vectors = queries.value
        for rows in batches:
            if len(rows):
                yield _top(names, vectors, rows["item"].to_numpy(), _unit(rows["embedding"]), k, other)

    return run


def _stacked(rows: pd.DataFrame) -> pd.DataFrame:
    x = _unit(rows["embedding"])
    return pd.DataFrame({"block": rows["block"].iloc[:1].to_numpy(), "names": [rows["name"].tolist()], "width": [x.shape[1]], "body": [x.tobytes()]})


def _blocks(df: DataFrame, name: str, n: int) -> DataFrame:
    """``(block, names, width, body)``: unit vectors stacked."""
    held = df.select(F.col(name).alias("name"), "embedding", F.pmod(F.xxhash64(name), F.lit(-(-n // BLOCK))).alias("block"))
    kind = df.schema[name].dataType.simpleString()
    return stage(held.groupBy("block").applyInPandas(_stacked, f"block long, names array<{kind}>, width long, body binary"), "blocks")


def _meet(k: int, other: bool, name_kind: pa.DataType, item_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c: batch.column(c)[i]  # noqa: B023, E731
                matrix = lambda s: np.frombuffer(cell(f"{s}body").as_buffer(), np.float64).reshape(-1, cell(f"{s}width").as_py())  # noqa: B023, E731
                names, items = (cell(c).values.to_numpy(zero_copy_only=False) for c in ("qnames", "names"))
                for at in range(0, len(names), 512):
                    out = _top(names[at : at + 512], matrix("q")[at : at + 512], items, matrix(""), k, other)
                    yield pa.RecordBatch.from_arrays([pa.array(out["query"], name_kind), pa.array(out["item"], item_kind), pa.array(out["sim"], pa.float64())], ["query", "item", "sim"])

    return run


def nearest(index: DataFrame, queries: DataFrame, k: int, other: bool = False) -> DataFrame:
    """``(query, item, sim, rank)``: the k most similar items of ``index(item, embedding)``; ties by item.

    ``queries(query, embedding)``; with ``other`` an item isn't its own neighbour. Null vectors take no part.
    """
    spark, kinds = index.sparkSession, [queries.schema["query"].dataType, index.schema["item"].dataType]
    schema = f"query {kinds[0].simpleString()}, item {kinds[1].simpleString()}, sim double"
    asked, index = queries.where("embedding IS NOT NULL").select("query", "embedding"), index.where("embedding IS NOT NULL").select("item", "embedding")
    rows = asked.limit(BLOCK + 1).toPandas()
    if len(rows) <= BLOCK:
        sent = spark.sparkContext.broadcast((rows["query"].to_numpy(), _unit(rows["embedding"])))
        found = index.mapInPandas(_best(sent, k, other), schema) if len(rows) else spark.createDataFrame([], schema)
    else:
        own, n = _blocks(index, "item", index.count()), asked.count()
        of = _blocks(asked, "query", n).select(F.col("names").alias("qnames"), F.col("width").alias("qwidth"), F.col("body").alias("qbody"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-index.count() // BLOCK) - 1).cast("long"))).alias("block"))
        with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):
            met = own.join(of, "block").repartition("block", F.xxhash64("qbody")).mapInArrow(_meet(k, other, *map(to_arrow_type, kinds)), schema)
            found = stage(met, "met")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "item"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def similarity_floor(index: DataFrame, default: float = 0.56) -> float:
    """The 5th percentile of items' similarity to their nearest other item, between 0.45 and 0.75; with under 10 items the default."""
    if index.count() < 10:
        return default
    best = nearest(index, index.withColumnRenamed("item", "query"), 1, other=True)
    return min(0.75, max(0.45, best.agg(F.percentile("sim", 0.05)).first()[0]))


def outlier_factors(index: DataFrame, queries: DataFrame | None = None, contamination: float = 0.05) -> DataFrame | None:
    """``(query, lof, outlier)`` by Breunig et al., SIGMOD 2000, cosine distances; None for under 40 items.

    Fitted on the items of ``index``; an item is its own neighbour only when it
    is asked as a query. A query is an outlier if its factor exceeds the
    items' quantile at 1 - contamination.
    """
    n = index.count()
    if n < 40:
        return None
    k = min(min(20, max(5, n // 20)), n - 1)
    share = min(0.25, max(0.01, contamination))
    own = stage(nearest(index, index.withColumnRenamed("item", "query"), k, other=True).withColumn("d", 1 - F.col("sim")), "own")
    reach = own.groupBy("query").agg(F.max("d").alias("far")).withColumnRenamed("query", "item")

    def density(pairs: DataFrame) -> DataFrame:
        return pairs.join(reach, "item").groupBy("query").agg((1 / (F.avg(F.greatest("far", "d")) + 1e-10)).alias("density"))

    dense = stage(density(own), "density")

    def factor(pairs: DataFrame, of: DataFrame) -> DataFrame:
        around = pairs.join(dense.select(F.col("query").alias("item"), F.col("density").alias("other")), "item").groupBy("query").agg(F.avg("other").alias("around"))
        return around.join(of, "query").select("query", (F.col("around") / F.col("density")).alias("lof"))

    trained = factor(own, dense)
    bound = trained.agg(F.percentile("lof", 1 - share)).first()[0]
    if queries is None:
        scored = trained
    else:
        asked = stage(nearest(index, queries, k).withColumn("d", 1 - F.col("sim")), "asked")
        scored = factor(asked, density(asked))
    return scored.withColumn("outlier", F.col("lof") > bound)
