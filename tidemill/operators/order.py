"""Order of rows, which tables have and DataFrames don't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.staging import parallelism, stage


def clean(df: DataFrame, name: str) -> Column:
    """The column, NaN being null."""
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    return F.nanvl(column, F.lit(None).cast(kind)) if isinstance(kind, (T.FloatType, T.DoubleType)) else column


def number(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """Consecutive numbers from 0 in the order ``by``, without bringing all rows together.

    Rows are dealt out by range; what a partition adds to its own numbers is
    the count of those before it, one number a partition.
    """
    row = f"{name} in partition"
    parts = df.repartitionByRange(parallelism(df.sparkSession), *by).sortWithinPartitions(*by)
    held = stage(parts.withColumn(row, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(row, 33)
    base, offsets = 0, []
    for p, n in held.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets += [F.lit(p), F.lit(base)]
        base += n
    if not offsets:
        return held.withColumn(name, F.lit(0).cast("long")).drop(row)
    return held.withColumn(name, F.element_at(F.create_map(*offsets), part) + F.col(row).bitwiseAND((1 << 33) - 1)).drop(row)
