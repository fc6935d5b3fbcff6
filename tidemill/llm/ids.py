"""Identifiers of any type for operators that work on whole numbers."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.order import number

_NUMBER = "number of the id"


def any_id(*columns: str) -> Callable:
    """The operator also for ids that aren't whole numbers.

    Such ids are numbered in their order, one number each, so that the smallest
    id has the smallest number; a null stays null. ``columns`` of the result,
    and the one named like the ids', get ids instead of numbers again.
    """

    def of(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        shape = inspect.signature(operator)

        @wraps(operator)
        def run(*args, **options) -> DataFrame:
            given = shape.bind(*args, **options)
            given.apply_defaults()
            docs, id_col = given.arguments["docs"], given.arguments["id_col"]
            if isinstance(docs.schema[id_col].dataType, T.IntegralType):
                return operator(*args, **options)
            own = F.col(f"`{id_col}`")
            ids = number(docs.select(own.alias("own id")).where(F.col("own id").isNotNull()).distinct(), [F.col("own id")], _NUMBER).select("own id", _NUMBER)
            given.arguments["docs"] = docs.join(ids, own == F.col("own id"), "left").drop("own id").withColumn(id_col, F.col(_NUMBER)).drop(_NUMBER)
            out = operator(*given.args, **given.kwargs)
            for c in (id_col, *columns):
                named = ids.select(F.col(_NUMBER).alias(c), F.col("own id").alias("named"))
                out = out.join(named, c, "left").select(*(F.col("named").alias(c) if x == c else F.col(f"`{x}`") for x in out.columns))
            return out

        return run

    return of
