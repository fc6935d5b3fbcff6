"""Survey weights: null handling, a weight for each level of each variable, weighted columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from numbers import Real

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.order import clean


def _value_columns(df: DataFrame, wanted) -> list[str]:
    if callable(wanted):
        wanted = wanted(df)
    if wanted is None:
        wanted = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    wanted = [wanted] if isinstance(wanted, str) else list(wanted)
    kinds = {f.name: f.dataType for f in df.schema}
    for c in wanted:
        if c not in kinds:
            raise ValueError(f"no column {c!r}")
        if not isinstance(kinds[c], (T.NumericType, T.BooleanType)):
            raise TypeError(f"column {c!r} isn't numeric")
    return wanted


def _names(columns: list[str], given, suffix: str) -> list[str]:
    if given is None:
        return [c + suffix for c in columns]
    if callable(given):
        return [given(c) for c in columns]
    if isinstance(given, Mapping):
        return [given.get(c, c + suffix) for c in columns]
    given = [given] if isinstance(given, str) else list(given)
    if len(given) != len(columns):
        raise ValueError("new_column_names must have a name for each weighted column")
    return given


def _checked(weights: Mapping, df: DataFrame) -> dict[str, dict]:
    if not isinstance(weights, Mapping):
        raise TypeError("weights must be a mapping of variables to mappings")
    for var, levels in weights.items():
        if var not in df.columns:
            raise ValueError(f"no column {var!r}")
        if not isinstance(levels, Mapping):
            raise TypeError(f"weights of {var!r} must be a mapping")
        if any(isinstance(w, bool) or not isinstance(w, Real) for w in levels.values()):
            raise TypeError(f"weights of {var!r} must be numbers")
    return {k: dict(v) for k, v in weights.items()}


def _check_levels(df: DataFrame, weights: dict[str, dict]) -> None:
    """One job for all variables: is there a level without a weight? The first twenty of them, by name, are an error."""
    if not weights:
        return
    cells = F.array(*(F.struct(F.lit(var).alias("var"), clean(df, var).cast("string").alias("level")) for var in weights))
    seen = df.select(F.explode(cells).alias("cell")).select("cell.*").where("level IS NOT NULL").distinct()
    kinds = {var: df.schema[var].dataType for var in weights}
    known = [df.sparkSession.range(1).select(F.lit(var).alias("var"), F.explode(F.array(*(F.lit(x).cast(kinds[var]).cast("string") for x in levels))).alias("level")) for var, levels in weights.items() if levels]
    missing = seen.join(F.broadcast(reduce(DataFrame.unionByName, known)), ["var", "level"], "left_anti") if known else seen
    if found := missing.orderBy("var", "level").limit(20).collect():
        raise ValueError("levels without a weight: " + ", ".join(f"{r['level']!r} of {r['var']!r}" for r in found))


def _most_frequent(df: DataFrame, column: str):
    """Of equals the least; counts are added up before they meet."""
    counts = df.select(clean(df, column).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    found = counts.orderBy(F.desc("n"), "value").limit(1).collect()
    return found[0]["value"] if found else None


def fill_nulls(df: DataFrame, columns: Sequence[str], values: Mapping | None = None) -> DataFrame:
    """Nulls and NaN by the given value, or a number column's mean, or the most frequent value, of equals the least.

    Only columns that have nulls are looked into; others keep their type.
    """
    values, kinds = dict(values or {}), {f.name: f.dataType for f in df.schema}
    open_ = [c for c in dict.fromkeys(columns) if c not in values]
    number = {c for c in open_ if isinstance(kinds[c], T.NumericType)}
    if open_:
        found = df.agg(*(F.count_if(clean(df, c).isNull()).alias(f"n{k}") for k, c in enumerate(open_)), *(F.avg(clean(df, c)).alias(f"v{k}") for k, c in enumerate(open_) if c in number)).first()
        values |= {c: None if not found[f"n{k}"] else found[f"v{k}"] if c in number else _most_frequent(df, c) for k, c in enumerate(open_)}

    def filled(c: str) -> Column:
        if c not in columns or values.get(c) is None:
            return F.col(f"`{c}`")
        column = clean(df, c)
        return F.coalesce(column.cast("double") if c in number else column, F.lit(values[c])).alias(c)

    return df.select(*(filled(c) for c in df.columns))


def apply_weights(
    df: DataFrame, weights: Mapping[str, Mapping], *, columns_to_weight: str | Sequence[str] | Callable | None = None, weight_columns: str | Sequence[str] | None = None, new_column_names=None, handle_na: str = "ignore",
    fill_values: Mapping | None = None, na_subset: Sequence[str] | None = None, default_weight: float = 1.0, require_all_levels: bool = True, value_suffix: str = "_weighted", weight_suffix: str = "_weight",
    verbose: bool = False, verbose_mode: str = "per_column", total_weight_col: str | None = None,
) -> DataFrame:
    """Columns times the product of their row's weights.

    ``handle_na``: ``drop`` rows with a null (in ``na_subset`` or anywhere),
    ``fill`` them, or ``ignore`` them. A level that is null or has no weight
    weighs ``default_weight``; with ``require_all_levels`` a level without a
    weight is a ValueError. New columns follow the old: the total weight, the
    weights by variable, then each value, with ``per_column`` weights before
    it. Products always read the columns as they came in.
    """
    if not isinstance(df, DataFrame):
        raise TypeError("df must be a DataFrame")
    table = _checked(weights, df)
    used = [weight_columns] if isinstance(weight_columns, str) else list(weight_columns or table)
    if unknown := [v for v in used if v not in table]:
        raise ValueError(f"no weights for {unknown}")
    if handle_na not in ("drop", "fill", "ignore"):
        raise ValueError("handle_na is drop, fill or ignore")
    if verbose_mode not in ("per_column", "per_variable"):
        raise ValueError("verbose_mode is per_column or per_variable")
    columns = _value_columns(df, columns_to_weight)
    names = _names(columns, new_column_names, value_suffix)
    if require_all_levels:
        _check_levels(df, table)
    if handle_na == "drop":
        df = df.dropna(how="any", subset=list(na_subset) if na_subset else None)
    elif handle_na == "fill":
        df = fill_nulls(df, list(na_subset) if na_subset else df.columns, fill_values)
        if require_all_levels:
            _check_levels(df, {v: table[v] for v in used})

    def weight(var: str) -> Column:
        known = {k: float(w) for k, w in table[var].items() if w == w}
        found = F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), clean(df, var).cast(T._infer_type(next(iter(known))))) if known else F.lit(None)
        return F.coalesce(found, F.lit(float(default_weight)))

    each = {v: weight(v) for v in used}
    total = reduce(lambda a, b: a * b, each.values(), F.lit(1.0))
    new: list[Column] = [total.alias(total_weight_col)] if total_weight_col else []
    if verbose and verbose_mode == "per_variable":
        new += [w.alias(v + weight_suffix) for v, w in each.items()]
    for c, name in zip(columns, names, strict=True):
        if verbose and verbose_mode == "per_column":
            new += [w.alias(f"{c}_{v}{weight_suffix}") for v, w in each.items()]
        new.append((F.col(f"`{c}`").cast("double") * total).alias(name))
    shadowed = set(names)
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in shadowed), *new)
