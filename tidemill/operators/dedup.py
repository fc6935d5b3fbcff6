"""De-duplication with a policy for which row stays, and entity resolution."""

from __future__ import annotations

import inspect
import logging
import time
from collections.abc import Callable
from functools import wraps

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators.components import connected_components
from tidemill.operators.order import clean, number
from tidemill.plans import specs
from tidemill.staging import stage

log = logging.getLogger(__name__)

ROW, GROUP, RANK = "_tm_row", "_tm_group", "_tm_rank"
# Fixed value: what parts identifiers in a cell.
SEPARATORS = r"[;,|]+"


def timed(function: Callable) -> Callable:
    """Log how long the call took; plans are lazy, so this is mostly planning."""

    @wraps(function)
    def run(*args, **kwargs):
        began = time.perf_counter()
        try:
            return function(*args, **kwargs)
        finally:
            log.debug("%s took %.3f s", function.__name__, time.perf_counter() - began)

    return run


def _tokens(column: Column, kind: T.DataType, split: bool, separators: str) -> Column:
    """Identifiers in a cell, as an array of (kind, value): numbers meet numbers, strings strings."""
    pair = lambda tag, value: F.struct(F.lit(tag).alias("tag"), value.alias("value")).cast("struct<tag:string,value:string>")
    if isinstance(kind, T.ArrayType):
        inner = F.flatten(F.transform(F.coalesce(column, F.array().cast(kind)), lambda x: _tokens(x, kind.elementType, split, separators)))
        return inner
    if isinstance(kind, T.StringType):
        parts = F.split(column, separators) if split else F.array(column)
        parts = F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda x: x != "")
        return F.transform(F.coalesce(parts, F.array().cast("array<string>")), lambda x: pair("s", x))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        value = F.when(~F.isnan(column.cast("double")), column.cast("double").cast("string"))
        return F.transform(F.filter(F.array(value), lambda x: x.isNotNull()), lambda x: pair("n", x))
    return F.transform(F.filter(F.array(column.cast("string")), lambda x: x.isNotNull()), lambda x: pair(kind.simpleString(), x))


def _linked(df: DataFrame, entities: list[str], blocks: list[str], scope: str, split: bool, separators: str) -> DataFrame:
    """(row, component): rows that share an identifier, or are joined by others that do, inside a block."""
    def keyed(name: str) -> Column:
        column = F.lit(name if scope == "per_column" else "").alias("column")
        tokens = _tokens(F.col(f"`{name}`"), df.schema[name].dataType, split, separators)
        return F.transform(tokens, lambda t: F.struct(column, t["tag"].alias("tag"), t["value"].alias("value"))).cast("array<struct<column:string,tag:string,value:string>>")

    parts = [keyed(name) for name in entities]
    key = F.struct(*(clean(df, b).cast("string").alias(f"b{k}") for k, b in enumerate(blocks)), F.col("token"))
    held = df.select(ROW, *(F.col(f"`{b}`") for b in specs.unique(blocks)), F.explode(F.concat(*parts)).alias("token")).select(ROW, F.to_json(key).alias("key"))
    least = held.groupBy("key").agg(F.min(ROW).alias("least"))
    edges = held.join(least, "key").where(F.col(ROW) != F.col("least")).select(F.col(ROW).alias("src"), F.col("least").alias("dst"))
    return connected_components(edges)





def _sort(df: DataFrame, pick: specs.Pick, order: list[Column], seed: int | None) -> list[Column]:
    down = [c.desc() for c in order]
    up = [c.asc() for c in order]
    if pick.kind == "last":
        return down
    if pick.kind == "random":
        return [F.xxhash64(F.lit(seed or 0), ROW).asc(), *up]
    if pick.kind in ("max", "min"):
        value = clean(df, pick.column)
        return [value.desc_nulls_last() if pick.kind == "max" else value.asc_nulls_last(), *up]
    return up


def _call(function: Callable, keys: int):
    """The callable takes (group) or (group, key), the group in order; rows it returns are known by their row number."""
    takes = [p for p in inspect.signature(function).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(RANK).drop(columns=RANK)
        rows = rows.set_index(rows[ROW].to_numpy())
        kept = function(rows, key if keys > 1 else key[0]) if len(takes) > 1 else function(rows)
        return pd.DataFrame({ROW: kept.index.to_numpy(dtype="int64")})

    return run


@timed
def deduplicate(
    df: DataFrame, on: specs.ColumnSpec = None, *, action: str = "remove", pick: str | Callable = "first", group_by: specs.ColumnSpec = None, entity_by: specs.ColumnSpec | bool = None,
    block_by: specs.ColumnSpec = None, mode: str = "auto", random_state: int | None = None, order_by: specs.ColumnSpec = None, flag_column: str = "is_duplicate", group_id_column: str | None = None,
    return_stats: bool = False, log_stats: bool = False, entity_scope: str = "global", split_entity_values: bool = True, entity_separators_regex: str = SEPARATORS, null_keys: str = "reference", keep_order: bool = False, **aliases,
):
    """Keep one row of each key, or flag the others; ``(df, stats)`` with ``return_stats``.

    ``on``: an exact key, or "any a b", rows being linked that share a value of
    any of these. ``group_by`` groups by equal columns, ``entity_by`` by linked
    identifiers, inside ``block_by`` and, with both, ``group_by``. ``collapse``
    keeps a row of each group, ``within`` a row of each key in each group.
    ``pick``: first, last, random, max:c, min:c (nulls last, ties to the first)
    or a callable that gets the group in order and returns rows of it. Nulls and NaN are one key.

    First and last follow ``order_by``, and the table's own order where that
    is absent or ties; name a unique column for results that don't depend on
    the layout of files. With max or min and an exact key, a row with a null
    in its key stays only if its value is null; with a callable, never; with
    ``null_keys="group"`` null keys are keys like others. ``keep_order`` sorts
    what is returned as the rows came in, by the table's own order; it costs a
    shuffle.
    """
    given = specs.fold_aliases({"on": on, "group_by": group_by, "entity_by": entity_by, "block_by": block_by, "pick": pick}, aliases)
    on, group_by, entity_by, block_by, pick = (given[k] for k in ("on", "group_by", "entity_by", "block_by", "pick"))
    if not isinstance(df, DataFrame):
        raise ValueError("df must be a DataFrame")
    columns, action, mode = df.columns, specs.one_of(action, specs.ACTIONS, "action"), specs.one_of(mode, specs.MODES, "mode")
    if entity_scope not in ("global", "per_column"):
        raise ValueError("entity_scope is global or per_column")
    if null_keys not in ("reference", "group"):
        raise ValueError("null_keys is reference or group")
    key, chosen = specs.parse_key(on, columns), specs.parse_pick(pick, columns)
    groups = specs.resolve(group_by, columns, "group_by")
    if entity_by is True or isinstance(entity_by, str) and entity_by.strip().lower() == "auto":
        entities = specs.identity_columns(df.schema)
        if not entities:
            raise ValueError("entity_by='auto' found no identifier")
    else:
        entities = specs.resolve(None if entity_by is False else entity_by, columns, "entity_by")
    blocks = specs.resolve(block_by, columns, "block_by") or []
    if key.kind == "any" and entities is None:
        entities = key.columns
    if entities is not None and groups is not None:
        blocks, groups = specs.unique([*blocks, *groups]), None
    grouped = entities is not None or groups is not None
    if mode == "auto":
        mode = "collapse" if grouped else "within"
    order_names = specs.resolve(order_by, columns, "order_by") or []

    work = df.withColumn(ROW, F.monotonically_increasing_id())
    if entities is not None or chosen.kind in ("custom", "random") or group_id_column and grouped or not order_names or keep_order:
        work = stage(work, "rows")
    order = [F.col(f"`{c}`") for c in order_names] + [F.col(ROW)]
    if entities is not None:
        found = _linked(work, entities, blocks, entity_scope, split_entity_values, entity_separators_regex).withColumnRenamed("node", ROW)
        work = work.join(found, ROW, "left").withColumn(GROUP, F.coalesce("component", ROW)).drop("component")
        group_keys: list[Column] = [F.col(GROUP)]
    else:
        group_keys = [clean(df, c) for c in groups or []]
    if group_id_column and grouped:
        work = _with_ids(work, group_keys, [clean(df, b) for b in blocks] if entities is not None else [], order)
    keys = group_keys if grouped and mode == "collapse" else [*group_keys, *(clean(df, c) for c in key.columns)]
    exact = not (grouped and mode == "collapse")

    if chosen.kind == "custom":
        rows = work
        if exact and null_keys == "reference":
            for c in key.columns:
                rows = rows.where(clean(df, c).isNotNull())
        named = rows.withColumns({f"_tm_k{k}": c for k, c in enumerate(keys)})
        names = [f"_tm_k{k}" for k in range(len(keys))]
        # A shuffle gives no order; the window's also serves the groups.
        named = named.withColumn(RANK, F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
        kept = named.groupBy(*names).applyInPandas(_call(chosen.function, len(names)), f"{ROW} long").distinct().withColumn(RANK, F.lit(1))
        ranked = work.join(kept, ROW, "left").withColumn(flag_column, F.col(RANK).isNull())
    else:
        window = Window.partitionBy(*keys).orderBy(*_sort(df, chosen, order, random_state))
        lost = F.lit(False)
        if exact and chosen.kind in ("max", "min") and null_keys == "reference":
            missing = F.lit(False)
            for c in key.columns:
                missing = missing | clean(df, c).isNull()
            lost = missing & clean(df, chosen.column).isNotNull()
            window = Window.partitionBy(*keys, lost).orderBy(*_sort(df, chosen, order, random_state))
        ranked = work.withColumn(RANK, F.row_number().over(window)).withColumn(flag_column, (F.col(RANK) > 1) | lost)
    ids = [F.col("_tm_id").alias(group_id_column)] if group_id_column and grouped else []
    own = [F.col(f"`{c}`") for c in columns if c != group_id_column or not ids]
    held = ranked.orderBy(ROW) if keep_order else ranked
    if action == "remove":
        out = held.where(~F.col(flag_column)).select(*own, *ids)
    else:
        out = held.select(*(c for c, n in zip(own, [c for c in columns if c != group_id_column or not ids], strict=True) if n != flag_column), flag_column, *ids)
    if not (return_stats or log_stats):
        return out
    stats = _stats(ranked, flag_column, action)
    stats |= {"grouping": "entity_by" if entities is not None else "group_by" if groups is not None else None, "mode": mode, "pick": pick if isinstance(pick, str) else getattr(pick, "__name__", "callable"), "on_kind": key.kind, "on_cols": key.columns}
    stats |= {"entity_by": entities, "group_by": groups if entities is None else None, "block_by": blocks or None}
    if log_stats:
        log.info("deduplication: %s", stats)
    return (out, stats) if return_stats else out


def _with_ids(work: DataFrame, keys: list[Column], blocks: list[Column], order: list[Column]) -> DataFrame:
    """``_tm_id``: groups numbered from 0 by their first row, block after block where there are blocks."""
    first = lambda columns: F.min(F.struct(*(c.alias(f"o{k}") for k, c in enumerate(columns))))
    named = work.withColumns({f"_tm_k{k}": c for k, c in enumerate(keys)} | {f"_tm_b{k}": c for k, c in enumerate(blocks)})
    names, block_names = [f"_tm_k{k}" for k in range(len(keys))], [f"_tm_b{k}" for k in range(len(blocks))]
    heads = named.groupBy(*names, *block_names).agg(first(order).alias("_tm_first"))
    by = [F.col("_tm_first")]
    if blocks:
        starts = heads.groupBy(*block_names).agg(F.min("_tm_first").alias("_tm_start"))
        heads = _same(heads, starts, block_names)
        by = [F.col("_tm_start"), F.col("_tm_first")]
    ids = number(heads, by, "_tm_id").select(*names, *block_names, "_tm_id")
    return _same(named, ids, [*names, *block_names]).drop(*names, *block_names)


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """A join in which nulls are equal."""
    renamed = right.withColumnsRenamed({n: f"{n}r" for n in names})
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"{n}r"))
    return left.join(renamed, condition).drop(*(f"{n}r" for n in names))


def _stats(ranked: DataFrame, flag: str, action: str) -> dict:
    total, dropped = ranked.agg(F.count("*"), F.count_if(F.col(flag))).first()
    return {"original_count": total, "kept_count": total - dropped, "removed_count": dropped if action == "remove" else 0, "flagged_count": dropped if action == "flag" else 0}
