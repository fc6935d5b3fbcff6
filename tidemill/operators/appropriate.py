"""Is an item like what a reference set has? Scores and decisions as expressions."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.items import document_frequency, normalize_item
from tidemill.operators.neighbors import nearest


log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Thresholds:
    min_sim: float
    min_freq: float
    allow_outlier: bool = False
    llm_enabled: bool = False
    llm_min_p: float = 0.35


# The presets.
PRESETS = {"strict": Thresholds(0.62, 0.08, False, False, 0.40), "normal": Thresholds(0.56, 0.04, False, False, 0.35), "lenient": Thresholds(0.52, 0.01, True, False, 0.30)}

NO, YES = "Inappropriate", "Appropriate"


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def score(sim: Column, freq: Column, min_freq: float, outlier: Column, allow_outlier: bool) -> Column:
    """80 % similarity, 20 % how common; less for what is rarer than ``min_freq`` and for outliers."""
    sim, freq = clamp(sim, 0.0, 1.0), clamp(freq.cast("double"), 0.0, 1.0)
    base = clamp(0.8 * sim + 0.2 * clamp(F.log1p(freq * 10.0) / F.log1p(F.lit(10.0)), 0.0, 1.0), 0.0, 1.0)
    if min_freq > 0:
        base = base * F.when(freq < min_freq, 0.25 + 0.75 * freq / min_freq).otherwise(1.0)
    if not allow_outlier:
        base = base * F.when(F.coalesce(outlier, F.lit(False)), 0.7).otherwise(1.0)
    return clamp(base, 0.0, 1.0)


def suggest(rows_used: int, floor: float, base: Thresholds, min_sim: float | None = None, min_freq: float | None = None) -> Thresholds:
    """Thresholds near a preset's, moved towards what the data suggest; those that the user gives win."""
    near = lambda x, lo, hi: min(hi, max(lo, x))
    freq = near(2 / max(1, rows_used), 0.01, 0.10)
    return replace(
        base, min_sim=near(min_sim, 0, 1) if min_sim is not None else near(floor, base.min_sim - 0.05, base.min_sim + 0.05),
        min_freq=near(min_freq, 0, 1) if min_freq is not None else near(freq, base.min_freq - 0.02, base.min_freq + 0.06),
    )


def evaluate(queries: DataFrame, index: DataFrame, thresholds: Thresholds, k: int = 5, explain: bool = False, outliers: DataFrame | None = None, scorer: Callable[[str], tuple[float, str] | None] | None = None, embedder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """A decision for each row of ``queries(item[, embedding])`` against ``index(item, freq[, embedding])``.

    Items are normalised; one that the index has is judged by its frequency,
    others by their most similar item. Without embeddings only exact items can
    pass; ``embedder`` gives them to queries that have none. ``outliers(query,
    outlier)`` is asked by normalised item. ``scorer``
    may veto what passes, if the thresholds enable it; None from it vetoes
    nothing. Frequencies are floats and thresholds doubles, so an item exactly
    at a threshold such as 0.04 is below it.
    """
    if embedder is not None and "embedding" not in queries.columns:
        queries = embedded(queries, embedder)
    vectors = "embedding" in queries.columns and "embedding" in index.columns
    q = queries.withColumn("id", F.monotonically_increasing_id()).withColumn("normalized", normalize_item(F.col("item")))
    known = index.select(F.col("item").alias("normalized"), F.col("freq").cast("double").alias("known_freq"))
    q = q.join(known, "normalized", "left")
    if vectors:
        asked = q.where("known_freq IS NULL AND normalized != ''" if not explain else "normalized != ''").select(F.col("normalized").alias("query"), "embedding").dropDuplicates(["query"])
        near = nearest(index, asked, max(k, 5) + 1).where(F.col("item") != F.col("query")).join(index.select("item", F.col("freq").cast("double").alias("freq")), "item")
        top = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("o"), "item", "sim", "freq"))).alias("all"))
        listed = F.transform(F.slice("all", 1, k), lambda x: F.struct(x["item"].alias("item"), x["sim"].alias("sim"), x["freq"].alias("freq")))
        q = q.join(top.select(F.col("query").alias("normalized"), F.element_at("all", 1).alias("best"), listed.alias("listed")), "normalized", "left")
    else:
        empty = "struct<o:double,item:string,sim:double,freq:double>"
        q = q.withColumn("best", F.lit(None).cast(empty)).withColumn("listed", F.lit(None).cast("array<struct<item:string,sim:double,freq:double>>"))
    if outliers is not None:
        q = q.join(outliers.select(F.col("query").alias("normalized"), "outlier"), "normalized", "left")
    else:
        q = q.withColumn("outlier", F.lit(None).cast("boolean"))
    exact, void = F.col("known_freq").isNotNull(), F.col("normalized") == ""
    sim, freq = F.when(exact, 1.0).otherwise(F.col("best.sim")), F.coalesce("known_freq", "best.freq")
    odd = F.coalesce("outlier", F.lit(False)) & F.lit(not thresholds.allow_outlier)
    t = thresholds
    blind = ~exact & F.col("best").isNull()
    best = F.format_string("(best=%s, ", "best.item")
    say = lambda f, c: F.format_string(f, c)
    # The phrases.
    reason = (
        F.when(void, "empty/invalid input")
        .when(exact & (freq < t.min_freq), "exact match; too uncommon").when(exact & odd, "embedding outlier vs reference set (exact match)").when(exact, "exact match; passes thresholds")
        .when(blind, "no reference data" if vectors else "embedding model unavailable; cannot evaluate non-exact item")
        .when(sim < t.min_sim, F.concat(F.lit("low similarity to known items "), best, say("sim=%.3f)", sim))).when(freq < t.min_freq, F.concat(F.lit("too uncommon in dataset "), best, say("freq=%.3f)", freq)))
        .when(odd, "embedding outlier vs reference set").otherwise(F.concat(F.format_string("similar to '%s' (", "best.item"), say("sim=%.3f, ", sim), say("freq=%.3f)", freq)))
    )
    passes = ~void & ~blind & (freq >= t.min_freq) & (sim >= F.when(exact, 0.0).otherwise(t.min_sim)) & ~odd
    out = q.select(
        "item", "normalized", F.when(passes, YES).otherwise(NO).alias("decision"), F.when(void | blind, 0.0).otherwise(score(sim, freq, t.min_freq, F.col("outlier"), t.allow_outlier)).alias("score"), reason.alias("reason"),
        F.when(~void, F.when(exact, F.col("normalized")).otherwise(F.col("best.item"))).alias("best_match"), F.when(~void, sim).alias("best_similarity"), F.when(~void, freq).alias("best_freq"), "outlier",
        F.lit(None).cast("double").alias("llm_p"), (F.col("listed") if explain else F.lit(None).cast("array<struct<item:string,sim:double,freq:double>>")).alias("neighbors"),
    )
    return veto(out, scorer, t.llm_min_p) if scorer and t.llm_enabled else out


def embedded(df: DataFrame, embedder: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """The table with a column ``embedding`` of its normalised items, a batch at a time."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in ("embedding", "text to embed"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = np.asarray(embedder(rows["text to embed"].tolist()), np.float32).reshape(len(rows), -1)
            yield rows.drop(columns="text to embed").assign(embedding=list(found))

    return df.drop("embedding").withColumn("text to embed", normalize_item(F.col("item"))).mapInPandas(run, f"{schema}, embedding array<float>")


def prompt(context: str, item: str) -> str:
    """What a model is asked about an item (fixed value)."""
    return (
        "You are judging whether an item is appropriate for a context.\n\n"
        f"Context:\n{context}\n\n"
        f"Item:\n{item}\n\n"
        "Return ONLY JSON with this schema:\n"
        '{ "p": number, "reason": string }\n'
        "Where p is the probability (0 to 1) the item is appropriate in context.\n"
    )


class Judge:
    """A scorer from ``ask(prompt) -> reply``; after a failure it asks no more and vetoes nothing, in each worker for itself."""

    def __init__(self, context: str, ask: Callable[[str], str]):
        self.context, self.ask, self.disabled_reason = context, ask, None

    def __call__(self, item: str) -> tuple[float, str] | None:
        if self.disabled_reason:
            return None
        try:
            reply = self.ask(prompt(self.context, item))
        except Exception as e:
            self.disabled_reason = f"call failed: {e!r}"
            log.warning("no more vetoes: %s", self.disabled_reason)
            return None
        return parse_reply((reply or "").strip())


def veto(decided: DataFrame, scorer: Callable[[str], tuple[float, str] | None], min_p: float) -> DataFrame:
    """Ask ``scorer(item)`` for (p, reason) of each item that passed; one with p under ``min_p`` doesn't."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            said = [scorer(x) if d == YES else None for x, d in zip(rows["item"], rows["decision"], strict=True)]
            yield rows.assign(llm_p=[s[0] if s else None for s in said], veto_reason=[s[1] if s else None for s in said])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in decided.schema) + ", veto_reason string"
    asked, no = decided.mapInPandas(run, schema), F.coalesce(F.col("llm_p") < min_p, F.lit(False))
    return asked.withColumns({"decision": F.when(no, NO).otherwise(F.col("decision")), "score": F.when(no, F.least("score", "llm_p")).otherwise(F.col("score")), "reason": F.when(no, F.concat(F.lit("LLM veto: "), "veto_reason")).otherwise(F.col("reason"))}).drop("veto_reason")


def first_object(text: str) -> str | None:
    """The first balanced JSON object in a text, strings and escapes minded."""
    depth = start = 0
    inside = escaped = False
    for i, c in enumerate(text):
        if depth and inside:
            inside, escaped = (escaped or c != '"'), c == "\\" and not escaped
        elif depth and c == '"':
            inside = True
        elif c == "{":
            start = start if depth else i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def parse_reply(text: str) -> tuple[float, str] | None:
    """(p, reason) of a model's reply: its first object with p, else the first number from 0 to 1 that stands alone."""
    fenced = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text)
    try:
        found = json.loads(first_object(text) or fenced)
        return min(1.0, max(0.0, float(found["p"]))), str(found.get("reason", "")).strip()
    except (ValueError, TypeError, KeyError, AttributeError):
        # The pattern and the phrase.
        number = re.search(r"(?<!\d)(?:0(?:\.\d+)?|1(?:\.0+)?)(?!\d)", text)
        return (float(number[0]), "LLM parsing fallback") if number else None


def parse_replies(reply: Column) -> Column:
    """``parse_reply`` of each text, a struct (p, reason)."""

    @F.pandas_udf("p double, reason string")
    def run(texts: pd.Series) -> pd.DataFrame:
        said = [parse_reply(t) if t is not None else None for t in texts]
        return pd.DataFrame({"p": [x[0] if x else None for x in said], "reason": [x[1] if x else None for x in said]}, columns=["p", "reason"])

    found = run(reply)
    return F.when(found["p"].isNotNull(), found)


def build_index(df: DataFrame, column: str) -> DataFrame:
    """``(item, freq)`` of a dataset; fewer than two items are an error."""
    index = document_frequency(df, column).select("item", "freq")
    if index.limit(2).count() < 2:
        raise ValueError("fewer than two unique items")
    return index


def save_index(index: DataFrame, path: str, n_neighbors: int = 25) -> None:
    check_index(index, n_neighbors)
    index.write.mode("overwrite").parquet(f"{path}/items")
    index.sparkSession.createDataFrame([(3, n_neighbors)], "version int, n_neighbors int").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_index(spark: SparkSession, path: str, embedder: Callable[[list[str]], np.ndarray] | None = None) -> tuple[DataFrame, int]:
    """The index and its number of neighbours; where its embeddings can't be used, the embedder's, or none."""
    meta = spark.read.json(f"{path}/meta").first()
    if meta["version"] != 3:
        raise ValueError(f"index version {meta['version']}")
    index = spark.read.parquet(f"{path}/items")
    check_index(index.drop("embedding"), meta["n_neighbors"])
    if "embedding" in index.columns and (problem := embedding_problem(index)):
        log.warning("embeddings of %s: %s", path, problem)
        index = index.drop("embedding")
    if "embedding" not in index.columns and embedder is not None:
        index = embedded(index, embedder)
    return index, meta["n_neighbors"]


def check_index(index: DataFrame, n_neighbors: int) -> None:
    freq = F.col("freq")
    bad, n, distinct = index.agg(F.count_if(freq.isNull() | F.isnan(freq) | (freq < 0) | (freq > 1) | F.col("item").isNull() | (F.col("item") == "")), F.count("*"), F.count_distinct("item")).first()
    if n_neighbors < 2 or not n or bad or n != distinct:
        raise ValueError(f"not an index: {n} items, {distinct} different, {bad} with a wrong item or frequency, {n_neighbors} neighbours")
    if "embedding" in index.columns and (problem := embedding_problem(index)):
        raise ValueError(f"not an index: {problem}")


def embedding_problem(index: DataFrame) -> str | None:
    """What is wrong with the embeddings: missing, not finite, or of several lengths."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    none, wrong, least, most = index.agg(F.count_if(x.isNull()), F.count_if(odd), F.min(F.size(x)), F.max(F.size(x))).first()
    if none or wrong:
        return f"{none} missing, {wrong} not finite"
    return f"lengths from {least} to {most}" if least != most or not most else None


def report_line() -> Column:
    """A line of text for a decision, with its neighbours below it where it has some."""
    head = F.format_string("%s: %s (score=%.3f)", "item", "decision", "score")
    head = F.concat(head, F.when(F.coalesce("reason", F.lit("")) != "", F.concat(F.lit(" — "), "reason")).otherwise(""))
    near = F.transform("neighbors", lambda x: F.concat(F.lit("\n    - "), F.rpad(x["item"], F.greatest(F.lit(28), F.length(x["item"])), F.lit(" ")), F.format_string("  sim=%.3f", x["sim"]), F.format_string("  freq=%.3f", x["freq"])))
    return F.concat(head, F.when(F.size("neighbors") > 0, F.concat(F.lit("\n  Neighbors:"), F.array_join(near, ""))).otherwise(""))


def json_line(decided: DataFrame) -> Column:
    return F.to_json(F.struct(*decided.columns), {"ignoreNullFields": "false"})


def report(decided: DataFrame) -> DataFrame:
    return decided.select(report_line().alias("line"))


def json_lines(decided: DataFrame) -> DataFrame:
    return decided.select(json_line(decided).alias("line"))


def sample(spark: SparkSession, column: str) -> DataFrame:
    """The built-in dataset: five recipes (fixed values)."""
    rows = [
        "spaghetti, garlic, tomato sauce, basil, olive oil, parmesan", "penne, garlic, tomato, onion, basil, olive oil, feta cheese", "fettuccine, cream, garlic, parmesan, black pepper, parsley",
        "linguine, garlic, shrimp, lemon, butter, parsley", "rigatoni, sausage, tomato sauce, onion, bell pepper, parmesan",
    ]
    return spark.createDataFrame([(r,) for r in rows], f"`{column}` string")
