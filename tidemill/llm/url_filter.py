"""URL filter: rules first, then gradient-boosted trees on lexical features.

URLs that a rule decides are the labelled ones; the trees learn from a bounded
sample of them and judge the rest. Features: length, path depth, digit ratio,
entropy, counts of parameters, labels and hyphens, and suffix statistics, the
smoothed share of blocked hosts under the host's suffixes and beside the path's
first folder. For a URL that is learned from, these come from the hosts of other
folds, so that its own label isn't in them. All but the entropy, which is taken of bytes, are column
expressions.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.textkernel import piece_of

#: (verdict, rule) of the query; fixed by its contract.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Labelled URLs that are learned from, at most, and rules that may be given.
TRAIN_URLS, MOST_RULES = 20_000, 1000
ROUNDS, DEPTH, RATE, BINS = 40, 3, 0.3, 32
#: Parts of the hosts whose suffix statistics come from the others, and hosts that the prior weighs as many as.
FOLDS, PRIOR_HOSTS = 5, 10

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: str) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits ``host`` and ``path``, or null.

    A rule is a host and a path. It fits its host and every subdomain, if the
    path starts with its path. Of rules of one length the first one given wins.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = []
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        own = (F.col("host") == name) | F.col("host").endswith("." + name)
        found.append(F.when(own & F.col("path").startswith(slash + rest), F.lit(rule)))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def lexical(url: str) -> dict[str, Column]:
    """What ``url``, ``host`` and ``path`` show; a null URL is like an empty one."""
    text = F.coalesce(F.col(url), F.lit(""))
    query = F.coalesce(F.regexp_extract(text, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), F.lit(""))
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("double")
    return {
        "length": F.length(text).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"), "depth": count(F.col("path"), "/"),
        "digits": F.regexp_count(text, F.lit("[0-9]")) / F.greatest(F.lit(1), F.length(text)), "parameters": count(query, "&") + (query != "").cast("double"), "labels": F.size(F.split("host", r"\.")).cast("double"),
        "hyphens": count(text, "-"), "secure": F.lower(F.substring(text, 1, 8)).eqNullSafe("https://").cast("double"),
    }


SHOWN = ["length", "host_length", "path_length", "depth", "digits", "parameters", "labels", "hyphens", "secure"]
FEATURES = [*SHOWN, "entropy", "suffix1", "suffix2", "folder"]


def entropy(urls: pa.Array) -> np.ndarray:
    """Bits a byte of each text, 0 for null and empty ones."""
    piece = piece_of(urls)
    sizes = np.diff(piece.begin) - 1
    body = np.ones(len(piece.buf), bool)
    body[piece.begin[1:] - 1] = False
    out = np.zeros(piece.docs)
    for at in range(0, piece.docs, 4096):
        upto = min(at + 4096, piece.docs)
        own = slice(piece.begin[at], piece.begin[upto])
        cell = np.repeat(np.arange(upto - at), np.diff(piece.begin[at : upto + 1])) * 256 + piece.buf[own]
        share = np.bincount(cell[body[own]], minlength=(upto - at) * 256).reshape(-1, 256) / np.maximum(1, sizes[at:upto])[:, None]
        out[at:upto] = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    return out


def marks_of(host: str, path: str) -> tuple[str, str, str]:
    """The host's last label, its last two, and the path's first folder."""
    labels, folders = host.split("."), path.split("/")
    return labels[-1], "." + ".".join(labels[-2:]), f"/{folders[1]}/" if len(folders) > 2 else "/"


@dataclass
class Suffixes:
    """By mark the smoothed share of blocked hosts that have it."""

    share: dict[str, float]
    prior: float

    def of(self, places: list[tuple[str, str]]) -> np.ndarray:
        return np.array([[self.share.get(x, self.prior) for x in marks_of(*p)] for p in places], float).reshape(len(places), 3)


def suffix_statistics(places: list[tuple[str, str]], blocked: np.ndarray, prior: float) -> Suffixes:
    """``places``: (host, path). Each host counts once under a mark, by the share of its URLs there that are blocked."""
    each: dict[tuple[str, str], list[float]] = {}
    for p, b in zip(places, blocked, strict=True):
        for mark in {*marks_of(*p)}:
            s = each.setdefault((mark, p[0]), [0.0, 0.0])
            s[0] += b
            s[1] += 1
    seen: dict[str, list[float]] = {}
    for (mark, _), (b, n) in each.items():
        s = seen.setdefault(mark, [0.0, 0.0])
        s[0] += b / n
        s[1] += 1
    return Suffixes({k: (b + PRIOR_HOSTS * prior) / (n + PRIOR_HOSTS) for k, (b, n) in seen.items()}, prior)


@dataclass
class Trees:
    """Trees by level: a node's feature and bound, and the values of the leaves."""

    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, b, v in zip(self.feature, self.bound, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > b[node])
            out += v[node - (2**DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, second-order gains, splits at quantiles."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    mean = (y.sum() + 1) / (len(y) + 2)
    base = math.log(mean / (1 - mean))
    margin, trees, inner = np.full(len(y), base), [], 2**DEPTH - 1
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, bound, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            best = 1e-9
            total_g, total_h = g[own].sum(), h[own].sum()
            for f, c in enumerate(cuts):
                if not len(c) or not len(own):
                    continue
                left_g = np.cumsum(np.bincount(binned[own, f], g[own], len(c) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[own, f], h[own], len(c) + 1))[:-1]
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                at = int(gain.argmax())
                if gain[at] > best:
                    best, feature[k], bound[k] = gain[at], f, c[at]
            node[own] = 2 * k + 1 + (x[own, feature[k]] > bound[k])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        margin += value[leaf]
        trees.append((feature, bound, value))
    f, b, v = (np.stack(t) for t in zip(*trees, strict=True))
    return Trees(f, b, v, base)


def learn(urls: list[str], places: list[tuple[str, str]], shown: np.ndarray, blocked: np.ndarray) -> tuple[Trees, Suffixes]:
    """``places``: (host, path); ``shown``: the columns of ``lexical``."""
    y = np.asarray(blocked, float)
    prior = float((y.sum() + 1) / (len(y) + 2))
    fold = np.array([zlib.crc32(h.encode()) % FOLDS for h, _ in places])
    others = np.zeros((len(y), 3))
    for k in range(FOLDS):
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        others[own] = suffix_statistics([places[i] for i in rest], y[rest], prior).of([places[i] for i in own])
    x = np.column_stack([shown, entropy(pa.array(urls, pa.string())), others])
    return boost(x, y), suffix_statistics(places, y, prior)


def judge(trees: Trees, suffixes: Suffixes, urls: pa.Array, places: list[tuple[str, str]], shown: np.ndarray) -> np.ndarray:
    """The probability of ``block``."""
    return trees.probability(np.column_stack([shown, entropy(urls), suffixes.of(places)]))


def _judge(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, suffixes = model.value
        for batch in batches:
            shown = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in SHOWN]).reshape(batch.num_rows, len(SHOWN))
            p = judge(trees, suffixes, batch.column("url"), list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)), shown)
            kept = ["id", "host", "path", "rule"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p, pa.float64())], [*kept, "p_block"])

    return run


def labelled_urls(rows: DataFrame, most: int = TRAIN_URLS) -> DataFrame:
    """At most ``most`` different URLs that a rule decides, those of the least hashes; a task sends its part of about a fifth more at most."""
    known = rows.where("rule IS NOT NULL").withColumn("mark", F.pmod(F.xxhash64("url"), F.lit(1 << 40)))
    n = known.agg(F.approx_count_distinct("mark")).first()[0]
    some = known.where(F.col("mark") <= int(min(1.0, max(1000, 1.2 * most) / max(1, n)) * (1 << 40))).select("url", "host", "path", "rule", "mark").distinct()
    return some.orderBy("mark", "url").limit(most)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of ``pages``: id, host, path, rule, verdict, p_block.

    ``verdict`` is that of the rule, or else ``block`` where the trees give a
    probability of 0.5 or more, and ``allow``. A null URL or one without
    ``://`` has an empty host and path, no rule, and is judged by its text.
    The trees learn from at most TRAIN_URLS different URLs that rules decide,
    those of the least hashes; with none, everything else is allowed. Repeated rows and
    null ids are judged like others. Other columns aren't looked at.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host("url"), "path": path("url")}).withColumn("rule", rule_of(rules))
    verdicts = {r: v for v, r in reversed(rules)}
    labelled = labelled_urls(rows, TRAIN_URLS).select("url", "host", "path", "rule", *(c.alias(k) for k, c in lexical("url").items())).collect()
    if labelled:
        model = learn([r["url"] for r in labelled], [(r["host"], r["path"]) for r in labelled], np.array([[r[c] for c in SHOWN] for r in labelled]), np.array([verdicts[r["rule"]] == "block" for r in labelled]))
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        judged = rows.withColumns(lexical("url")).mapInArrow(_judge(spark.sparkContext.broadcast(model)), ", ".join(f"`{c}` {kinds[c]}" for c in ("id", "host", "path", "rule")) + ", p_block double")
    else:
        judged = rows.withColumn("p_block", F.lit(0.0))
    said = F.create_map(*(F.lit(x) for pair in verdicts.items() for x in pair)) if verdicts else F.lit(None)
    verdict = F.when(F.col("rule").isNotNull(), F.element_at(said, F.col("rule"))) if verdicts else F.lit(None).cast("string")
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce(verdict, F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
