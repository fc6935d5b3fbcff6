"""Benchmark decontamination with a distributed positional inverted index.

The index has one segment for each run of documents. A segment keeps every
word's postings: its positions in the segment, ascending, under a sorted list
of terms. Segments are built where the documents are read and stored as a
table, without a shuffle and so without a hot term. A search goes through the
segments; in each, a query's offset-adjusted lists are intersected from its
rarest term on, so that the work follows the rarest term's postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.ids import any_id
from tidemill.llm.packing import pack, unpack
from tidemill.llm.textkernel import piece_of, pieces, words
from tidemill.staging import stage

#: Words of a window.
WINDOW = 13
#: Query words that go to the executors at once; more are taken in blocks.
BLOCK_WORDS = 1 << 20

_SEGMENT = "segment long, ids array<long>, n_words array<long>, terms binary, counts binary, positions binary"
_HITS = "segment long, place int, id long, n_words long, spans array<struct<begin:long,end:long>>, items array<long>"


def _index(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for k, (rows, piece) in enumerate(pieces(batches, text_col)):
            w = words(piece, "alnum")
            order = np.argsort(w.hash, kind="stable").astype(np.uint32)
            terms = w.hash[order]
            begin = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
            counts = np.diff(np.append(begin, len(terms))).astype(np.uint32)
            gaps = order.copy()
            gaps[1:] -= order[:-1]
            gaps[begin] = order[begin]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task + k], pa.int64()),
                    pa.array([rows.column(id_col).to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(w.first)], pa.list_(pa.int64())),
                    pa.array([terms[begin].tobytes()], pa.binary()), pa.array([pack(counts)], pa.binary()), pa.array([pack(gaps)], pa.binary()),
                ],
                ["segment", "ids", "n_words", "terms", "counts", "positions"],
            )

    return run


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of every word of every text, in numbered segments; a null text has no words."""
    return stage(docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(_index(id_col, text_col), _SEGMENT), "index")


class Segment:
    """A segment with its lists opened."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.n_words = np.array(row["n_words"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.counts = unpack(row["counts"], np.uint32).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])
        gaps = unpack(row["positions"], np.uint32).astype(np.int64)
        c = np.cumsum(gaps)
        at = self.begin[:-1]
        self.position = c - np.repeat(c[at] - gaps[at], self.counts) if len(gaps) else gaps
        self.key = np.repeat(np.arange(len(self.terms)), self.counts) << 32 | self.position

    def term(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each term, -1 if it isn't in the segment."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of several terms one after the other, and whose each posting is."""
        n = self.counts[terms]
        whose = np.repeat(np.arange(len(terms)), n)
        return self.position[np.repeat(self.begin[terms] - np.cumsum(n) + n, n) + np.arange(n.sum())], whose

    def at(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """Whether the term is at the position."""
        want = terms << 32 | positions
        found = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return (self.key[found] == want) & (positions >= 0)

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, side="right") - 1

    def phrases(self, queries: Queries) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By width: pairs (item, first position) of all exact occurrences of windows.

        Each distinct term is looked up once; only windows that have all their
        terms here are intersected, from the rarest on.
        """
        here = self.term(queries.terms)[queries.words]
        missing = np.concatenate([[0], np.cumsum(here < 0)])
        for width, (start, item) in queries.by_width.items():
            alive = np.flatnonzero(missing[start + width] == missing[start])
            if len(alive):
                whose, p = self._occurrences(here[start[alive][:, None] + np.arange(width)])
                yield width, item[alive[whose]], p

    def _occurrences(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``t``: a row of terms each. Pairs (row, first position)."""
        width = t.shape[1]
        order = np.argsort(self.counts[t], axis=1, kind="stable")
        rarest = np.take_along_axis(t, order, 1)
        p, whose = self.postings(rarest[:, 0])
        p = p - order[whose, 0]
        for j in range(1, width):
            fits = self.at(rarest[whose, j], p + order[whose, j])
            p, whose = p[fits], whose[fits]
        one = (p >= 0) & (p + width <= self.first[-1])
        p, whose = p[one], whose[one]
        inside = self.document(p) == self.document(p + width - 1)
        return whose[inside], p[inside]

    def near(self, hashes: np.ndarray, within: int) -> np.ndarray:
        """Documents that have all the terms, in any order, inside ``within`` consecutive words."""
        t = self.term(np.unique(hashes))
        if not len(t) or (t < 0).any():
            return np.zeros(0, np.int64)
        t = t[np.argsort(self.counts[t], kind="stable")]
        anchors, _ = self.postings(t[:1])
        alive = []
        for p in anchors.tolist():
            lo, hi = self.first[d := int(self.document(np.array(p)))], self.first[d + 1]
            lists = []
            for x in t:
                own = self.position[self.begin[x] : self.begin[x + 1]]
                lists.append(own[np.searchsorted(own, max(lo, p - within + 1)) : np.searchsorted(own, min(hi, p + within))])
            starts = np.unique(np.concatenate(lists))
            ok = np.ones(len(starts), bool)
            for own in lists:
                k = np.searchsorted(own, starts)
                ok &= (k < len(own)) & (own[np.minimum(k, len(own) - 1)] < starts + within) if len(own) else False
            if ok.any():
                alive.append(d)
        return np.unique(np.array(alive, np.int64))


@dataclass
class Queries:
    """The distinct terms of some items, their words as places among the terms, and by width the windows: where each starts and its item."""

    terms: np.ndarray
    words: np.ndarray
    by_width: dict[int, tuple[np.ndarray, np.ndarray]]


def windows(ids: list, texts: list[str | None], width: int = WINDOW) -> Queries:
    """All runs of ``width`` words of each text; of one with fewer words, but not none, all of them."""
    w = words(piece_of(pa.array(texts, pa.string())), "alnum")
    terms, places = np.unique(w.hash, return_inverse=True)
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for i, item in enumerate(ids):
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        n = min(width, hi - lo)
        if n and item is not None:
            start = np.arange(lo, hi - n + 1)
            found.setdefault(n, []).append((start, np.full(len(start), item, np.int64)))
    return Queries(terms, places, {n: tuple(map(np.concatenate, zip(*own, strict=True))) for n, own in found.items()})


def _union(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint runs that cover the same positions."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    at = np.flatnonzero(new)
    return begin[at], end[np.append(at[1:], len(begin)) - 1]


def _search(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = broadcast.value
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                s = Segment(row)
                docs, begins, ends, items = [], [], [], []
                for width, item, p in s.phrases(queries):
                    docs.append(s.document(p))
                    begins.append(p)
                    ends.append(p + width)
                    items.append(item)
                doc, begin, end, item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, begins, ends, items))
                out = {k: [] for k in ("segment", "place", "id", "n_words", "spans", "items")}
                order = np.argsort(doc, kind="stable")
                doc, begin, end, item = doc[order], begin[order], end[order], item[order]
                cut = np.searchsorted(doc, np.arange(len(s.ids) + 1))
                for d, name in enumerate(s.ids):
                    lo, hi = cut[d], cut[d + 1]
                    b, e = _union(begin[lo:hi], end[lo:hi]) if hi > lo else (begin[:0], end[:0])
                    out["segment"].append(row["segment"])
                    out["place"].append(d)
                    out["id"].append(name)
                    out["n_words"].append(int(s.n_words[d]))
                    out["spans"].append([{"begin": int(x - s.first[d]), "end": int(y - s.first[d])} for x, y in zip(b, e, strict=True)])
                    out["items"].append(np.unique(item[lo:hi]).tolist())
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("segment", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.int64()))]))

    return run


def _near(broadcast, within: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = Segment(batch.slice(i, 1).to_pylist()[0])
                pairs = [(s.ids[d], item) for item, hashes in broadcast.value for d in s.near(hashes, within)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], ["id", "item"])

    return run


def proximity_matches(index: DataFrame, queries: list[tuple[int, str]], within: int) -> DataFrame:
    """Pairs ``(id, item)``: all the query's words, in any order, inside ``within`` consecutive words.

    ``queries`` is a stated list of at most BLOCK_WORDS words in all. A query
    without words matches nothing.
    """
    w = words(piece_of(pa.array([t for _, t in queries], pa.string())), "alnum")
    if len(w.hash) > BLOCK_WORDS:
        raise ValueError(f"more than {BLOCK_WORDS} query words")
    sent = index.sparkSession.sparkContext.broadcast([(i, w.hash[w.first[k] : w.first[k + 1]]) for k, (i, _) in enumerate(queries)])
    return index.mapInArrow(_near(sent, within), "id long, item long").distinct()


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """Items in blocks of bounded size; an item of any size is a block of its own."""
    ids, texts, size = [], [], 0
    for row in items.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        n = len(row[1] or "") // 4
        if ids and size + n > BLOCK_WORDS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += n
    yield ids, texts


def phrase_hits(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """One row for each document of the index: id, n_words, the disjoint spans of words that item windows cover, the items.

    Items go to the executors in blocks of at most about BLOCK_WORDS words, a
    pass over the index for each; the benchmark is a stated query set.
    """
    spark = index.sparkSession
    passes = []
    for ids, texts in _blocks(items, id_col, text_col):
        sent = spark.sparkContext.broadcast(windows(ids, texts, width))
        passes.append(index.mapInArrow(_search(sent), _HITS))
    if len(passes) == 1:
        return passes[0].drop("segment", "place")
    parts = stage(passes[0], "hits")
    for p in passes[1:]:
        parts = parts.unionByName(stage(p, "hits"))
    # A row is its segment and its place in it: ids may be null or repeated.
    rows = parts.groupBy("segment", "place", "id", "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.select("id", "n_words", _merged("spans").alias("spans"), "items")


def _merged(spans: str) -> F.Column:
    """Disjoint spans that cover the same words, natively."""
    start = F.expr("array(struct(bigint(-1) AS begin, bigint(-1) AS end))")
    step = lambda done, x: F.when(F.element_at(done, -1)["end"] >= x["begin"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["begin"].alias("begin"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(done, F.array(x)))
    whole = F.aggregate(F.array_sort(spans), start, step)
    return F.slice(whole, 2, F.greatest(F.size(whole) - 1, F.lit(0)))



@any_id()
def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 20) -> DataFrame:
    """One row for each document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if an occurrence of an item's window covers it. A document is
    contaminated if a word is hit and ``share * n_hit >= n_words``. Null and
    empty texts have no words and are clean; items without words or with a null
    id match nothing; items that are equal each count. Rows with a null or
    repeated id are judged as any other. Other columns aren't looked at.
    """
    hits = phrase_hits(build_index(docs, id_col, text_col), items)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["begin"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    out = hits.select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.expr(f"n_hit > 0 AND {share} * n_hit >= n_words"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
