"""Exact duplicates by a tree-merge of sorted digest runs.

Every partition sorts the digests of its documents into a run with one row for
each digest. Partitions then exchange runs in rounds, as in a binomial
exchange with RADIX partners instead of two: in a round, the RADIX partitions
that differ in one digit of their number deal out their runs by that digit of
the digest's target. A run travels as blocks of sorted rows. The receiver merges
the runs it got: blocks come by their first digest, what is below the next
block's first is done, and the rest is merged with that block, equal digests of
equally long texts becoming one row with the smallest identifier. So a merge
holds a few blocks, whatever the length of the runs. After the last round a
digest is in one partition only. No level has more rows than the one before, a
partition holds a digest once at most however many copies there are, and no task
gets everything.
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
from tidemill.staging import parallelism, stage

#: Runs that meet in a merge, and rows of a block.
RADIX, BLOCK = 4, 4096

_BLOCK = "cell int, first binary, key binary, unknown binary, id binary, row binary, n binary"
_BEST = "digest binary, n_bytes long, keep_id long, keep_row long, group_size long"


def normalised(text: str) -> F.Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


@dataclass
class Run:
    """Rows by ascending key, one each: the digest and the length of the text, the smallest identifier and its row, and how many there are."""

    key: np.ndarray
    unknown: np.ndarray
    id: np.ndarray
    row: np.ndarray
    n: np.ndarray

    def __len__(self) -> int:
        return len(self.key)

    def columns(self) -> list[np.ndarray]:
        return [self.key, self.unknown, self.id, self.row, self.n]

    def __getitem__(self, rows) -> Run:
        return Run(*(c[rows] for c in self.columns()))


_KINDS = ("S40", np.bool_, np.int64, np.int64, np.int64)


def merged(a: Run, b: Run) -> Run:
    """Two runs as one."""
    at = np.searchsorted(a.key, b.key)
    both = np.flatnonzero(at < len(a))
    both = both[a.key[at[both]] == b.key[both]]
    own = at[both]
    order = np.lexsort((np.concatenate([a.row[own], b.row[both]]), np.concatenate([a.id[own], b.id[both]]), np.concatenate([a.unknown[own], b.unknown[both]])))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    better = both[place[len(own) :] < place[: len(own)]]
    out = Run(*(c.copy() for c in a.columns()))
    for mine, other in ((out.unknown, b.unknown), (out.id, b.id), (out.row, b.row)):
        mine[at[better]] = other[better]
    out.n[own] += b.n[both]
    new = np.ones(len(b), bool)
    new[both] = False
    return Run(*(np.insert(x, at[new], y[new]) for x, y in zip(out.columns(), b.columns(), strict=True)))


def merge(runs: Iterator[Run]) -> Iterator[Run]:
    """Runs that come by their first key, as one run in parts."""
    held: Run | None = None
    for run in runs:
        if held is None:
            held = run
        elif len(run):
            done = int(np.searchsorted(held.key, run.key[0]))
            if done:
                yield held[:done]
            held = merged(held[done:], run)
    if held is not None:
        yield held


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """Batches of sorted rows as runs."""
    for batch in batches:
        if batch.num_rows:
            digest = batch.column("digest")
            start = np.frombuffer(digest.buffers()[1], np.int32)[digest.offset]
            key = np.empty((len(digest), 40), np.uint8)
            key[:, :32] = np.frombuffer(digest.buffers()[2], np.uint8)[start : start + 32 * len(digest)].reshape(-1, 32)
            key[:, 32:] = batch.column("n_bytes").to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
            key = key.view("S40").ravel()
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ids = batch.column("id")
            unknown = ids.is_null().to_numpy(zero_copy_only=False)
            run = Run(key, unknown, ids.fill_null(0).to_numpy(), batch.column("row").to_numpy(), np.ones(len(key), np.int64))[first]
            run.n = np.diff(np.append(first, len(key)))
            yield run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Run]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("cell")[i].as_py(), Run(*(np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in zip(("key", "unknown", "id", "row", "n"), _KINDS, strict=True)))


def _targets(key: np.ndarray, cells: int) -> np.ndarray:
    head = np.ascontiguousarray(key).view(np.uint8).reshape(-1, 40)[:, :4].copy().view(">u4").ravel()
    return (head.astype(np.int64) * cells) >> 32


def _dealt(parts: Iterator[Run], cell: int, digit: int, cells: int) -> Iterator[pa.RecordBatch]:
    """A run's rows by one digit of their targets, as blocks."""
    step, held = RADIX**digit, {}
    own = cell // step % RADIX

    def block(d: int, run: Run) -> pa.RecordBatch:
        cols = [pa.array([x.tobytes()], pa.binary()) for x in run.columns()]
        return pa.RecordBatch.from_arrays([pa.array([cell + (d - own) * step], pa.int32()), pa.array([run.key[:1].tobytes()], pa.binary()), *cols], ["cell", "first", "key", "unknown", "id", "row", "n"])

    for part in parts:
        to = _targets(part.key, cells) // step % RADIX
        for d in np.unique(to).tolist():
            runs = held.setdefault(d, [])
            runs.append(part[to == d])
            if sum(map(len, runs)) >= BLOCK:
                whole = Run(*map(np.concatenate, zip(*(r.columns() for r in runs), strict=True)))
                for at in range(0, len(whole), BLOCK):
                    yield block(d, whole[at : at + BLOCK])
                held[d] = []
    for d, runs in held.items():
        if runs:
            yield block(d, Run(*map(np.concatenate, zip(*(r.columns() for r in runs), strict=True))))


def _first_round(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _dealt(merge(_sorted_rows(batches)), TaskContext.get().partitionId() % cells, 0, cells)

    return run


def _next_round(digit: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(batches)
        for cell, first in blocks:
            yield from _dealt(merge(_chained(first, blocks)), cell, digit, cells)

    return run


def _chained(first: Run, blocks: Iterator[tuple[int, Run]]) -> Iterator[Run]:
    """All blocks of a partition, which has one cell."""
    yield first
    for _, run in blocks:
        yield run


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in merge(run for _, run in _blocks(batches)):
        raw = np.ascontiguousarray(run.key).view(np.uint8).reshape(-1, 40)
        digest = pa.Array.from_buffers(pa.binary(32), len(run), [None, pa.py_buffer(raw[:, :32].tobytes())]).cast(pa.binary())
        n_bytes = raw[:, 32:].copy().view(">i8").ravel().astype(np.int64)
        yield pa.RecordBatch.from_arrays([digest, pa.array(n_bytes), pa.array(run.id, pa.int64(), mask=run.unknown), pa.array(run.row), pa.array(run.n)], ["digest", "n_bytes", "keep_id", "keep_row", "group_size"])


def _rounds(spark: SparkSession) -> int:
    n = 1
    while RADIX**n < parallelism(spark):
        n += 1
    return n


@any_id("keep_id")
def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``.

    ``id_col`` (as a long), ``keep_id`` (of the row that stays), ``group_size``,
    ``kept``, ``text_sha256``. Texts are equal when they are the same after
    ``normalised``. A null text equals an empty one. Of equal texts the smallest
    id stays, an id that isn't null before a null one; of rows that share this
    id exactly one stays. An empty table gives an empty result. Other columns
    are not looked at.
    """
    spark = docs.sparkSession
    rounds = _rounds(spark)
    cells = RADIX**rounds
    text = normalised(text_col)
    hashed = docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"))
    hashed = stage(hashed, "digests")
    runs = hashed.sortWithinPartitions("digest", "n_bytes", F.col("id").asc_nulls_last(), "row").mapInArrow(_first_round(cells), _BLOCK)
    for k in range(1, rounds + 1):
        met = runs.repartitionById(cells, F.col("cell")).sortWithinPartitions("first")
        runs = met.mapInArrow(_next_round(k, cells), _BLOCK) if k < rounds else met.mapInArrow(_last, _BEST)
    best = runs
    return hashed.join(best, ["digest", "n_bytes"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
