"""Token counts by field and section, with offset-mapped attribution.

A document is encoded once, as a whole. A token's span of bytes follows from
the lengths of the tokens before it; spans are joined to the sections' spans by
binary search. A token that crosses a boundary is allocated by an explicit
rule, so that the sections' counts always add up to the document's.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.ids import any_id

#: The vocabulary of the query: a file of base64 tokens and ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How text is cut before pairs are merged; fixed by the public byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("majority", "start", "end")

_OUT = "id long, field string, section int, begin long, end long, n_tokens long, n_crossing long"
_HELD: dict[int, tuple[tiktoken.Encoding, np.ndarray]] = {}


def _encoding(vocabulary: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    key = hash(vocabulary)
    if key not in _HELD:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _HELD[key] = (tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths)
    return _HELD[key]


def allocate(begin: np.ndarray, end: np.ndarray, section: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether it crosses a boundary.

    Sections begin at ``section``, ascending from 0, and end where the next
    begins. ``start``: the section of the first byte; ``end``: of the last;
    ``majority``: the one with most of the token's bytes, of equals the first.
    """
    first = np.searchsorted(section, begin, side="right") - 1
    last = np.searchsorted(section, end - 1, side="right") - 1
    crosses = first != last
    if rule == "end":
        return last, crosses
    if rule == "majority":
        first = first.copy()
        for k in np.flatnonzero(crosses):
            edges = np.concatenate([[begin[k]], section[first[k] + 1 : last[k] + 1], [end[k]]])
            first[k] += int(np.diff(edges).argmax())
    return first, crosses


def _count(vocabulary, fields: list[str], rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoding(vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield _counted(batch.slice(at, 256), encoding, lengths, fields, rule)

    return run


def _counted(batch: pa.RecordBatch, encoding: tiktoken.Encoding, lengths: np.ndarray, fields: list[str], rule: str) -> pa.RecordBatch:
    ids, names, numbers, begins, ends, counts, crossings = [], [], [], [], [], [], []
    for i, name in enumerate(batch.column("id").to_pylist()):
        texts = [batch.column(f)[i].as_py() for f in fields]
        present = [(f, t) for f, t in zip(fields, texts, strict=True) if t]
        whole = "\n".join(t for _, t in present)
        raw = np.frombuffer(whole.encode(), np.uint8)
        # A section is a line with the line feed that ends it; a field's last section has the separator.
        starts = np.concatenate([[0], np.flatnonzero(raw == 10) + 1]) if len(raw) else np.zeros(1, np.int64)
        if len(starts) > 1 and starts[-1] == len(raw):
            starts = starts[:-1]
        tokens = np.array(encoding.encode_ordinary(whole), np.int64)
        stop = np.cumsum(lengths[tokens])
        where, crosses = allocate(stop - lengths[tokens], stop, starts, rule)
        char = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        base, owner, number, offset = 0, [], [], []
        for f, t in present:
            size = len(t.encode()) + 1
            inside = starts[(starts >= base) & (starts < base + size)]
            owner += [f] * len(inside)
            number += range(len(inside))
            offset += [char[base]] * len(inside)
            base += size
        if not present:
            owner, number, offset = [fields[0]], [0], [0]
        edge = np.append(starts, len(raw))
        n = len(starts)
        ids += [name] * n
        names += owner
        numbers += number
        begins.append(char[edge[:-1]] - np.array(offset))
        ends.append(char[edge[1:]] - np.array(offset))
        counts.append(np.bincount(where, minlength=n))
        crossings.append(np.bincount(where, weights=crosses, minlength=n).astype(np.int64))
    flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(numbers, pa.int32()), *(pa.array(flat(x), pa.int64()) for x in (begins, ends, counts, crossings))], ["id", "field", "section", "begin", "end", "n_tokens", "n_crossing"]
    )


@any_id()
def count_tokens(docs: DataFrame, fields: list[str], vocabulary: str = VOCABULARY, rule: str = "majority", id_col: str = "doc_id") -> DataFrame:
    """One row for each section of each document: id, field, section, begin, end, n_tokens, n_crossing.

    A document is its fields that have text, in order, joined by a line feed,
    and encoded as a whole. A section is a line with the line feed that ends
    it; the one between two fields belongs to the field before. ``begin`` and
    ``end`` are characters of the field. Each token counts in one section, by
    ``rule``: see ``allocate``; ``n_crossing`` of them reach into another
    section. Null fields and empty ones have no sections; a document without
    any text gives one row of no tokens, under its first field. Rows with null
    or repeated ids each give their sections. ``vocabulary`` is a file on the
    driver, sent to the executors.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        sent = spark.sparkContext.broadcast(file.read())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *(F.col(f).cast("string").alias(f"field{k}") for k, f in enumerate(fields)))
    counted = rows.mapInArrow(_count(sent, [f"field{k}" for k in range(len(fields))], rule), _OUT)
    name = F.element_at(F.create_map(*(F.lit(x) for k, f in enumerate(fields) for x in (f"field{k}", f))), F.col("field"))
    return counted.select(F.col("id").alias(id_col), name.alias("field"), "section", "begin", "end", "n_tokens", "n_crossing")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["text"])
