"""Removal of passages that occur more than once, with a count-min prefilter.

A window is a run of words of one document. Windows are counted in two passes,
each an exchange between chunks of documents and shards of the hash space:

1. Each window is counted under the least hash of its shorter runs, its
   anchor. Consecutive windows mostly share one, so there are about fifteen
   times fewer anchors than windows; equal windows have equal anchors, so an
   anchor's count is never below its windows' counts. Every chunk counts its
   anchors in a count-min sketch of its own. Its rows are as wide as the whole
   corpus needs, so a chunk fills few of their cells and sends those only, to
   the shards that have a range of the cells each. A shard adds the chunks'
   cells up and answers with a bit a cell, whether its count is above one; an
   anchor is estimated to be repeated if its cells in all rows are.
2. Windows under anchors estimated to be repeated, and only they, are sent as
   96-bit keys, each once a chunk, and counted exactly. No repeated window is
   lost: the estimate is an upper bound.

A frequent window costs a key for each chunk, however often it occurs, and
answers are bits, so that no shard or chunk is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.ids import any_id
from tidemill.llm.packing import pack, unpack
from tidemill.llm.textkernel import AGAIN, Piece, Words, mix, pieces, spans, starts_of, table, words
from tidemill.staging import parallelism, stage

#: Words of a window and of the runs among which its anchor is.
WINDOW, RUN = 35, 8
#: Bytes of text of a chunk, unless a single document is longer: compressed under half a megabyte, from which on the JVM's collector takes objects as very large.
CHUNK_BYTES = 1 << 20
#: Rows of a sketch, bytes of text for each of a row's cells, some eleven cells an anchor, and cells of a shard at most.
ROWS, CELL_BYTES, SHARD_CELLS = 2, 8, 1 << 26

_CHUNK = "chunk long, ids array<long>, begin array<long>, body binary"
_ASK1 = "chunk long, shard int, cells binary, twice binary"
_ASK2 = "chunk long, shard int, keys binary, more binary, twice binary"
_ANSWER = "chunk long, shard int, bits binary"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def _chunks(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for k, (rows, piece) in enumerate(pieces(batches, text_col, CHUNK_BYTES)):
            yield _batch(_CHUNK, [(TaskContext.get().partitionId() << 32 | k, rows.column(id_col).to_pylist(), piece.begin, press.compress(piece.buf.tobytes()))])

    return run


def _opened(row: dict) -> Piece:
    return Piece(np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8), np.array(row["begin"], np.int64))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have :][:n])


def _anchors(w: Words, start: np.ndarray, width: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors, one for each place, and for each window which it is."""
    grams = spans(w.hash, run)
    mask = np.uint64((1 << len(grams).bit_length()) - 1)
    key = _least((grams & ~mask) | np.arange(len(grams), dtype=np.uint64), width - run + 1)[start]
    place = (key & mask).astype(np.int64)
    fresh = np.ones(len(place), bool)
    fresh[1:] = place[1:] != place[:-1]
    return mix(grams[place[fresh]]), np.cumsum(fresh) - 1


class _Keys:
    """Distinct keys of a chunk, cut by shard, and the way back."""

    def __init__(self, keys: np.ndarray, more: np.ndarray | None, shards: int):
        order = np.argsort(keys, kind="stable")
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[order][1:] != keys[order][:-1]
        if more is not None:
            other = more[order][1:] != more[order][:-1]
            if (other & ~fresh[1:]).any():
                order = np.lexsort((more, keys))
                fresh[1:] = (keys[order][1:] != keys[order][:-1]) | (more[order][1:] != more[order][:-1])
        at = np.flatnonzero(fresh)
        self.keys, self.twice = keys[order][at], np.diff(np.append(at, len(keys))) > 1
        self.more = None if more is None else more[order][at]
        self.back = np.empty(len(keys), np.int64)
        self.back[order] = np.cumsum(fresh) - 1
        owner = ((self.keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        self.cut = np.searchsorted(owner, np.arange(shards + 1, dtype=np.uint64))

    def slices(self) -> Iterator[tuple[int, slice]]:
        for s in np.flatnonzero(np.diff(self.cut)):
            yield int(s), slice(self.cut[s], self.cut[s + 1])

    def answered(self, answers: list[dict]) -> np.ndarray:
        """Of each key as it was given, whether the shards say that it is repeated."""
        said = np.zeros(len(self.keys), bool)
        for a in answers or []:
            own = slice(self.cut[a["shard"]], self.cut[a["shard"] + 1])
            said[own] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=own.stop - own.start).astype(bool)
        return said[self.back]


class _Chunk:
    """Windows of a chunk, and their keys in either pass."""

    def __init__(self, row: dict, width: int, shards: int, log_cells: int):
        self.piece, self.width, self.shards, self.log_cells = _opened(row), width, shards, log_cells
        self.words = words(self.piece, "space")
        self.start, _ = starts_of(self.words.first, width)
        if len(self.start):
            anchors, self.which = _anchors(self.words, self.start, width, min(RUN, width))
        else:
            anchors, self.which = np.zeros(0, np.uint64), self.start
        self.sketch = [_Keys(mix(anchors ^ np.uint64(0x9E3779B97F4A7C15 * (2 * r + 1) % 2**64)) >> np.uint64(64 - log_cells) << np.uint64(64 - log_cells), None, shards) for r in range(ROWS)]

    def asks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By row and shard the cells that this chunk's sketch fills, ascending, and whether a cell has more than one."""
        for r, k in enumerate(self.sketch):
            for s, own in k.slices():
                yield r * self.shards + s, k.keys[own] >> np.uint64(64 - self.log_cells), k.twice[own]

    def repeated(self, answers: list[dict]) -> np.ndarray:
        """For each anchor whether the least of its cells is above one."""
        said = np.ones(len(self.sketch[0].back), bool)
        for r, k in enumerate(self.sketch):
            said &= k.answered([{"shard": a["shard"] - r * self.shards, "bits": a["bits"]} for a in answers or [] if a["shard"] // self.shards == r])
        return said

    def candidates(self, answers: list[dict]) -> tuple[np.ndarray, _Keys]:
        """Starts of the windows to count exactly, and their keys."""
        start = self.start[self.repeated(answers)[self.which]] if len(self.start) else self.start
        h = self.words.hash
        one = spans(h, self.width)[start] if len(start) else np.zeros(0, np.uint64)
        two = (spans(h, self.width, AGAIN)[start] & np.uint64(0xFFFFFFFF)).astype(np.uint32) if len(start) else np.zeros(0, np.uint32)
        return start, _Keys(one, two, self.shards)


def _ask_anchors(width: int, shards: int, log_cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            asks = _Chunk(row, width, shards, log_cells).asks()
            yield _batch(_ASK1, [(row["chunk"], s, pack(np.diff(cells, prepend=np.uint64(0))), np.packbits(twice).tobytes()) for s, cells, twice in asks])

    return run


def _sketch_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the chunks' cells of this shard; 2 stands for 2 and more."""
    asks = [(r["chunk"], r["shard"], np.cumsum(unpack(r["cells"], np.uint64)), r["twice"]) for r in _rows(batches)]
    if not asks:
        return
    least, most = min(c[0] for _, _, c, _ in asks), max(c[-1] for _, _, c, _ in asks)
    counts = np.zeros(int(most - least) + 1, np.uint8)
    for _, _, cells, twice in asks:
        # A chunk has each of its cells once.
        at = (cells - least).astype(np.int64)
        counts[at] = np.minimum(2, counts[at] + np.unpackbits(np.frombuffer(twice, np.uint8), count=len(cells)) + np.uint8(1))
    for chunk, shard, cells, _ in asks:
        yield _batch(_ANSWER, [(chunk, shard, np.packbits(counts[(cells - least).astype(np.int64)] > 1).tobytes())])


def _ask_windows(width: int, shards: int, log_cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, k = _Chunk(row, width, shards, log_cells).candidates(row["said"])
            yield _batch(_ASK2, [(row["chunk"], s, k.keys[own].tobytes(), k.more[own].tobytes(), np.packbits(k.twice[own]).tobytes()) for s, own in k.slices()])

    return run


def _exact_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk, shard, keys, more, twice, n = [], [], [], [], [], []
    for r in _rows(batches):
        chunk.append(r["chunk"])
        shard.append(r["shard"])
        keys.append(np.frombuffer(r["keys"], np.uint64))
        more.append(np.frombuffer(r["more"], np.uint32))
        twice.append(np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(keys[-1])))
        n.append(len(keys[-1]))
    if not chunk:
        return
    k = _Keys(np.concatenate(keys), np.concatenate(more), 1)
    total = np.bincount(k.back, weights=np.concatenate(twice) + 1)
    repeated = (total > 1)[k.back]
    for c, s, bits in zip(chunk, shard, np.split(repeated, np.cumsum(n)[:-1]), strict=True):
        yield _batch(_ANSWER, [(c, s, np.packbits(bits).tobytes())])


def _kept(width: int, shards: int, log_cells: int):
    schema = "id long, n_words long, n_removed long, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            c = _Chunk(row, width, shards, log_cells)
            start, k = c.candidates(row["said"])
            start = start[k.answered(row["exact"])] if len(start) else start
            w, buf = c.words, c.piece.buf
            edge = np.zeros(len(w.hash) + 1, np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + width, -1)
            stays = np.cumsum(edge[:-1]) == 0
            # Of a word that stays: its bytes and the byte after it, made a space.
            inside = table("space")[buf] != 0
            after = ~inside
            after[1:] &= inside[:-1]
            after[:1] = False
            number = np.zeros(len(buf), np.int32)
            number[w.start[1:]] = 1
            number = np.cumsum(number, out=number)
            take = (inside | after) & stays[number] if len(stays) else inside
            body = np.where(after, np.uint8(32), buf)[take].tobytes()
            cut = np.concatenate([[0], np.cumsum(take)])[c.piece.begin]
            gone = np.concatenate([[0], np.cumsum(~stays)])[w.first]
            texts = [body[a : max(a, b - 1)].decode() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield _batch(schema, list(zip(row["ids"], np.diff(w.first).tolist(), np.diff(gone).tolist(), texts, strict=True)))

    return run, schema


@any_id()
def remove_repeated(docs: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_words, n_removed, kept_text.

    A word goes if a window of ``width`` words that covers it, inside one
    document, also starts anywhere else, in the same document or another. Words
    are runs without ASCII white space, compared as they are; kept words are
    joined by one space. All windows are judged on the input, so of several
    copies none stays. Null and empty texts, and those with fewer words than a
    window, lose nothing; a null text is kept as an empty one. Rows with null
    or repeated ids are documents like any other. Other columns aren't looked at.
    """
    spark = docs.sparkSession
    chunks = stage(docs.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(_chunks(id_col, text_col), _CHUNK), "chunks")

    size = chunks.agg(F.sum(F.element_at("begin", -1))).first()[0] or 0
    log_cells = max(10, (size // CELL_BYTES).bit_length())
    shards = max(parallelism(spark), (1 << log_cells) // SHARD_CELLS)

    def gathered(asks: DataFrame, answer, name: str, parts: int) -> DataFrame:
        answers = asks.repartitionById(parts, F.col("shard")).mapInArrow(answer, _ANSWER)
        return stage(answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "bits")).alias(name)), name)

    said = gathered(chunks.select("chunk", "begin", "body").mapInArrow(_ask_anchors(width, shards, log_cells), _ASK1), _sketch_answers, "said", ROWS * shards)
    # One way at every size: were small answers broadcast, the exchange of chunks would only begin with larger inputs.
    judged = chunks.join(said.hint("merge"), "chunk", "left")
    exact = gathered(judged.select("chunk", "begin", "body", "said").mapInArrow(_ask_windows(width, shards, log_cells), _ASK2), _exact_answers, "exact", shards)
    run, schema = _kept(width, shards, log_cells)
    return judged.join(exact.hint("merge"), "chunk", "left").mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
