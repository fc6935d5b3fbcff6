"""Language identification by a string kernel.

The kernel of two texts is the normalised number of byte n-grams, of lengths 1
to 3 blended, that are present in both. Nyström landmarks stand for the
training texts; a ridge regression for each language, one against the rest, is
fitted on their kernel features. A text is scored by one product of its
presence row with the landmarks' and one with the coefficients, in batches.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.textkernel import Piece, piece_of, pieces

#: Training texts of a language, their longest size in bytes, the languages that get so many, and the bytes of all training texts, a fifth more being drawn: the bounds of what the driver gets.
TRAIN_TEXTS, TRAIN_BYTES, LANGUAGES, ALL_BYTES = 300, 1 << 16, 64, 1 << 26
#: Languages at most; from LANGUAGES on each has fewer training texts.
MOST_LANGUAGES = 512
#: Landmarks in all, of a language at least, and the ridge. Every n-gram of a landmark is looked for.
LANDMARKS, LEAST_LANDMARKS, RIDGE = 192, 3, 1e-2
#: Texts in a matrix product at most, n-grams in one, and cells of texts by n-grams.
ROWS, GRAMS, CELLS = 128, 1 << 13, 1 << 20

#: Letters, and numbers that aren't decimal digits, such as a half.
_WORDY = re.compile(r"[^\W\d_]")


def _lettered(text: str | None) -> bool:
    return text is not None and any(m.group().isalpha() for m in _WORDY.finditer(text))


def _fold() -> np.ndarray:
    """A-Z lower-cased; other ASCII that isn't a letter is a space."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    ascii_letter = (t >= 97) & (t <= 122)
    t[(t < 128) & ~ascii_letter] = 32
    return t


FOLD = _fold()


def _codes(piece: Piece) -> Iterator[np.ndarray]:
    """Codes of the n-grams from each byte on, for n = 1, 2, 3; 0 if one would leave its document."""
    b = FOLD[piece.buf].astype(np.uint32)
    b[piece.begin[1:] - 1] = 0
    yield b
    two = (b[:-1] << 8 | b[1:]) * ((b[:-1] > 0) & (b[1:] > 0))
    yield two
    yield (two[:-1] << 8 | b[2:]) * ((two[:-1] > 0) & (b[2:] > 0))


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]
    #: By landmark the presence of each n-gram, as packed bits.
    landmarks: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.uint8))
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def width(self) -> int:
        return sum(map(len, self.grams))

    def tables(self) -> list[np.ndarray]:
        """By n and code the place among the n-grams that are looked for, or the place after the last."""
        if self.key not in _TABLES:
            _TABLES.clear()
            total, base, out = self.width, 0, []
            for n, g in enumerate(self.grams, 1):
                t = np.full(1 << 8 * n, total, np.min_scalar_type(total))
                t[g] = np.arange(base, base + len(g))
                base += len(g)
                out.append(t)
            _TABLES[self.key] = out
        return _TABLES[self.key]

    def presence(self, piece: Piece) -> np.ndarray:
        width = self.width + 1
        row = np.repeat(np.arange(piece.docs), np.diff(piece.begin)) * width
        seen = np.zeros(piece.docs * width, np.uint8)
        for t, code in zip(self.tables(), _codes(piece), strict=True):
            seen[row[: len(code)] + t[code]] = 1
        return seen.reshape(piece.docs, width)[:, :-1]

    def parts(self, piece: Piece) -> Iterator[Piece]:
        """Runs of texts whose presence has at most CELLS cells, or of one text."""
        rows = max(1, min(ROWS, CELLS // (self.width + 1)))
        for at in range(0, piece.docs, rows):
            upto = min(at + rows, piece.docs)
            yield Piece(piece.buf[piece.begin[at] : piece.begin[upto]], piece.begin[at : upto + 1] - piece.begin[at])

    def kernel(self, piece: Piece) -> np.ndarray:
        out = [np.zeros((0, len(self.landmarks)), np.float32)]
        for part in self.parts(piece):
            x, like, own = self.presence(part), np.float32(0), np.zeros(len(self.landmarks), np.int64)
            for at in range(0, self.width, GRAMS):
                marks = np.unpackbits(self.landmarks[:, at // 8 : (at + GRAMS) // 8], axis=1, count=min(GRAMS, self.width - at))
                like = like + x[:, at : at + GRAMS].astype(np.float32) @ marks.T.astype(np.float32)
                own += marks.sum(axis=1, dtype=np.int64)
            out.append((like / np.sqrt(np.maximum(1, x.sum(axis=1, dtype=np.int64)))[:, None] / np.sqrt(np.maximum(1, own))).astype(np.float32))
        return np.concatenate(out)

    def scores(self, piece: Piece) -> np.ndarray:
        return self.kernel(piece) @ self.coefficients


_TABLES: dict[str, list[np.ndarray]] = {}


def fit(texts: list[str], languages: list[str]) -> Model:
    """Fit on texts in the order given; that order decides which are landmarks."""
    names = sorted(set(languages))
    which = np.array([names.index(x) for x in languages])
    each = max(LEAST_LANDMARKS, LANDMARKS // max(1, len(names)))
    chosen = np.concatenate([np.flatnonzero(which == k)[:each] for k in range(len(names))])
    marks = piece_of(pa.array([texts[i] for i in chosen], pa.string()))
    grams = []
    for code in _codes(marks):
        found = np.unique(code).astype(np.int64)
        grams.append(found[found > 0])
    model = Model(names, grams)
    model.landmarks = np.concatenate([np.packbits(model.presence(p), axis=1) for p in model.parts(marks)])
    inner = model.kernel(marks).astype(np.float64)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate([model.kernel(piece_of(pa.array(texts[i : i + 256], pa.string()))) for i in range(0, len(texts), 256)]).astype(np.float64) @ root
    aim = np.where(which[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = (1.0 / np.bincount(which))[which][:, None]
    left = features.T @ (features * weight) + RIDGE * np.eye(features.shape[1])
    model.coefficients = (root @ np.linalg.solve(left, features.T @ (aim * weight))).astype(np.float32)
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None) -> Model:
    """Fit on a bounded sample of the labelled rows that aren't held out.

    For each label about TRAIN_TEXTS different texts, those of the least hashes
    of id and text, of at most TRAIN_BYTES bytes; of a label that has only
    longer texts, their beginnings. Rows that repeat id and text count as one,
    so any number of them may share an id or have none. With more than LANGUAGES
    labels each has so many fewer texts, and so has a label whose texts would be
    more than its share of ALL_BYTES; more than MOST_LANGUAGES labels are an
    error. Without a labelled text the model has no languages.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.coalesce(held_out, F.lit(False)).alias("held") if held_out is not None else F.lit(False).alias("held"))
    known = known.where("lang IS NOT NULL AND text != '' AND NOT held").withColumns({"short": F.octet_length("text") <= TRAIN_BYTES, "mark": F.xxhash64(F.lit(5), "id", "text")})
    brief = F.when(F.col("short"), F.col("mark"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("mark").alias("n"), F.approx_count_distinct(brief).alias("short"), F.avg(F.when(F.col("short"), F.octet_length("text"))).alias("size")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels")
    if not counts:
        return Model([], [])
    often = TRAIN_TEXTS if len(counts) <= LANGUAGES else max(1, TRAIN_TEXTS * LANGUAGES // len(counts))
    most = {r["lang"]: max(1, min(often, int(ALL_BYTES / len(counts) / (r["size"] if r["short"] else TRAIN_BYTES)))) for r in counts}
    spot = (F.pmod("mark", F.lit(1 << 40)) / float(1 << 40)).alias("spot")
    share = F.element_at(F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min(1.0, max(40.0, 1.2 * most[r["lang"]]) / max(1, r["short"] or r["n"]))))), F.col("lang"))
    long = [r["lang"] for r in counts if not r["short"]]
    picked = known.where(F.col("short") | F.col("lang").isin(long)).where(spot <= share)
    text = F.when(F.col("short"), F.col("text")).otherwise(F.substring("text", 1, TRAIN_BYTES // 4)).alias("text")
    rows = sorted(picked.select("lang", text, spot).distinct().collect(), key=lambda r: (r["spot"], r["lang"], r["text"]))
    taken: dict[str, list] = {}
    for r in rows:
        own = taken.setdefault(r["lang"], [])
        if len(own) < most[r["lang"]]:
            own.append(r["text"])
    pairs = [(t, lang) for lang, own in sorted(taken.items()) for t in own]
    if not pairs:
        return Model([], [])
    return fit([t for t, _ in pairs], [x for _, x in pairs])


def _predict(model, text_col: str, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        names = np.array([*m.languages, "und"], object)
        for rows, piece in pieces(batches, text_col, 1 << 19):
            best, score = [], []
            texts = rows.column(text_col).to_pylist()
            for at in range(0, piece.docs, ROWS):
                upto = min(at + ROWS, piece.docs)
                if not m.languages:
                    best.append(np.zeros(upto - at, np.int64))
                    score.append(np.zeros(len(best[-1])))
                    continue
                part = Piece(piece.buf[piece.begin[at] : piece.begin[upto]], piece.begin[at : upto + 1] - piece.begin[at])
                s = m.scores(part)
                k = s.argmax(axis=1)
                e = np.exp(4 * (s - s.max(axis=1, keepdims=True)))
                none = np.array([not _lettered(t) for t in texts[at:upto]], bool)
                best.append(np.where(none, len(m.languages), k))
                score.append(np.where(none, 0.0, 1 / e.sum(axis=1)))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), pa.array(names[np.concatenate(best)], pa.string()), pa.array(np.concatenate(score).astype(np.float64))], [*columns, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs``: the columns ``keep``, lang_pred, score.

    ``lang_pred`` is one of the model's languages, or ``und`` with score 0 for
    a null text or one without a letter. The score, 0 to 1, is the softmax of
    the regressions. Whole texts are read; only the text decides. A model
    without languages calls every text ``und``. What is kept is passed on as it
    is, nulls and repeated rows too, under its own names, which must not be
    those of the result.
    """
    if clash := {"lang_pred", "score"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} can't be kept")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).alias("text to read"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text to read")
    return rows.mapInArrow(_predict(sent, "text to read", list(keep)), f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs, held_out=held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
