"""The pipeline from raw documents to shards.

STAGES lists (name, function); each function takes (spark, docs, sf_dir). All
but the last give rows with the columns of ``documents``. Every stage's result
is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.decontaminate import decontaminate
from tidemill.llm.jaccard_join import near_duplicates
from tidemill.llm.language_id import held_out, identify, train
from tidemill.llm.mixing import mix
from tidemill.llm.sharding import shard
from tidemill.staging import portable, stage

#: Keys of rows to drop that may be sent to every executor: 8 bytes each. More are joined by a shuffle.
MOST_SENT = 1 << 20

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ROW = "row of the stage"


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a column that tells them apart: doc_id if it does, else a number that is written with them."""
    n, known, distinct = docs.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == known == distinct:
        return docs, "doc_id"
    return stage(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows"), ROW


def _without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among ``gone``; they are dropped where they are read if these are counted to be few."""
    gone = stage(gone.select(key).distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= MOST_SENT else gone, key, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those whose text is null or has no letter go.

    Equal texts get equal answers. Repeated rows stay as often as they came, and
    null ids, labels and sources are kept as they are. Without a labelled text
    nothing can be rejected, so that all rows stay.
    """
    docs = docs.select(*COLUMNS)
    model = train(docs, held_out=held_out())
    found = identify(docs, model, keep=COLUMNS)
    return (found.where("lang_pred != 'und'") if model.languages else found).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Where ids are null or repeated, rows are numbered and the smallest number
    stays. Texts that are null or have no words are linked with nothing and stay.
    """
    docs, key = _numbered(docs.select(*COLUMNS))
    gone = near_duplicates(docs, id_col=key).where(f"component_id != `{key}`").select(key)
    return _without(docs, gone, key).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark, each row judged on its own.

    Null and empty texts are clean and stay; ids may be null or repeated.
    """
    docs, key = _numbered(docs.select(*COLUMNS))
    judged = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return _without(docs, judged.where("contaminated"), key).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts that are null or have no words aren't taken; a null source is a source.
    """
    docs, key = _numbered(docs.select(*COLUMNS))
    taken = mix(docs, id_col=key).where("copies > 0").select(key, "copies")
    return docs.join(taken, key).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row; equal texts, so all copies of a document, share a shard."""
    return shard(docs)


STAGES = [(f.__name__, portable(f)) for f in (language, near_duplicate, decontamination, mixing, sharding)]

#: The string kernel, the random duels and the differencing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
