"""Sentiment and emotion by word, with lexicons as tables and models as injected functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.order import number
from tidemill.staging import stage

# Emotions of words.
EMOTIONS = {
    "happy": "joy", "sad": "sadness", "amazing": "surprise", "terrible": "anger", "excited": "joy", "depressed": "sadness", "shocked": "surprise", "furious": "anger",
    "delighted": "joy", "miserable": "sadness", "astonished": "surprise", "irritated": "anger", "calm": "peace", "anxious": "fear", "confident": "trust", "disgusted": "disgust",
}
CATEGORIES = ("Negative", "Neutral", "Positive")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def category(score: Column) -> Column:
    """Up to -0.5 negative, up to 0.5 neutral, above positive; null, NaN and minus infinity have none."""
    void = score.isNull() | F.isnan(score) | (score == float("-inf"))
    return F.when(void, None).when(score <= -0.5, CATEGORIES[0]).when(score <= 0.5, CATEGORIES[1]).otherwise(CATEGORIES[2])


def detect(df: DataFrame, columns: Sequence[str], lexicon: DataFrame | None = None, word_model: Callable[[Column], Column] | None = None, text_model: Callable[[Column], Column] | None = None, id_col: str | None = None, batch: int | None = None) -> DataFrame:
    """A row for each word: word, sentiment_score, emotion, text_index, source_column, overall_sentiment, sentiment_category.

    ``lexicon(word, score)`` scores cleaned words, 0 for one it lacks; a
    ``word_model`` scores them instead. ``text_model`` scores whole texts, 0
    without one. ``text_index`` is ``id_col`` or the row's number; with
    ``batch`` the first number of its batch. Null texts have no words.
    """
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no columns {missing}")
    if not id_col:
        # Consecutive numbers in the order of files; a partition's own numbers would leave gaps that batches don't have.
        df, id_col = number(stage(df.withColumn("_tm_row", F.monotonically_increasing_id()), "rows"), [F.col("_tm_row")], "_tm_index"), "_tm_index"
    index = F.col(id_col).cast("long")
    if batch:
        index = (F.floor(index / batch) * batch).cast("long")
    cells = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(c).alias("source_column"), F.col(f"`{c}`").cast("string").alias("text")) for k, c in enumerate(columns)))
    texts = df.select(index.alias("text_index"), F.explode(cells).alias("cell")).select("text_index", "cell.*").where("text IS NOT NULL")
    texts = texts.withColumn("overall_sentiment", text_model(F.col("text")) if text_model else F.lit(0.0))
    white = r"[\s\x1c-\x1f\x85\p{Z}]+"
    words = texts.select("text_index", "source_column", "overall_sentiment", F.explode(F.filter(F.split("text", white), lambda w: w != "")).alias("word"))
    words = words.withColumn("clean", F.lower(F.btrim("word", F.lit(PUNCTUATION))))
    if word_model:
        words = words.withColumn("sentiment_score", word_model(F.col("clean")))
    elif lexicon is not None:
        words = words.join(lexicon.select(F.col("word").alias("clean"), F.col("score").cast("double").alias("s")), "clean", "left").withColumn("sentiment_score", F.coalesce("s", F.lit(0.0)))
    else:
        words = words.withColumn("sentiment_score", F.lit(0.0))
    emotion = F.try_element_at(F.create_map(*(F.lit(x) for kv in EMOTIONS.items() for x in kv)), F.col("clean"))
    return words.select("word", "sentiment_score", emotion.alias("emotion"), "text_index", "source_column", "overall_sentiment", category(F.col("sentiment_score")).alias("sentiment_category"))


def distribution(df: DataFrame, column: str, every: Sequence[str] = ()) -> DataFrame:
    """``(value, share)`` of what isn't null; values of ``every`` that don't occur have 0."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    if every:
        names = df.sparkSession.createDataFrame([(x,) for x in every], "value string")
        counts = names.join(counts, "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("value", F.coalesce(F.try_divide("n", "total"), F.lit(0.0)).alias("share"))


def extremes(df: DataFrame, column: str, k: int = 5, largest: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """The k rows with the largest or smallest values; null and NaN have none; ties by the columns given."""
    held = df.where(F.col(column).isNotNull() & ~F.isnan(column))
    return held.orderBy(F.desc(column) if largest else F.asc(column), *ties).limit(k)
