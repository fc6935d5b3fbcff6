"""Items in free text: splitting, normalising, document frequency. All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unit words and vulgar fractions.
UNITS = [
    "cup", "cups", "tbsp", "tablespoon", "tablespoons", "tsp", "teaspoon", "teaspoons", "oz", "ounce", "ounces", "g", "gram", "grams", "kg",
    "kilogram", "kilograms", "ml", "milliliter", "milliliters", "l", "liter", "liters", "lb", "lbs", "pound", "pounds", "pinch", "pinches", "dash",
    "dashes", "quart", "quarts", "qt", "qts", "pint", "pints", "slice", "slices", "clove", "cloves", "can", "cans", "package", "packages", "inch",
    "inches", "cm", "centimeter", "centimeters", "mm", "millimeter", "millimeters", "meter", "meters", "stick", "sticks", "bunch", "bunches", "sprig",
    "sprigs", "piece", "pieces", "handful", "handfuls", "drop", "drops", "sheet", "sheets",
]
FRACTIONS = "¼½¾⅐⅑⅒⅓⅔⅕⅖⅗⅘⅙⅚⅛⅜⅝⅞"

WORD, WHITE, DIGIT = r"[\p{L}\p{N}_]", r"[\s\x1c-\x1f\x85\p{Z}]", r"\p{Nd}"


def _amounts() -> list[str]:
    """Amounts: mixed and plain fractions, ranges, vulgar fractions, each on its own or glued to a word.

    The eight kinds and their order are fixed: each is taken out before the next is looked for.
    """
    number, gap = f"{DIGIT}+", f"{WHITE}*"
    over = f"{number}{gap}/{gap}{number}"
    alone, glued = f"(?!{WORD})", f"(?={WORD})"
    span = f"{number}{gap}(?:to|[-–—]){gap}{number}"
    vulgar = f"{DIGIT}*[{FRACTIONS}]+"
    ends = [(f"{number}{gap}-{gap}{over}", alone), (f"{number}{WHITE}+{over}", alone), (over, alone), (over, glued), (span, alone), (span, glued), (vulgar, alone), (vulgar, glued)]
    return [f"(?<!{WORD}){body}{end}" for body, end in ends]


def split_items(c: Column) -> Column:
    """Parts between commas, semicolons, bars, line feeds, or a slash in white space; trimmed, none empty."""
    parts = F.split(c, rf"[,\n;|]+|{WHITE}+/{WHITE}+")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, f"^{WHITE}+|{WHITE}+$", "")), lambda x: x != "")


def normalize_item(c: Column) -> Column:
    """Lower case, without amounts, punctuation and units; empty if nothing else is left; null is empty.

    A number of one or two digits stays beside words, unless a unit is next to it.
    """
    c = F.lower(F.coalesce(c, F.lit("")))
    for pattern in _amounts():
        c = F.regexp_replace(c, pattern, " ")
    c = F.regexp_replace(F.replace(c, F.lit("_"), F.lit(" ")), rf"[^\p{{L}}\p{{N}}\s\x1c-\x1f\x85\p{{Z}}]+", " ")
    tokens = F.filter(F.split(c, f"{WHITE}+"), lambda x: x != "")
    lettered = lambda x: x.rlike(r"\p{L}")
    unit = lambda x: F.coalesce(x, F.lit("")).isin(UNITS)

    def kept(ts: Column) -> Column:
        named = F.exists(ts, lambda x: lettered(x) & ~unit(x))
        beside = lambda i: unit(F.try_element_at(ts, i)) | unit(F.try_element_at(ts, i + 2))
        small = lambda x, i: x.rlike(rf"^{DIGIT}{{1,2}}$") & ~F.when(i > 0, beside(i)).otherwise(unit(F.try_element_at(ts, F.lit(2))))
        # Without a word that isn't a unit nothing stays.
        return F.when(named, F.filter(ts, lambda x, i: F.when(lettered(x), ~unit(x)).otherwise(small(x, i)))).otherwise(F.array().cast("array<string>"))

    return F.array_join(kept(tokens), " ")


def items_of(df: DataFrame, column: str) -> Column:
    """Normalised items of a cell, an array: a string is split; arrays and maps give their values; others are one item."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.MapType):
        kind, c = T.ArrayType(kind.valueType), F.map_values(c)
    if isinstance(kind, T.ArrayType):
        cells = F.transform(c, lambda x: x.cast("string"))
        parts = F.flatten(F.transform(cells, lambda x: F.coalesce(split_items(x), F.array().cast("array<string>")))) if isinstance(kind.elementType, T.StringType) else cells
    elif isinstance(kind, T.StringType):
        parts = split_items(c)
    else:
        parts = F.array(c.cast("string"))
    return F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), normalize_item), lambda x: x != "")


def document_frequency(df: DataFrame, column: str) -> DataFrame:
    """``(item, rows, freq)``: the share, as a float, of the rows with items that have the item."""
    held = df.select(F.array_distinct(items_of(df, column)).alias("items")).where(F.size("items") > 0)
    used = held.agg(F.count("*").alias("used"))
    counts = held.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("rows"))
    return counts.join(F.broadcast(used)).select("item", "rows", (F.col("rows") / F.col("used")).cast("float").alias("freq"))


def row_counts(df: DataFrame, column: str) -> DataFrame:
    """``(rows_total, rows_used, unique_items)``."""
    held = df.select(items_of(df, column).alias("items"))
    unique = held.select(F.explode("items").alias("item")).agg(F.count_distinct("item").alias("unique_items"))
    return held.agg(F.count("*").alias("rows_total"), F.count_if(F.size("items") > 0).alias("rows_used")).join(F.broadcast(unique))
