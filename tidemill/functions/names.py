"""Name cleaning as column expressions.

Only decomposition that isn't followed by ASCII, user regexes in Python syntax,
overlapping replacement maps and number spelling need an Arrow UDF; the rest is
native.
"""

from __future__ import annotations

import logging
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# Transliteration of Greek letters.
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "h", "θ": "th",
    "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p",
    "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "f", "χ": "ch", "ψ": "ps",
    "ω": "o", "ά": "a", "έ": "e", "ί": "i", "ό": "o", "ύ": "u", "ή": "h", "ώ": "o",
    "Α": "A", "Β": "B", "Γ": "G", "Δ": "D", "Ε": "E", "Ζ": "Z", "Η": "H", "Θ": "TH",
    "Ι": "I", "Κ": "K", "Λ": "L", "Μ": "M", "Ν": "N", "Ξ": "X", "Ο": "O", "Π": "P",
    "Ρ": "R", "Σ": "S", "Τ": "T", "Υ": "Y", "Φ": "F", "Χ": "CH", "Ψ": "PS", "Ω": "O",
    "Ά": "A", "Έ": "E", "Ί": "I", "Ό": "O", "Ύ": "Y", "Ή": "H", "Ώ": "O",
}

# Other names of cases and of what to do with numerals.
CASES = {
    "snake": ("snake", "snake_case", "snakecase", "sc", "s"), "camel": ("camel", "camelcase", "cc"), "pascal": ("pascal", "pascalcase", "pc"),
    "kebab": ("kebab", "kebab-case", "kc"), "space": ("space", "sp"), "title": ("title", "t"), "upper": ("upper", "u"), "lower": ("lower", "l"),
    "sentence": ("sentence", "sent"), "old_janitor": ("old_janitor",),
}
NUMERALS = {"asis": ("asis", "as-is", "keep", "k"), "remove": ("remove", "rm", "strip"), "spell": ("spell", "words", "w")}
REPLACE = {"'": "", '"': "", "%": "_percent_", "#": "_number_"}
STEPS = {"latin": ("nfkd", "normalize", "latin"), "ascii": ("ascii",), "greek": ("greek", "el"), "cyrillic": ("cyrillic", "ru", "uk", "bg")}

WHITE = r"[\s\x1c-\x1f\x85\p{Z}]"
NO_SPELLER = "ModuleNotFoundError: spelling numerals needs num2words or a speller"


def _named(value: str, table: Mapping[str, tuple]) -> str:
    key = (value or "").strip().lower()
    return next((name for name, others in table.items() if key in others), value)


def steps_of(spec: str | Sequence[str]) -> list[str]:
    parts = [str(x) for x in spec] if not isinstance(spec, str) else re.split(r"[\s,|+;-]+", spec)
    return [_named(p.strip().lower(), STEPS) for p in parts if p.strip()]


def _java(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def separator_pattern(sep_in: str | Sequence[str] | None) -> str:
    """A Java regex for one separator."""
    if sep_in is None:
        return r"[\.]"
    if isinstance(sep_in, str):
        inner = sep_in if "\\" in sep_in else _java(sep_in)
        if not inner:
            raise ValueError("sep_in is empty")
        return f"[{inner}]"
    seps = sorted((str(s) for s in sep_in if str(s)), key=len, reverse=True)
    return f"(?:{'|'.join(map(_java, seps))})" if seps else r"[\.]"


def _each(function: Callable[[str], str]):
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(function, na_action="ignore")

    return run


def replaced(c: Column, table: Mapping[str, str], regex: bool = False) -> Column:
    """Literal keys in one pass, the first given first; or Python regexes, one after the other."""
    if not table:
        return c
    if regex:
        rules = [(re.compile(k), v) for k, v in table.items()]

        def by_rule(s: str) -> str:
            for k, v in rules:
                s = k.sub(v, s)
            return s

        return _each(by_rule)(c)
    if all(len(k) == 1 for k in table) and not any(k in v for k in table for v in table.values()):
        for k, v in table.items():
            c = F.replace(c, F.lit(k), F.lit(v))
        return c
    keys, values = re.compile("|".join(map(re.escape, table))), dict(table)
    return _each(lambda s: keys.sub(lambda m: values[m[0]], s))(c)


def _folded(s: str, steps: tuple[str, ...]) -> str:
    greek = str.maketrans(GREEK)
    for step in steps:
        s = s.translate(greek) if step == "greek" else unicodedata.normalize("NFKD", s)
        if step == "ascii":
            s = s.encode("ascii", "ignore").decode()
    return s


@cache
def _ascii_of(steps: tuple[str, ...]) -> tuple[dict[str, str], dict[str, str]]:
    """Characters that the steps turn into one ASCII character, and into several.

    With an ASCII step each character stands for itself: decomposition only
    reorders marks, which ASCII hasn't.
    """
    found = {c: _folded(c, steps) for c in map(chr, range(128, sys.maxunicode + 1)) if c in GREEK or unicodedata.decomposition(c)}
    return {c: x for c, x in found.items() if len(x) == 1}, {c: x for c, x in found.items() if len(x) > 1}


def _to_ascii(c: Column, steps: tuple[str, ...]) -> Column:
    one, more = _ascii_of(steps)
    beyond = r"[^\x00-\x7F]"
    turned = F.translate(c, "".join(one), "".join(one.values()))
    table = F.create_map(*(F.lit(x) for kv in more.items() for x in kv))
    spelled = F.array_join(F.transform(F.split(turned, ""), lambda x: F.when(x.rlike(beyond), F.coalesce(F.try_element_at(table, x), x)).otherwise(x)), "")
    # The few characters beyond ASCII are asked, not the whole text.
    several = F.regexp_replace(turned, r"[\x00-\x7F]+", "").rlike(f"[{''.join(more)}]")
    return F.when(c.rlike(beyond), F.regexp_replace(F.when(several, spelled).otherwise(turned), f"{beyond}+", "")).otherwise(c)


def transliterated(c: Column, steps: Iterable[str]) -> Column:
    """NFKD, ASCII and Greek steps; Cyrillic needs a library that isn't there and is passed over, as is an unknown step."""
    known = tuple(s for s in steps if s in ("latin", "ascii", "greek"))
    if other := [s for s in steps if s not in known]:
        log.warning("transliteration steps passed over: %s", other)
    if not known:
        return c
    if "ascii" in known:
        return _to_ascii(c, known)
    return _each(lambda s: s if s.isascii() else _folded(s, known))(c)


def title(c: Column) -> Column:
    """A letter after anything but a letter is upper case, any other lower."""
    chars = F.split(c, "")
    up = lambda x, i: F.when((i == 0) | ~F.coalesce(F.try_element_at(chars, i), F.lit("")).rlike(r"\p{L}"), F.upper(x)).otherwise(F.lower(x))
    return F.array_join(F.transform(chars, up), "")


def _snake(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", ""), f"{WHITE}+", "_")
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), "__+", "_"))


def cased(c: Column, case: str) -> Column:
    joined = lambda x: F.replace(title(_snake(x)), F.lit("_"), F.lit(""))
    head = lambda x, f: F.concat(f(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))
    swap = lambda x, to: F.replace(x, F.lit("_"), F.lit(to))
    ways = {
        "snake": _snake, "pascal": joined, "camel": lambda x: head(joined(x), F.lower), "kebab": lambda x: swap(F.lower(x), "-"), "space": lambda x: swap(F.lower(x), " "),
        "title": lambda x: F.replace(title(swap(x, " ")), F.lit(" "), F.lit("_")), "upper": F.upper, "lower": F.lower, "sentence": lambda x: F.replace(head(F.lower(x), F.upper), F.lit(" "), F.lit("_")),
    }
    if case not in ways:
        raise ValueError(f"unknown case {case!r}")
    return ways[case](c)


def numbered_repeats(parts: Column) -> Column:
    """The second and later of equal parts get _2, _3, and so on."""
    nothing = F.array().cast("array<string>")

    def add(state: Column, x: Column) -> Column:
        n = F.size(F.filter(state["seen"], lambda y: y == x)) + 1
        named = F.when(n > 1, F.concat(x, F.lit("_"), n.cast("string"))).otherwise(x)
        return F.struct(F.concat(state["seen"], F.array(x)).alias("seen"), F.concat(state["out"], F.array(named)).alias("out"))

    return F.aggregate(parts, F.struct(nothing.alias("seen"), nothing.alias("out")), add, lambda s: s["out"])


def _valid(c: Column, numerals: str, speller: Callable[[int], str] | None) -> Column:
    if numerals == "asis":
        spelled = _each(lambda s: re.sub(r"\s", "_", speller(int(s))) if re.fullmatch(r"\d+", s) else s)(c) if speller else F.raise_error(F.lit(NO_SPELLER))
        c = F.when(c.rlike(r"^\p{Nd}+$"), spelled).otherwise(c)
    return F.regexp_replace(F.regexp_replace(c, "^[^a-zA-Z0-9]+", ""), f"{WHITE}+", "_")


def clean_name(
    column: str | Column, case: str = "snake", replace: Mapping[str, str] | None = None, ascii: bool = True, use_make_names: bool = True, allow_dupes: bool = False, sep_in: str | Sequence[str] | None = r"\.",
    transliterations: str | Sequence[str] = "Latin-ASCII", parsing_option: int | str = 1, numerals: str = "asis", sep_out: str = ".", replace_regex: bool = False, transliterate: bool | None = None,
    speller: Callable[[int], str] | None = None,
) -> Column:
    """The cleaned name; null stays null.

    In order: replacements, transliteration, separators, numerals, validity,
    case of each segment, and numbering of repeated segments.
    """
    case, numerals = _named(case, CASES), _named(numerals, NUMERALS)
    c = F.col(column) if isinstance(column, str) else column
    c = c.cast("string")
    if case == "old_janitor":
        c = _valid(replaced(c, {"'": "", '"': "", "%": "percent", "#": "number"}), numerals, speller)
        c = F.regexp_replace(F.lower(F.regexp_replace(F.regexp_replace(c, r"\.+", "_"), "_+", "_")), "_$", "")
        return c if allow_dupes else F.array_join(numbered_repeats(F.split(c, "_")), "_")
    c = replaced(c, REPLACE if replace is None else replace, replace_regex)
    if ascii if transliterate is None else transliterate:
        c = transliterated(c, steps_of(transliterations))
    option = parsing_option if isinstance(parsing_option, int) else int(parsing_option) if str(parsing_option).strip().isdigit() else 1
    if option == 1:
        one = separator_pattern(sep_in)
        c = F.regexp_replace(F.regexp_replace(c, f"^{WHITE}+", ""), f"^(?:{one})+", "")
        c = F.regexp_replace(c, f"(?:{one})+", _java(sep_out) if sep_out else "")
    if numerals == "remove":
        c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{Nd}+", ""), "_$", ""), f"{WHITE}+$", "")
    elif numerals == "spell":
        if speller is None:
            raise ModuleNotFoundError(NO_SPELLER)
        c = _each(lambda s: re.sub(r"\d+", lambda m: speller(int(m[0])).replace(" ", "_"), s))(c)
    if use_make_names:
        c = _valid(c, numerals, speller)
    own = sep_out or "."
    segments = F.split(c, _java(own), -1) if sep_out else F.array(c)
    c = F.array_join(F.transform(segments, lambda x: cased(x, case)), sep_out)
    return c if allow_dupes else F.array_join(numbered_repeats(F.split(c, _java(own), -1)), own)


def clean_names_table(df: DataFrame, column: str, skip_none: bool = False, **options) -> DataFrame:
    """``(original, renamed)``; a null is an empty name, or left out with ``skip_none``."""
    rows = df.where(F.col(column).isNotNull()) if skip_none else df
    original = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return rows.select(original.alias("original"), clean_name(original, **options).alias("renamed"))


def clean_names(string, **options) -> str:
    """One name, on the active session; a list is a ValueError."""
    if isinstance(string, (list, tuple, set)):
        raise ValueError("clean_names takes one name; use clean_names_table")
    text, replace = str(string), options.get("replace")
    for micro in "\u00b5\u03bc":
        if micro in text and not any(micro in key for key in (REPLACE if replace is None else replace)):
            log.warning("%r has a micro sign (%s) that no replacement covers", text, micro)
    try:
        out = SparkSession.active().range(1).select(clean_name(F.lit(text), **options)).first()[0]
    except Exception as e:
        if NO_SPELLER in str(e):
            raise ModuleNotFoundError(NO_SPELLER) from e
        raise
    if left := sorted({c for c in out if not c.isascii()}):
        log.warning("characters that were neither transliterated nor removed: %r", "".join(left))
    return out


def left_over(df: DataFrame, column: str) -> DataFrame:
    """``(character, rows)``: characters beyond ASCII that a column still has, and in how many rows."""
    chars = F.array_distinct(F.filter(F.split(F.col(column), ""), lambda x: x.rlike(r"[^\x00-\x7F]")))
    return df.select(F.explode(chars).alias("character")).groupBy("character").agg(F.count("*").alias("rows"))


def rename_columns(df: DataFrame, **options) -> DataFrame:
    """The table with cleaned column names."""
    return df.withColumnsRenamed({c: clean_names(c, **options) for c in df.columns})
