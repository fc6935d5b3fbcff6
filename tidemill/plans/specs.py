"""Column lists, keys, picks and modes as users write them; nothing here runs a job."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

ColumnSpec = str | Iterable[str] | None

_LINK = re.compile(r"\s*(?:any|or|link)\s*[: ]\s*(\S.*)", re.IGNORECASE | re.DOTALL)
# What names of identifiers have.
_IDENTITY = re.compile(
    r"(email|e[-_ ]?mail|phone|mobile|msisdn|uuid|guid|identifier|external[_ ]?id|customer[_ ]?id|user[_ ]?id|account[_ ]?id|(^|[_ ])id($|[_ ]))",
    re.IGNORECASE,
)
_STRONG_IDENTITY = re.compile(r"(uuid|guid|(^|[_ ])id($|[_ ]))", re.IGNORECASE)

# Other names of arguments and their values.
ACTIONS = {"remove": "remove", "rm": "remove", "drop": "remove", "delete": "remove", "flag": "flag", "mark": "flag", "tag": "flag"}
MODES = {"auto": "auto", "a": "auto", "collapse": "collapse", "c": "collapse", "one": "collapse", "within": "within", "w": "within"}
PICKS = {"first": "first", "head": "first", "keep_first": "first", "last": "last", "tail": "last", "keep_last": "last", "random": "random", "rand": "random"}
ALIASES = {"on": ("subset", "cols"), "group_by": ("by", "group"), "entity_by": ("ids", "entity"), "block_by": ("block",), "pick": ("keep",)}


def unique(names: Iterable[str]) -> list[str]:
    """In order of first appearance."""
    return list(dict.fromkeys(names))


def split_names(text: str) -> list[str]:
    """Names parted by commas, bars or white space."""
    return unique(x for x in re.split(r"[,|\s]+", text.strip()) if x)


def resolve(spec: ColumnSpec, columns: Sequence[str], name: str, exclude: bool = False) -> list[str] | None:
    """Names of ``columns``: None stays None; "", "*" and "all" mean all; "-a b" and "!a b" all but these."""
    if spec is None:
        return None
    if isinstance(spec, str):
        text = spec.strip()
        if text.lower() in ("", "*", "all"):
            return list(columns)
        without = exclude and text[0] in "-!"
        wanted = split_names(text[1:] if without else text)
    else:
        without, wanted = False, [str(x) for x in spec]
    if unknown := [x for x in wanted if x not in columns]:
        raise ValueError(f"{name}: no such columns: {unknown}")
    return [c for c in columns if c not in wanted] if without else wanted


@dataclass(frozen=True)
class Key:
    kind: str
    columns: list[str]


def parse_key(on: ColumnSpec, columns: Sequence[str]) -> Key:
    """``exact``: all columns equal; ``any``: linked by any of them."""
    if isinstance(on, str) and (link := _LINK.fullmatch(on)):
        found = resolve(link[1], columns, "on(any)")
        return Key("any", found)
    found = resolve(on, columns, "on", exclude=True)
    if found is not None and not found:
        raise ValueError("on names no column")
    return Key("exact", list(columns) if found is None else found)


@dataclass(frozen=True)
class Pick:
    kind: str
    column: str | None = None
    function: Callable | None = None


def parse_pick(pick: str | Callable, columns: Sequence[str]) -> Pick:
    if callable(pick):
        return Pick("custom", function=pick)
    text = str(pick).strip()
    if text.lower() in PICKS:
        return Pick(PICKS[text.lower()])
    kind, colon, column = text.partition(":")
    if colon and kind.lower() in ("max", "min") and column.strip():
        if column.strip() not in columns:
            raise ValueError(f"pick: no column {column.strip()!r}")
        return Pick(kind.lower(), column.strip())
    raise ValueError("pick is first, last, random, max:<column>, min:<column> or a callable")


def one_of(value: str, names: dict[str, str], what: str) -> str:
    key = str(value).strip().lower()
    if key not in names:
        raise ValueError(f"{what} is one of {sorted(set(names.values()))}")
    return names[key]


def fold_aliases(given: dict, aliases: dict) -> dict:
    """Other names of arguments; one beside the argument itself, or an unknown one, is a TypeError."""
    left = dict(aliases)
    for name, others in ALIASES.items():
        free = given[name] == "first" if name == "pick" else given[name] is None
        for other in others:
            if other in left and free:
                given[name], free = left.pop(other), False
    if left:
        raise TypeError(f"unexpected arguments: {sorted(left)}")
    return given


def identity_columns(schema: T.StructType) -> list[str]:
    """Columns whose name tells an identifier; those that aren't strings only if it is plain."""
    return [f.name for f in schema if _IDENTITY.search(f.name) and (isinstance(f.dataType, T.StringType) or _STRONG_IDENTITY.search(f.name))]
