"""Column expressions that everything else is composed of. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading and trailing white space, as a pattern: SQL's trim takes spaces only.
EDGE_SPACE = r"(?U)^\s+|\s+$"
_NUMBER_PREFIX = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(text: Column) -> Column:
    return let(text, lambda t: F.when(t != "", t))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where nothing matches or the group is empty."""
    return blank_to_null(F.regexp_extract(text, pattern, group))


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def sqlite_float(text: Column) -> Column:
    """Casts by numeric prefix, never failing: '12abc' is 12, 'abc' and '' are 0, null stays null."""
    number = F.regexp_extract(text, _NUMBER_PREFIX, 1).try_cast("double")
    return F.when(text.isNotNull(), F.coalesce(number, F.lit(0.0)))


def half_even(value: Column, digits: int) -> Column:
    """Rounds ties to even."""
    return F.bround(value, digits)


def without_commas(text: Column) -> Column:
    return strip(F.replace(text, F.lit(","), F.lit("")))


def contains_any(lowered: Column, words: Iterable[str]) -> Column:
    return reduce(Column.__or__, (lowered.contains(w) for w in words))


def hits(lowered: Column, words: Sequence[str]) -> Column:
    """How many entries of the list occur as substrings; a repeated entry counts again."""
    return reduce(Column.__add__, (lowered.contains(w).cast("int") for w in words))


def token_hits(tokens: Column, words: Sequence[str]) -> Column:
    """How many of the distinct words occur among the tokens."""
    return F.size(F.array_intersect(tokens, F.array(*(F.lit(w) for w in dict.fromkeys(words)))))


def best_label(scores: Sequence[tuple[str, Column]]) -> Column:
    """(score, label) of the greatest score; of equal ones the first."""
    ranked = F.array_max(F.array(*(F.struct(score.cast("int").alias("score"), F.lit(-i).alias("place"), F.lit(label).alias("label")) for i, (label, score) in enumerate(scores))))
    return let(ranked, lambda r: F.struct(r["score"].alias("score"), r["label"].alias("label")))


def longest_contained(lowered: Column, names: Sequence[str], shown=lambda name: name) -> Column:
    """The longest of the names that occurs; of equally long ones the first. Null if none does."""
    ranked = sorted(names, key=lambda name: -len(name))
    return F.coalesce(*(F.when(lowered.contains(name.lower()), F.lit(shown(name))) for name in ranked))


def truthy(value: Column) -> Column:
    """Neither null nor empty."""
    return value.isNotNull() & (value != "")


def first_of_each(items: Column, keys: Column, key: str) -> Column:
    """Structs of an array without those whose key occurred before; order stays. `keys` has the key of each."""
    return F.filter(items, lambda x, i: F.array_position(keys, x[key]) == i + 1)
