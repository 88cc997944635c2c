"""String, array and level expressions.  All of them stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from logvigil.constants import LEVELS

# everything Python's str.strip() removes, as a Java character class and as single characters
BLANK = r"[\p{IsWhite_Space}\x1C-\x1F]"
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only the space character.

    A trim looks at the ends only; a pattern for the end is tried at each character.
    """
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Turn each run of white space into one space and trim the ends."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    """True when any term occurs in ``c``; false, never null."""
    pattern = "|".join(re.escape(t) for t in terms)
    return F.coalesce(c.rlike(pattern), F.lit(False))


def flag_list(pairs: Iterable[tuple[Column, Column | str]]) -> Column:
    """Array of the values whose condition holds, in the given order.

    The nulls go by array_except, which unlike array_compact is compiled.
    """
    items = [F.when(cond, F.lit(value)) for cond, value in pairs]
    return F.array_except(F.array(*items), F.array(F.lit(None).cast("string")))


def level_rank(c: Column) -> Column:
    """0..4 for an exact level name, 0 for anything else."""
    place = F.array_position(F.array(*[F.lit(n) for n in LEVELS]), strip(c))
    return F.greatest(F.coalesce(place, F.lit(0)) - 1, F.lit(0)).cast("int")


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in LEVELS]), (rank + 1).cast("int"))


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed once, however often they are used later.

    Spark writes a projected column out again wherever a later filter or
    projection names it; the rows of a generator it leaves alone.  Filters on
    the other columns still move below it.
    """
    fresh = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], fresh)


def tidy_level(c: Column) -> Column:
    """Level name whatever its letter case; unknown or missing becomes None."""
    names = F.create_map(*[F.lit(x) for n in LEVELS for x in (n.lower(), n)])
    return F.coalesce(F.try_element_at(names, F.lower(strip(c))), F.lit("None"))


def first_seen(values: Column) -> Column:
    """Drop repeats from an array ignoring letter case; the first spelling stays."""
    lowered = F.transform(values, F.lower)
    return F.filter(values, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)
