"""Projections: by name, by name range, by position, renames and row-wise sums."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """A column by its whole name, also when the name holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def name_range(df: DataFrame, first: str, last: str) -> list[str]:
    """All column names from ``first`` to ``last``, both included."""
    names = df.columns
    start, stop = names.index(first), names.index(last)
    if stop < start:
        raise ValueError(f"{last!r} comes before {first!r}")
    return names[start:stop + 1]


def select_range(df: DataFrame, lead: Sequence[str], first: str, last: str) -> DataFrame:
    """The ``lead`` columns, then the contiguous range."""
    return df.select(*[named(n) for n in [*lead, *name_range(df, first, last)]])


def names_at(df: DataFrame, positions: Iterable[int | range]) -> list[str]:
    """Names at 1-based positions; single positions and ranges may be mixed."""
    flat = [p for part in positions for p in (part if isinstance(part, range) else (part,))]
    if any(p < 1 or p > len(df.columns) for p in flat):
        raise IndexError(f"positions must lie in 1..{len(df.columns)}")
    return [df.columns[p - 1] for p in flat]


def select_positions(df: DataFrame, *positions: int | range) -> DataFrame:
    return df.select(*[named(n) for n in names_at(df, positions)])


def drop_positions(df: DataFrame, *positions: int | range) -> DataFrame:
    dropped = set(names_at(df, positions))
    return df.select(*[named(n) for n in df.columns if n not in dropped])


def unique_names(df: DataFrame) -> DataFrame:
    """Give every column whose header occurs twice its position as a suffix.

    Run this before anything that addresses columns by name. Spark compares names
    without case, so headers that differ only by case count as equal here.
    """
    lowered = [n.lower() for n in df.columns]
    return df.toDF(*[f"{n}_{i}" if lowered.count(n.lower()) > 1 else n
                     for i, n in enumerate(df.columns, start=1)])


def set_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename every column by position; the count has to agree."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns, {len(names)} names")
    return df.toDF(*names)


def relocate_front(df: DataFrame, *front: str) -> DataFrame:
    """Move the named columns to the front, keep the order of the rest."""
    return df.select(*[named(n) for n in front],
                     *[named(n) for n in df.columns if n not in front])


def apply_columns(df: DataFrame, columns: Sequence[str], f: Callable[[Column], Column]) -> DataFrame:
    """The same expression over many columns, in one projection."""
    chosen = set(columns)
    return df.select(*[f(named(n)).alias(n) if n in chosen else named(n) for n in df.columns])


def row_sum(columns: Sequence[str]) -> Column:
    """Sum over the columns of one row; NULL if any of them is NULL."""
    return reduce(add, [named(n) for n in columns])


def flag_empty_rows(df: DataFrame, columns: Sequence[str], flag: str) -> DataFrame:
    """Treat NULL as 0 in ``columns`` and add 1 where all of them sum to 0, else 0."""
    filled = apply_columns(df, columns, lambda c: F.coalesce(c, F.lit(0)))
    return filled.withColumn(flag, F.when(row_sum(columns) == 0, 1).otherwise(0))
