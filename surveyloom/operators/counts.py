"""Counts, sums and distinct values. All of them combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.text import quoted
from surveyloom.operators.columns import named
from surveyloom.operators.reshape import unpivot_long


def count_rows(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    """Rows per group; NULL is a group of its own."""
    return df.groupBy(*[named(b) for b in by]).agg(F.count(F.lit(1)).alias(name))


def count_distinct(df: DataFrame, *by: str, of: str, name: str = "n") -> DataFrame:
    """Distinct values per group, such as respondents per zone; NULL does not count.

    Values are made distinct per group before they are counted, so a large group is
    spread over its values.
    """
    return df.groupBy(*[named(b) for b in by]).agg(F.count_distinct(named(of)).alias(name))


def reaggregate(cells: DataFrame, *by: str, value: str, name: str) -> DataFrame:
    """Roll counted cells up to fewer keys."""
    return cells.groupBy(*[named(b) for b in by]).agg(F.sum(named(value)).alias(name))


def sum_or_zero(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums that ignore NULL; a group of only NULL gives 0."""
    sums = [F.coalesce(F.sum(named(v)), F.lit(0)).alias(v) for v in values]
    return df.groupBy(*[named(b) for b in by]).agg(*sums)


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[named(c) for c in columns]).distinct()


def quoted_values(df: DataFrame, column: str, name: str) -> DataFrame:
    """All distinct values, quoted, one row each in byte order; any number of them."""
    return distinct_values(df, column).select(quoted(named(column)).alias(name)).orderBy(name)


def outside_levels(df: DataFrame, items: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """Per item, the answers that are not in the level list, with their counts."""
    answers = unpivot_long(df, [], items, "item", "answer")
    listed = F.coalesce(F.col("answer").isin(list(levels)), F.lit(False))
    return count_rows(answers.filter(~listed), "item", "answer")


def contradictions(df: DataFrame, by: Sequence[str], direction: str, down: str, up: str) -> DataFrame:
    """Groups reported in both directions."""
    counts = df.groupBy(*[named(b) for b in by]).agg(
        F.count_if(named(direction) == down).alias("n_down"),
        F.count_if(named(direction) == up).alias("n_up"))
    return counts.filter("n_down > 0 and n_up > 0")
