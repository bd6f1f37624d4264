"""Shares of counted cells.

Totals are aggregated from the cells and joined back to them, rather than taken with
a window over the group: a window would send all cells of one group to one task, the
aggregate combines before the shuffle and only the totals travel. Both branches read
the same counted cells, so Spark reuses their shuffle and the raw rows are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.levels import ratio
from surveyloom.operators.columns import named
from surveyloom.operators.counts import count_rows, reaggregate
from surveyloom.operators.joins import left_join


def share_in_group(cells: DataFrame, value: str, by: Sequence[str], name: str = "percent",
                   scale: float = 100.0, total: str | None = None) -> DataFrame:
    """``value`` over its group's sum; the group's sum is kept if ``total`` names it."""
    whole = total or "__total"
    totals = reaggregate(cells, *by, value=value, name=whole)
    shared = left_join(cells, totals, by, null_safe=True)
    shared = shared.withColumn(name, ratio(named(value), named(whole), scale))
    return shared if total else shared.drop(whole)


def share_of(cells: DataFrame, values: Sequence[str], denominators: DataFrame, by: Sequence[str] | str,
             denominator: str) -> DataFrame:
    """Percent of a denominator from another table; NULL where it is absent or zero."""
    joined = left_join(cells, denominators, by)
    percents = {v: ratio(named(v), named(denominator)) for v in values}
    return joined.withColumns(percents).drop(denominator)


def pie_donut(df: DataFrame, by: Sequence[str], answer: str, sub_answer: str,
              within_answer: bool | Column = True, name: str = "n", counted: str | None = None) -> DataFrame:
    """Inner share of each answer, outer share of each answer and sub-answer.

    The outer share is taken within the answer, or of the whole group if
    ``within_answer`` is false; a condition on ``by`` decides it group by group. ``name``
    is the column of the counts; ``counted`` names one of counts taken before.
    """
    cells = (count_rows(df, *by, answer, sub_answer, name="__n") if counted is None
             else reaggregate(df, *by, answer, sub_answer, value=counted, name="__n"))
    rings = reaggregate(cells, *by, answer, value="__n", name="__ring")
    wholes = reaggregate(rings, *by, value="__ring", name="__whole")
    joined = left_join(cells, rings, [*by, answer], null_safe=True)
    if by:
        joined = left_join(joined, wholes, by, null_safe=True)
    else:
        joined = joined.withColumn("__whole", wholes.scalar())
    within = F.lit(within_answer) if isinstance(within_answer, bool) else within_answer
    base = F.when(within, F.col("__ring")).otherwise(F.col("__whole"))
    return joined.select(*[named(b) for b in by], named(answer), named(sub_answer), F.col("__n").alias(name),
                         ratio(F.col("__ring"), F.col("__whole")).alias("pie_share"),
                         ratio(F.col("__n"), base).alias("donut_share"))
