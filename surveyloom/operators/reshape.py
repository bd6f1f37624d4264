"""Long to wide and wide to long."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.columns import named


def pivot_wide(df: DataFrame, by: Sequence[str], names_from: str, values_from: str,
               names: Sequence[str], fill=0) -> DataFrame:
    """One column per listed name, absent cells filled; other names are left out.

    Conditional sums need a single shuffle on ``by``; ``GroupedData.pivot`` first
    groups by key and name and then shuffles again.
    """
    cells = [F.coalesce(F.sum(F.when(named(names_from) == n, named(values_from))), F.lit(fill)).alias(n)
             for n in names]
    return df.groupBy(*[named(b) for b in by]).agg(*cells)


def unpivot_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                 names_to: str, values_to: str) -> DataFrame:
    """One row per id and listed column; NULL values stay."""
    return df.unpivot([named(i) for i in ids], [named(v) for v in values], names_to, values_to)
