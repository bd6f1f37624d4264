"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.operators.columns import named
from surveyloom.operators.losses import Losses, watched


def drop_na_text(df: DataFrame, *columns: str, marker: str = "NA") -> DataFrame:
    """Drop rows where a column holds the literal marker text or NULL."""
    for name in columns:
        df = df.filter(named(name) != marker)
    return df


def keep_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Membership in a list the caller holds; pushed to the scan."""
    return df.filter(named(column).isin(list(values)))


def keep_listed(df: DataFrame, listing: DataFrame, column: str) -> DataFrame:
    """Membership in a table. Repeated entries in the listing do not repeat rows."""
    return df.join(listing.select(named(column)), column, "left_semi")


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Listwise deletion: a NULL in any of the columns removes the row."""
    test = F.lit(True)
    for name in columns or df.columns:
        test = test & named(name).isNotNull()
    return df.filter(test)


def censor(df: DataFrame, column: str, low: float, high: float, losses: Losses | None = None,
           analysis: str = "censor") -> DataFrame:
    """Rows inside the closed range; NULL lies outside of it. ``losses`` counts those below, above and without a value."""
    value = named(column)
    seen = watched(losses, df, analysis, {"below": value < low, "above": value > high, "missing": value.isNull()})
    return seen.filter(value.between(low, high))


def censor_report(df: DataFrame, column: str, low: float, high: float, *by: str) -> DataFrame:
    """How many rows ``censor`` keeps and drops per group."""
    inside = F.coalesce(named(column).between(low, high), F.lit(False))
    return df.groupBy(*[named(b) for b in by]).agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped"))
