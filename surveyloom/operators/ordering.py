"""Orders: by value, by level, and previews with an explicit order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from surveyloom.functions.levels import ordinal
from surveyloom.operators.columns import named
from surveyloom.operators.counts import distinct_values


def preview(df: DataFrame, *by: str, rows: int = 6) -> DataFrame:
    """The first rows in the order of ``by``; each task keeps only that many."""
    return df.orderBy(*[named(b) for b in by]).limit(rows)


def sorted_values(df: DataFrame, column: str, language: str | None = None) -> DataFrame:
    """Distinct values in byte order, or in the order of a language (``in_language``)."""
    values = distinct_values(df, column)
    if language is None:
        return values.orderBy(named(column))
    return values.orderBy(*in_language(column, language))


def in_language(column: str, language: str) -> list[Column]:
    """Sort keys that put texts in the order of a language's dictionary, such as ``es`` or ``ca``.

    Accents and case decide only between texts that are else equal; what remains equal
    stands in byte order. Values stay apart that only the language holds to be equal.
    """
    return [F.collate(named(column), language), named(column)]


def order_by_levels(df: DataFrame, column: str, levels: Sequence[str], descending: bool = False) -> DataFrame:
    """Rows in the order of a level list; unlisted and NULL come last.

    All other columns break ties, so rows of one level can be spread over sort tasks.
    """
    position = ordinal(named(column), levels)
    first = position.desc_nulls_last() if descending else position.asc_nulls_last()
    sortable = [f.name for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
    return df.orderBy(first, *[named(n) for n in sortable])
