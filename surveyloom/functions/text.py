"""Labels and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_point(column: Column, decimals: int = 1) -> Column:
    """Text with a fixed number of decimals, rounded as C's ``printf`` does.

    ``format_number`` with an explicit pattern rounds the exact binary value half to
    even, so 6.25 gives 6.2; ``format_string`` would round the printed digits up.
    """
    pattern = "0." + "0" * decimals if decimals else "0"
    return F.call_function("format_number", column.cast("double"), F.lit(pattern))


def percent_label(column: Column, decimals: int = 1, scale: float = 1.0) -> Column:
    """``12.5%``; ``scale=100`` for a share between 0 and 1."""
    value = column if scale == 1.0 else column * F.lit(scale)
    return F.concat(fixed_point(value, decimals), F.lit("%"))


def quoted(column: Column) -> Column:
    """The text in single quotes."""
    return F.concat(F.lit("'"), column, F.lit("'"))


def title(*parts: Column | str) -> Column:
    """Parts joined by one blank; plain strings are literals."""
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p for p in parts])
