"""Recoding of answers into ordered levels, groups and bands.

An ordered category is a text label plus an integer ordinal (1 for the first
level). The mapping and the level list are always arguments, so two question blocks
may treat the same raw answer differently.

Recodes are lookups in a literal map. Each names its input once, so they can be
nested without the expression growing, as CASE branches would.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Groups = Mapping[str, Sequence[str]]


def sql_name(name: str) -> str:
    """A column's whole name in an SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def sql_literal(value: str | int | None) -> str:
    """A text, whole number or NULL text in an SQL expression.

    Wide blocks and long lists are put as one expression each: built from single columns,
    they cost the driver more time than Spark then needs for small tables.
    """
    if value is None:
        return "cast(null as string)"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _look_up_in(mapping: Mapping[str, object]) -> Callable[[Column], Column]:
    """The mapped value of a column; NULL for NULL and for anything that is not listed.

    The map is built once, however many columns are looked up in it.
    """
    if not mapping:
        return lambda column: F.lit(None).cast("string")
    table = F.expr("map(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in mapping.items()) + ")")
    return lambda column: table[column]


def _look_up(column: Column, mapping: Mapping[str, object]) -> Column:
    return _look_up_in(mapping)(column)


def recode(column: Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed values; anything else, NULL included, passes through."""
    return F.coalesce(_look_up(column, mapping), column)


def relabel(column: Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed values; anything else becomes NULL."""
    return _look_up(column, mapping)


def in_levels(column: Column, levels: Sequence[str]) -> Column:
    """Keep a listed level; an unlisted answer becomes NULL."""
    return F.when(column.isin(list(levels)), column)


def ordinal(column: Column, levels: Sequence[str]) -> Column:
    """Position of the answer in the level list from 1; NULL when it is not listed."""
    return _look_up(column, {level: i for i, level in enumerate(levels, start=1)})


def raw_answers(mapping: Mapping[str, str], levels: Sequence[str]) -> dict[str, list[str]]:
    """For each level the raw answers that stand for it.

    An answer that the mapping leaves alone stands for itself if it is a level.
    """
    return {level: [raw for raw, new in mapping.items() if new == level]
            + ([level] if level not in mapping else []) for level in levels}


def answer_level(mapping: Mapping[str, str], levels: Sequence[str]) -> Callable[[Column], Column]:
    """Recode raw answers and keep only listed levels. For use over many columns."""
    return _look_up_in({raw: level for level, raws in raw_answers(mapping, levels).items() for raw in raws})


def answer_ordinal(mapping: Mapping[str, str], levels: Sequence[str]) -> Callable[[Column], Column]:
    """The ordinal of a raw answer's level, in one lookup."""
    return _look_up_in({raw: i for i, raws in enumerate(raw_answers(mapping, levels).values(), start=1)
                        for raw in raws})


def group_of(groups: Groups) -> dict[str, str]:
    """Member to group; a member listed twice belongs to the first group that names it."""
    flat: dict[str, str] = {}
    for group, members in groups.items():
        for member in members:
            flat.setdefault(member, group)
    return flat


def rollup(column: Column, groups: Groups, default: str) -> Column:
    """Coarser group of a category; NULL and unlisted values fall in ``default``."""
    return F.coalesce(_look_up(column, group_of(groups)), F.lit(default))


def belongs_to(column: Column, groups: Groups, wanted: str, default: str) -> Column:
    """Same rows as ``rollup(column, groups, default) == wanted``, put as a test on the raw column.

    A test on a recoded column is not pushed to a Parquet scan, a member list is.
    """
    flat = group_of(groups)
    members = [member for member, group in flat.items() if group == wanted]
    if wanted != default:
        return column.isin(members)
    return column.isNull() | ~column.isin([m for m in flat if m not in members])


def band(column: Column, low: float, high: float,
         labels: Sequence[str] = ("red", "yellow", "green")) -> Column:
    """Below ``low``, the closed range between, above ``high``; NULL stays NULL."""
    below, within, above = labels
    return (F.when(column < low, below)
            .when((column >= low) & (column <= high), within)
            .when(column > high, above))


def ratio(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """``part / whole * scale`` as a double; NULL when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(scale)


def mirror(column: Column, direction: Column, negative: str) -> Column:
    """Negative for one direction, positive for every other one."""
    return F.when(direction == negative, -F.abs(column)).otherwise(F.abs(column))
