"""Left joins and lookups.

Joins between tables carry no broadcast hint. Spark broadcasts a side when its
statistics, or under adaptive execution its measured size, lie below
``spark.sql.autoBroadcastJoinThreshold``; otherwise it sorts and merges, and splits a
hot key of the left side at run time. That holds for tables written out by the caller too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions.levels import Groups, group_of
from surveyloom.operators.columns import named


def literal_table(spark: SparkSession, schema: str, rows: Sequence[tuple]) -> DataFrame:
    """An inline table the caller wrote out."""
    return spark.createDataFrame(rows, schema)


def left_join(left: DataFrame, right: DataFrame, on: Sequence[str] | str,
              null_safe: bool = False) -> DataFrame:
    """Left equi-join; repeated right keys repeat left rows.

    With ``null_safe`` a NULL key finds a NULL key; without it NULL finds nothing.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if not null_safe:
        return left.join(right, keys, "left")
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    test = reduce(and_, [named(k).eqNullSafe(named(f"__right_{k}")) for k in keys])
    return left.join(renamed, test, "left").drop(*[f"__right_{k}" for k in keys])


def merge_left(left: DataFrame, right: DataFrame, by: Sequence[str] | str,
               suffixes: tuple[str, str] = ("_x", "_y"), sort: bool = False) -> DataFrame:
    """Left join that renames clashing columns on both sides.

    ``sort`` orders the result by the key, with all other columns as tie-breaks, so
    that equal keys can be spread over sort tasks.
    """
    keys = [by] if isinstance(by, str) else list(by)
    clashing = {n.lower() for n in left.columns} & {n.lower() for n in right.columns}
    clashing -= {k.lower() for k in keys}

    def suffixed(df: DataFrame, suffix: str) -> DataFrame:
        return df.withColumnsRenamed({n: n + suffix for n in df.columns if n.lower() in clashing})

    merged = suffixed(left, suffixes[0]).join(suffixed(right, suffixes[1]), keys, "left")
    if not sort:
        return merged
    return merged.orderBy(*[named(k) for k in keys], *[named(n) for n in merged.columns if n not in keys])


def recode_lookup(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Replace listed values through a lookup table; the rest passes through."""
    lookup = literal_table(df.sparkSession, f"`{column}` string, __new string", list(mapping.items()))
    joined = df.join(lookup, column, "left")
    return joined.select(*[F.coalesce(F.col("__new"), named(n)).alias(n) if n == column else named(n)
                           for n in df.columns])


def rollup_lookup(df: DataFrame, column: str, groups: Groups, name: str, default: str) -> DataFrame:
    """Coarser group through a lookup table, for lists too long for a literal map."""
    lookup = literal_table(df.sparkSession, f"`{column}` string, `{name}` string", list(group_of(groups).items()))
    joined = df.join(lookup, column, "left")
    return joined.select(*[named(n) for n in df.columns],
                         F.coalesce(named(name), F.lit(default)).alias(name))
