"""Key grids and completion: one row per key and domain value.

The domain is a list held by the caller, so a grid needs no join: the distinct keys
are exploded over it. To densify a table, each key's present values are folded into
bit masks (a fixed-size aggregate that combines before the shuffle, also for a hot
key), the absent values are unpacked from the masks, and the new rows are appended.
The rows already there are neither joined nor shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.levels import ordinal, sql_literal, sql_name
from surveyloom.operators.columns import named
from surveyloom.operators.joins import left_join

BITS = 62  # positions per mask; the sign bit of a long stays free


def explode_domain(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Repeat every row once per domain value."""
    return df.withColumn(column, F.explode(F.array(*[F.lit(v) for v in domain])))


def key_grid(df: DataFrame, keys: Sequence[str], column: str, domain: Sequence[str]) -> DataFrame:
    """Observed keys times a fixed domain."""
    return explode_domain(df.select(*[named(k) for k in keys]).distinct(), column, domain)


def absent_values(df: DataFrame, keys: Sequence[str], column: str, domain: Sequence[str],
                  attributes: DataFrame | None = None, on: str | None = None,
                  null_safe: bool = False) -> DataFrame:
    """Domain values that a key has no row for, as ``(keys, column)``.

    ``attributes`` are looked up by ``on`` once per key, before the rows multiply.
    """
    blocks = [domain[i:i + BITS] for i in range(0, len(domain), BITS)]
    masks, absent = [], []
    for b, block in enumerate(blocks):
        bits = ordinal(named(column), block) - 1
        masks.append(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bits)).alias(f"__m{b}"))
        mask = F.coalesce(F.col(f"__m{b}"), F.lit(0).cast("long"))
        absent += [F.when(mask.bitwiseAND(F.lit(1 << i).cast("long")) == 0, F.lit(v))
                   for i, v in enumerate(block)]
    per_key = df.groupBy(*[named(k) for k in keys]).agg(*masks)
    extra: list[str] = []
    if attributes is not None:
        extra = [n for n in attributes.columns if n != on]
        per_key = left_join(per_key, attributes, on, null_safe)
    one_each = per_key.select(*[named(k) for k in keys], *[named(n) for n in extra],
                              F.explode(F.array(*absent)).alias(column))
    return one_each.filter(named(column).isNotNull())


def _level_array(levels: Sequence[str]) -> str:
    """The level list as an array in SQL: one literal, whatever its length."""
    if not levels:
        return "cast(array() as array<string>)"
    separator = "\x1f"
    while any(separator in level for level in levels):
        separator += "\x1f"
    return f"split({sql_literal(separator.join(levels))}, '{separator}')"


def complete_cells(cells: DataFrame, by: Sequence[str], level: str, levels: Sequence[str],
                   value: str = "n", fill=0) -> DataFrame:
    """Every observed group with every level: ``by..., level, value``, missing cells filled.

    Levels form a closed domain: a cell with an unlisted level counts under NULL, and a
    NULL cell stays if the group has one. The cells are read once and summed by level; a
    group then holds a sparse map from its levels to their sums, to which the levels it
    lacks are added by a hash of both lists. The work is one step for each cell of the
    result, so lists of thousands of levels are as cheap per cell as short ones.
    """
    keys, name = [named(b) for b in by], sql_name(level)
    listed = F.expr(f"case when {name} in ({', '.join(map(sql_literal, levels))}) then {name} end" if levels else "cast(null as string)")
    sums = cells.withColumn("__level", listed).groupBy(*keys, "__level").agg(F.sum(named(value)).alias("__sum"))
    filler = f"cast({sql_literal(fill) if isinstance(fill, (str, int)) else repr(fill)} as {sums.schema['__sum'].dataType.simpleString()})"
    found = F.expr(f"collect_list(struct(__level, coalesce(__sum, {filler}) as __sum)) as __found")
    rows = F.expr(f"""inline(concat(__found, transform(array_except({_level_array(levels)}, transform(__found, e -> e.__level)),
        lacking -> struct(lacking as __level, {filler} as __sum))))""")
    filled = sums.groupBy(*keys).agg(found).select(*keys, rows)
    return filled.select(*keys, F.col("__level").alias(level), F.col("__sum").alias(value))


def complete_observed(cells: DataFrame, by: Sequence[str], level: str, value: str = "n", fill=0,
                      spread: int = 16) -> DataFrame:
    """Every observed group with every level that any group has; NULL is a group and a level like others.

    No list is given: groups and levels are both taken from the cells, and neither needs
    to fit into a task. Groups are dealt to ``spread`` rows of a square by their hash and
    stand in each of its columns, levels to as many columns and stand in each row; an
    equi-join on row and column makes the grid square by square. Grid and cells are then
    summed together. Repeated cells count as their sum.
    """
    keys = [named(b) for b in by]
    sums = cells.groupBy(*keys, named(level)).agg(F.sum(named(value)).alias(value))
    kind = sums.schema[value].dataType
    every = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))

    def part(*columns: Column) -> Column:
        # Never NULL, and Spark sees it: a test for NULL in one branch would keep it from sharing the shuffle.
        return F.coalesce(F.pmod(F.xxhash64(*columns), F.lit(spread)).cast("int"), F.lit(0)) if columns else F.lit(0)

    def occurring(*columns: Column) -> DataFrame:
        # The count keeps the values in the plan, so that all three branches read one shuffle of the sums.
        return sums.groupBy(*columns).agg(F.count(named(value)).alias("__n")).filter("__n >= 0").drop("__n")

    groups = occurring(*keys).withColumns({"__row": part(*keys), "__column": every})
    observed = occurring(named(level)).withColumns({"__row": every, "__column": part(named(level))})
    grid = groups.join(observed, ["__row", "__column"]).select(*keys, named(level), F.lit(None).cast(kind).alias(value))
    both = grid.unionByName(sums).groupBy(*keys, named(level)).agg(F.sum(named(value)).alias(value))
    return both.withColumn(value, F.coalesce(named(value), F.lit(fill).cast(kind)))


def densify(facts: DataFrame, keys: Sequence[str], column: str, domain: Sequence[str],
            attributes: DataFrame | None = None, on: str | None = None,
            null_safe: bool = False, present: DataFrame | None = None) -> DataFrame:
    """One row per key and domain value; the added rows hold NULL facts.

    Rows whose value is not in the domain are lost, as the grid drives the result
    (``lost_rows`` counts them), though their key still gets its full set of rows.
    Repeated rows of one key and value all stay. With ``attributes``, these columns
    are looked up by ``on`` for the present and the added rows alike; without, a
    column that came with the facts is NULL in the added rows.

    The keys and values are read a second time to find the absent ones. If the facts
    come from a costly plan, ``present`` names a cheaper frame with the same ones.
    """
    source = facts if present is None else present
    added = absent_values(source, keys, column, domain, attributes, on, null_safe)
    listed = facts.filter(named(column).isin(list(domain)))
    if attributes is not None:
        listed = left_join(listed, attributes, on, null_safe)
    return listed.unionByName(added, allowMissingColumns=True)


def lost_rows(facts: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """Number of rows that ``densify`` cannot place in the grid."""
    listed: Column = F.coalesce(named(column).isin(list(domain)), F.lit(False))
    return facts.agg(F.count_if(~listed).alias("lost"))
