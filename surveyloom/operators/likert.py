"""Likert summaries.

``level_counts`` reads the answers once and returns one row per group and item with a
count for each level; its size depends on the groups and items only. Percentages,
low/neutral/high, mean and spread, bar offsets and densities are arithmetic on that
row, so they need no further shuffle, and levels nobody chose are there with 0.
Answers that are NULL or not listed do not count.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.functions.levels import answer_ordinal, sql_literal, sql_name
from surveyloom.operators.columns import apply_columns, named


def _count(i: int) -> str:
    """Reserved name of the column that counts the level with ordinal ``i``."""
    return f"__n_{i}"


def _counter(j: int, i: int) -> str:
    """Name of the counter of the level with ordinal ``i`` of item number ``j`` among others side by side."""
    return f"__n_{j}_{i}"


def code_answers(df: DataFrame, items: Sequence[str], levels: Sequence[str],
                 mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Put the ordinal of its level in place of each answer; NULL if it has none.

    With ``mapping`` the answers are raw ones, and an answer it leaves alone stands for
    itself. Code the answers before a join: small numbers are shuffled, not texts.
    """
    return apply_columns(df, items, answer_ordinal(mapping or {}, levels))


def count_codes(coded: DataFrame, items: Sequence[str], k: int, by: Sequence[str] = ()) -> DataFrame:
    """One row per group with a counter for each item and level, side by side.

    The rows are not multiplied by the number of items before they are aggregated,
    whatever the width of the block.
    """
    counters = [F.expr(f"count_if({sql_name(item)} = {i}) as {_counter(j, i)}")
                for j, item in enumerate(items) for i in range(1, k + 1)]
    return coded.groupBy(*[named(b) for b in by]).agg(*counters)


def add_codes(counted: DataFrame, items: Sequence[str], k: int, by: Sequence[str], weight: str) -> DataFrame:
    """``count_codes`` of fewer groups from rows that are counted already, each as often as ``weight`` says."""
    sums = [F.expr(f"sum({_counter(j, i)} * {sql_name(weight)}) as {_counter(j, i)}")
            for j in range(len(items)) for i in range(1, k + 1)]
    return counted.groupBy(*[named(b) for b in by]).agg(*sums)


def counts_of_items(counted: DataFrame, items: Sequence[str], k: int, by: Sequence[str] = (),
                    labels: Mapping[str, str] | None = None) -> DataFrame:
    """The counters of ``count_codes`` as one row per group and item: ``by..., item, __n_1 ... __n_k``."""
    rows = [[f"{sql_literal((labels or {}).get(item, item))} as item",
             *[f"{_counter(j, i)} as {_count(i)}" for i in range(1, k + 1)]] for j, item in enumerate(items)]
    return counted.select(*[named(b) for b in by], _inline(rows))


def _inline(rows: Sequence[Sequence[str]]) -> Column:
    """Rows of SQL expressions, for each row of a frame."""
    return F.expr("inline(array(" + ", ".join(f"struct({', '.join(row)})" for row in rows) + "))")


def code_counts(coded: DataFrame, items: Sequence[str], k: int, by: Sequence[str] = (),
                labels: Mapping[str, str] | None = None) -> DataFrame:
    """One row per group and item from coded answers: ``by..., item, __n_1 ... __n_k``."""
    return counts_of_items(count_codes(coded, items, k, by), items, k, by, labels)


def level_counts(df: DataFrame, items: Sequence[str], levels: Sequence[str], by: Sequence[str] = (),
                 labels: Mapping[str, str] | None = None,
                 mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Code the answers, then count them."""
    needed = df.select(*[named(n) for n in [*by, *items]])
    return code_counts(code_answers(needed, items, levels, mapping), items, len(levels), by, labels)


def _n(numbers) -> str:
    """Sum of the counts of the given levels; 0 if there are none."""
    return "(" + (" + ".join(_count(i) for i in numbers) or "0L") + ")"


def _ratio(part: str, whole: str, scale: str = "100.0D") -> str:
    """``ratio`` as SQL."""
    return f"(try_divide(cast({part} as double), cast({whole} as double)) * {scale})"


def _keys(counts: DataFrame) -> list[Column]:
    counters = {_count(i) for i in range(1, len(counts.columns) + 1)}
    return [named(n) for n in counts.columns if n not in counters]


def _split(k: int, center: float | None) -> tuple[list[int], list[int], list[int]]:
    """Ordinals below, at and above the middle; an even scale has no middle level."""
    middle = (k + 1) / 2 if center is None else center
    return ([i for i in range(1, k + 1) if i < middle], [i for i in range(1, k + 1) if i == middle],
            [i for i in range(1, k + 1) if i > middle])


def level_shares(counts: DataFrame, levels: Sequence[str], n: str = "n") -> DataFrame:
    """Every level of every item: ``level, ordinal``, its count and its percent."""
    total = _n(range(1, len(levels) + 1))
    rows = [[f"{sql_literal(level)} as level", f"{i} as ordinal", f"{_count(i)} as {sql_name(n)}",
             f"{_ratio(_count(i), total)} as percent"] for i, level in enumerate(levels, start=1)]
    return counts.select(*_keys(counts), _inline(rows))


def _balance(k: int, center: float | None = None) -> dict[str, Column]:
    total = _n(range(1, k + 1))
    return {name: F.expr(_ratio(_n(part), total))
            for name, part in zip(("low", "neutral", "high"), _split(k, center), strict=True)}


def low_neutral_high(counts: DataFrame, k: int, center: float | None = None) -> DataFrame:
    """Percent below, at and above the middle of a scale of ``k`` levels."""
    return counts.select(*_keys(counts), *[share.alias(name) for name, share in _balance(k, center).items()])


def shares_and_balance(counts: DataFrame, levels: Sequence[str], center: float | None = None) -> DataFrame:
    """``level_shares`` with the low, neutral and high percent of the item on each of its rows."""
    return level_shares(counts.withColumns(_balance(len(levels), center)), levels)


def _mean_sd(counts: DataFrame, k: int) -> DataFrame:
    """The counts with __mean and __sd of the ordinals."""
    total = _n(range(1, k + 1))
    weighted = " + ".join(f"{_count(i)} * {i}" for i in range(1, k + 1))
    squares = " + ".join(f"{_count(i)} * ({i}D - __mean) * ({i}D - __mean)" for i in range(1, k + 1))
    return (counts.withColumn("__mean", F.expr(_ratio(f"({weighted})", total, "1.0D")))
            .withColumn("__sd", F.expr(f"sqrt(try_divide({squares}, cast({total} - 1 as double)))")))


def mean_sd(counts: DataFrame, k: int) -> DataFrame:
    """Number of answers, mean and sample standard deviation of the ordinals."""
    return _mean_sd(counts, k).select(*_keys(counts), F.expr(_n(range(1, k + 1))).alias("n"), F.col("__mean").alias("mean"),
                                      F.col("__sd").alias("sd"))


def centered_offsets(counts: DataFrame, levels: Sequence[str], center: float | None = None) -> DataFrame:
    """Start and end of each level's bar, with the middle of the scale at 0."""
    k = len(levels)
    low, neutral, _ = _split(k, center)
    total, zero = _n(range(1, k + 1)), f"({_n(low)} + {_n(neutral)} / 2)"
    rows = [[f"{sql_literal(level)} as level", f"{i} as ordinal",
             f"{_ratio(f'{_n(range(1, i))} - {zero}', total)} as bar_start",
             f"{_ratio(f'{_n(range(1, i + 1))} - {zero}', total)} as bar_end"] for i, level in enumerate(levels, start=1)]
    return counts.select(*_keys(counts), _inline(rows))


def quantile(k: int, p: float) -> Column:
    """Quantile of the ordinals behind the counts, with linear interpolation between neighbours; NULL without answers.

    The answer of any rank follows from the running totals of the ``k`` counts, so this is
    the exact quantile of all answers, and costs ``k`` comparisons a row.
    """
    total = _n(range(1, k + 1))
    place = f"(({total} - 1) * {p!r}D)"
    below = f"floor({place})"

    def answer(rank: str) -> str:
        passed = "".join(f" + if({_n(range(1, i + 1))} <= {rank}, 1, 0)" for i in range(1, k))
        return f"cast(1{passed} as double)"

    here, after = answer(below), answer(f"least({below} + 1, {total} - 1)")
    return F.expr(f"if({total} > 0, {here} + ({after} - {here}) * ({place} - {below}), null)")


def normal_reference_bandwidth(counts: DataFrame, k: int, name: str = "bandwidth") -> DataFrame:
    """Adds the bandwidth that the normal-reference rule gives to each item's answers.

    It is 0.9 * n ** -0.2 times the smaller of the standard deviation and the
    interquartile range over 1.34; a range of 0 counts as the deviation, and where that is
    0 too, all answers being equal, as that answer. NULL with fewer than two answers.
    """
    total = _n(range(1, k + 1))
    measured = _mean_sd(counts, k).withColumn("__range", (quantile(k, 0.75) - quantile(k, 0.25)) / 1.34)
    rule = F.expr(f"""if({total} > 1, 0.9D * case when least(__sd, __range) > 0 then least(__sd, __range)
        when __sd > 0 then __sd else __mean end * power(cast({total} as double), -0.2D), null)""")
    return measured.withColumn(name, rule).drop("__mean", "__sd", "__range")


def ordinal_density(counts: DataFrame, k: int, grid: Sequence[float], bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density of the ordinals at each grid point.

    Equal answers have equal kernels, so ``k`` weighted kernels are exact whatever
    the number of answers. Without a ``bandwidth`` each item of each group takes its own
    from ``normal_reference_bandwidth``, shown in a column of that name.
    """
    own = bandwidth is None
    widened = normal_reference_bandwidth(counts, k) if own else counts
    width = "bandwidth" if own else f"{float(bandwidth)!r}D"
    points = widened.withColumn("x", F.expr("explode(array(" + ", ".join(f"{float(x)!r}D" for x in grid) + "))"))
    mass = " + ".join(f"{_count(i)} * exp(-0.5D * ((x - {i}D) / {width}) * ((x - {i}D) / {width}))" for i in range(1, k + 1))
    density = F.expr(f"try_divide({mass}, {_n(range(1, k + 1))} * {width} * {math.sqrt(2 * math.pi)!r}D)")
    return points.select(*_keys(counts), *(["bandwidth"] if own else []), "x", density.alias("density"))
