"""Mixing sources: temperature weights, and block permutations that realise them within a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.common import stage, words

#: Exponents tried in one job (five bisection steps at once) and the number of such jobs: 30 bisection steps.
POINTS, ROUNDS = 31, 6

#: Bins of a permutation key in which the end of a partial block is looked for.
CUT_BINS = 4096


def tokens(text: Column) -> Column:
    """Words of a text as its number of tokens."""
    return F.size(words(text)).cast("long")


def bisect_exponent(shares: DataFrame, target_entropy: float | None, max_repeats: float | None,
                    passes: float | None) -> float:
    """Smallest exponent in 0..1 under which neither the entropy nor the repetition exceeds its bound.

    ``shares`` has the token share p of each source. Weights are p**exponent, normalised;
    their entropy falls and repetition shrinks as the exponent grows, so bisection
    applies. Each job evaluates the 31 inner points of five bisection steps in one
    aggregate; only these numbers reach the driver. ``target_entropy`` is a share of the
    largest possible entropy. ``passes`` is the budget in passes over all tokens, or None
    for the smallest budget that takes every source once.
    """
    log_p = F.log("p")
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * (i + 1) / (POINTS + 1) for i in range(POINTS)]
        columns = [F.count(F.lit(1)).alias("n")]
        for i, t in enumerate(points):
            x = F.exp(log_p * t)
            columns += [F.sum(x).alias(f"z{i}"), F.sum(x * log_p * t).alias(f"e{i}"),
                        F.max(x / F.col("p")).alias(f"hi{i}"), F.min(x / F.col("p")).alias(f"lo{i}")]
        row = shares.agg(*columns).select(
            *[(F.log(f"z{i}") - F.col(f"e{i}") / F.col(f"z{i}")).alias(f"h{i}") for i in range(POINTS)],
            *[F.col(f"hi{i}") / (F.col(f"lo{i}") if passes is None else F.col(f"z{i}") / passes)
              for i in range(POINTS)], F.log("n")).first()
        entropy, repeats, most = row[:POINTS], row[POINTS:2 * POINTS], row[-1]

        def fits(i, entropy=entropy, repeats=repeats, most=most):
            return ((target_entropy is None or entropy[i] <= target_entropy * most)
                    and (max_repeats is None or repeats[i] <= max_repeats))
        first = next((i for i in range(POINTS) if fits(i)), POINTS)
        low, high = ([low, *points][first], [*points, high][first])
    return high


def plan_mixture(totals: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None,
                 budget: int | None = None) -> DataFrame:
    """Per source: tokens, docs, weight, full (whole passes) and rest (tokens of the last, partial pass).

    Sources without a token have no weight; their documents are taken once.
    """
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    positive = totals.filter("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(max(whole, 1))))
    exponent = 1.0
    if whole:
        exponent = bisect_exponent(positive, target_entropy, max_repeats, budget / whole if budget else None)
    raw = F.exp(F.log("p") * exponent)
    sums = positive.agg(F.sum(raw), F.min(raw / F.col("p"))).first()
    norm, least = sums[0] or 1.0, sums[1] or 1.0
    passes = budget / whole / norm if budget and whole else 1.0 / least  # passes of a source per unit of raw / p
    share = F.col("tokens") / F.lit(float(max(whole, 1)))
    weighted = totals.withColumn("p", F.when(F.col("tokens") > 0, share))
    # Rounded so that a count of passes that is whole but for the last bits is whole.
    planned = weighted.withColumn("passes", F.coalesce(F.round(raw / F.col("p") * passes, 6), F.lit(1.0)))
    return planned.select(
        "source", "docs", "tokens", F.coalesce(raw / norm, F.lit(0.0)).alias("weight"),
        F.floor("passes").alias("full"),
        F.floor((F.col("passes") - F.floor("passes")) * F.col("tokens")).cast("long").alias("rest"))


def _block_ends(slim: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Largest permutation key that the partial block of each source takes.

    The tokens of a source are summed by bins of the key; the bin in which the rest of
    the budget ends follows from these sums, and only rows of that one bin are added
    up one by one. No source is ordered as a whole.
    """
    keyed = (_join_source(slim, plan.filter("rest > 0").select("source", "full", "rest"))
             .withColumn("key", _permutation(F.col("row_hash"), F.col("full"), seed))
             .withColumn("bin", F.shiftright("key", 64 - CUT_BINS.bit_length() + 1)))
    along = Window.partitionBy("source").orderBy("bin")
    sums = keyed.groupBy("source", "rest", "bin").agg(F.sum("tokens").alias("sum"))
    before = F.sum("sum").over(along) - F.col("sum")
    last = (sums.withColumn("before", before).filter("before <= rest and before + sum > rest")
            .select(F.col("source").alias("__source"), F.col("bin").alias("__bin"), "before"))
    inside = keyed.join(last, F.col("source").eqNullSafe(F.col("__source")) & (F.col("bin") == F.col("__bin")))
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("key"))
    ends = (inside.withColumn("through", F.col("before") + running).filter("through <= rest")
            .groupBy("source").agg(F.max("key").alias("inner_end")))
    floor_end = last.select(F.col("__source").alias("source"),
                            (F.shiftleft(F.col("__bin").cast("long"), 64 - CUT_BINS.bit_length() + 1) - 1)
                            .alias("outer_end"))
    return (_join_source(floor_end, ends, "left")
            .select("source", F.coalesce("inner_end", "outer_end").alias("block_end")))


def _join_source(df: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    right = other.withColumnRenamed("source", "__s")
    return df.join(right, F.col("source").eqNullSafe(F.col("__s")), how).drop("__s")


def _permutation(row_hash: Column, epoch: Column, seed: int) -> Column:
    return F.xxhash64(row_hash, epoch.cast("long"), F.lit(seed).cast("long"))


def mix_sources(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None,
                budget: int | None = None, seed: int = 7, id_col: str = "doc_id", text: str = "text",
                source: str = "source") -> DataFrame:
    """The rows of ``docs``, repeated or thinned to target weights, with mix_tokens, epoch and perm_key.

    Each epoch of a source is a block: a seeded permutation of its documents, in the
    order of perm_key. Whole passes take the whole block, the last one only as many
    documents as its share of the budget allows. Without a budget, the smallest one
    is taken under which each source is passed once, so that no document is lost.

    Sources are planned on a table of one row per source; documents get their plan by
    a join on the source, which Spark broadcasts if the table is small and whose hot
    keys it splits otherwise. No text is shuffled for it in the first case.

    A NULL source is a source. NULL, empty and blank texts have no tokens and are in
    or out with the keys around them. Equal rows have equal keys, so they are in or
    out together. Columns mix_tokens, epoch and perm_key are replaced. An empty table
    gives an empty result.
    """
    row_hash = F.xxhash64(F.col(id_col), F.col(text))
    slim = stage(docs.select(F.col(source).alias("source"), tokens(F.col(text)).alias("tokens"),
                             row_hash.alias("row_hash")), "mix")
    totals = stage(slim.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix")
    plan = stage(plan_mixture(totals, target_entropy, max_repeats, budget), "mix")
    ends = stage(_join_source(plan, _block_ends(slim, plan, seed), "left")
                 .select(F.col("source").alias("__source"), F.col("full").alias("__full"),
                         F.col("block_end").alias("__end")), "mix")

    own = docs.drop("mix_tokens", "epoch", "perm_key")
    planned = own.join(ends, F.col(source).eqNullSafe(F.col("__source")))
    last = _permutation(row_hash, F.col("__full"), seed) <= F.col("__end")
    copies = F.col("__full") + F.coalesce(last, F.lit(False)).cast("long")
    return (planned.withColumn("mix_tokens", tokens(F.col(text)))
            .withColumn("epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1))))
            .withColumn("perm_key", _permutation(row_hash, F.col("epoch"), seed))
            .select(*own.columns, "mix_tokens", "epoch", "perm_key"))

