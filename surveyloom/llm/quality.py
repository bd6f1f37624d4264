"""Quality rules: counted base rules, then robust multivariate outliers for each language and source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.common import BLANKS, let, stage, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: The base rule: fewer words, or a larger share of repeated words in percent, fail.
LEAST_WORDS = 50
MOST_REPEATED = 50

#: Share of each group that the estimates rest on, C-steps, and the weight in documents of the estimate of the wider
#: group that each group's own is drawn towards. A document is itself among those that an estimate of few rests on, which
#: bounds its distance by their number, so the weight must be well above the cutoff.
COVERED = 0.75
C_STEPS = 4
PRIOR = 400

#: Quantiles of the chi-squared distribution with four degrees of freedom: at 0.75, and the cutoff at 1 - 1e-9.
CHI_75 = 5.385
CHI_CUT = 47.5

#: Smallest standard deviation of each transformed statistic, so that a group in which a statistic hardly varies
#: does not reject documents that differ by next to nothing.
FLOORS = (0.10, 0.30, 0.25, 0.15)
D = len(FLOORS)


def repeated_words(hashes: Column, n: Column) -> Column:
    """Words that lie in a three-word window found at least twice.

    The windows' hashes are packed with their positions into one long and sorted, so
    equal windows become neighbours; the positions then give the length of the union
    of the windows. ``n`` decides how many bits a position needs; a text of a
    thousand words leaves 54 bits for the hash. Neighbours that agree in these count as
    equal if the whole 64-bit hashes of their three words do too.
    """
    def right(value, places):
        return F.call_function("shiftright", value, places)

    def left(value, places):
        return F.call_function("shiftleft", value, places)

    def packed(h, bits):
        return F.sort_array(F.transform(
            F.slice(h, 1, F.greatest(n - 2, F.lit(0))),
            lambda x, i: left(right(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)), bits), bits)
            .bitwiseOR(i.cast("long"))))

    def covered(h, s, bits):
        mask = left(F.lit(1).cast("long"), bits) - 1

        def same(x, y):
            a, b = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
            whole = reduce(lambda all_, k: all_ & (F.get(h, a + k) == F.get(h, b + k)), range(3), right(x, bits) == right(y, bits))
            return F.coalesce(whole, F.lit(False))

        twice = F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1)))
        places = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask)))
        gaps = let(places, lambda p: F.transform(
            p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long")))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x)

    bits = F.length(F.bin(n))
    return let(hashes, lambda h: let(packed(h, bits), lambda s: covered(h, s, bits)))


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long; 0 for NULL texts)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: F.trim(line, F.lit(BLANKS)) != "")
    hashes = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    counted = let(hashes, lambda h: F.struct(
        F.size(h).cast("long").alias("n"), repeated_words(h, F.size(h)).alias("r")))
    return (docs.withColumn("__counted", counted)
            .withColumn("n_words", F.col("__counted.n"))
            .withColumn("word_chars", F.length(F.translate(whole, BLANKS, "")).cast("long"))
            .withColumn("n_symbols", (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"))
            .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
            .withColumn("n_repeat_words", F.col("__counted.r"))
            .drop("__counted"))


def base_failed() -> Column:
    return ((F.col("n_words") < LEAST_WORDS)
            | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))


def features() -> list[Column]:
    """The transformed statistics, about symmetric: word length, symbols, repeated lines, repeated words."""
    n = F.greatest("n_words", F.lit(1))
    return [F.log(F.greatest("word_chars", F.lit(1)) / n), F.log1p(F.col("n_symbols") * 100 / n),
            F.log1p(F.col("n_dup_lines") * 100 / n), F.sqrt(F.col("n_repeat_words") / n)]


def _pairs():
    return [(i, j) for i in range(D) for j in range(i + 1)]


def _estimates(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Centre m and the Cholesky factor l of the covariance from the sums n, s and q of each group."""
    mean = [F.col(f"s{i}") / F.col("n") for i in range(D)]
    cov = {(i, j): F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j] + (FLOORS[i] ** 2 if i == j else 0)
           for i, j in _pairs()}
    out = moments.select(*keys, *[m.alias(f"m{i}") for i, m in enumerate(mean)],
                         *[c.alias(f"c{i}{j}") for (i, j), c in cov.items()])
    for i, j in _pairs():
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select(*keys, *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in _pairs()])


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(D):
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))
        df = df.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") ** 2 for i in range(1, D)), F.col("y0") ** 2))


def _with(df: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    right = estimates.withColumnsRenamed({k: f"__{k}" for k in keys})
    return df.join(right, same, "left").drop(*[f"__{k}" for k in keys])


def _drawn(own: Column, n: Column, wide: Column) -> Column:
    """``own`` of n documents, drawn towards ``wide`` as if that were ``PRIOR`` documents more; ``wide`` alone without any."""
    return F.coalesce((F.coalesce(n, F.lit(0)) * own + PRIOR * wide) / (F.coalesce(n, F.lit(0)) + PRIOR), wide)


def _wider(groups: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the estimates of the wider group, as columns named wm, wl and wscale."""
    names = [*[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in _pairs()], "scale"]
    return _with(groups, wide.select(*keys, *[F.col(c).alias(f"w{c}") for c in names]), keys)


def _wide_moment(i: int, j: int) -> Column:
    """Mean product of two statistics under the wider group's estimate."""
    cov = reduce(lambda a, k: a + F.col(f"wl{i}{k}") * F.col(f"wl{j}{k}"), range(min(i, j) + 1), F.lit(0.0))
    return cov + F.col(f"wm{i}") * F.col(f"wm{j}")


def covariance_determinant(points: DataFrame, keys: list[str], wide: DataFrame | None = None,
                           wide_keys: list[str] | None = None, steps: int = C_STEPS) -> DataFrame:
    """Minimum-covariance-determinant estimates of each group of ``points`` (columns x0.. beside the keys).

    Starts from medians and quartile ranges and repeats the C-step: distances under
    the present estimates, then mean and covariance of the nearest three quarters.
    No group is gathered: distances are counted in fine logarithmic bins together
    with the sums of their points, the bins that hold three quarters are found from
    these counts, and their sums give the next estimates. With ``wide``, estimates of
    wider groups, every estimate is drawn towards that of its wider group, which counts as
    ``PRIOR`` documents: a group of one is judged by the wider one, a large group by itself,
    and there is no size at which this changes. Columns: keys, m, l, scale (of the distances).
    """
    half = [F.percentile_approx(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(5000)).alias(f"p{i}")
            for i in range(D)]
    start = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), *half)
    spread = [(F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349 for i in range(D)]
    middle = [F.col(f"p{i}")[1] for i in range(D)]
    variance = [spread[i] ** 2 + FLOORS[i] ** 2 for i in range(D)]
    if wide is not None:
        start, n = _wider(start, wide, wide_keys), F.col("size")
        middle = [_drawn(middle[i], n, F.col(f"wm{i}")) for i in range(D)]
        variance = [_drawn(variance[i], n, _wide_moment(i, i) - F.col(f"wm{i}") ** 2) for i in range(D)]
    current = stage(start.select(
        *keys, *[middle[i].alias(f"m{i}") for i in range(D)],
        *[(F.sqrt(variance[i]) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in _pairs()]), "mcd")
    for step in range(steps + 1):
        near = _distance(_with(points, current, keys))
        binned = near.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * 32).cast("int"))
        sums = binned.groupBy(*keys, "bin").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(D)],
            *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _pairs()])
        along = Window.partitionBy(*keys).orderBy("bin")
        inner = (sums.withColumn("before", F.sum("n").over(along) - F.col("n"))
                 .withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
                 .filter(F.col("before") < F.col("all") * COVERED))
        if step == steps:
            edge = inner.groupBy(*keys).agg((F.exp((F.max("bin") + 1) / 32) / CHI_75).alias("scale"), F.max("all").alias("all"))
            if wide is not None:
                edge = _wider(edge, wide, wide_keys).withColumn("scale", _drawn(F.col("scale"), F.col("all"), F.col("wscale")))
            return stage(_with(current, edge.select(*keys, "scale"), keys), "mcd")
        names = ["n", *[f"s{i}" for i in range(D)], *[f"q{i}{j}" for i, j in _pairs()]]
        moments = inner.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])
        if wide is not None:
            moments = _wider(moments, wide, wide_keys).withColumns({
                "n": F.col("n") + PRIOR, **{f"s{i}": F.col(f"s{i}") + PRIOR * F.col(f"wm{i}") for i in range(D)},
                **{f"q{i}{j}": F.col(f"q{i}{j}") + PRIOR * _wide_moment(i, j) for i, j in _pairs()}})
        current = stage(_estimates(moments, keys), "mcd")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
                  source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, lang, source, the columns to ``carry``, the five counts, base_failed, d2, kept.

    A document goes if it fails the base rule, or if its transformed statistics lie
    further from the robust centre of its language and source than the cutoff. The
    estimate of a source in a language is drawn towards the language's, and that towards
    the one of all documents, each by ``PRIOR`` documents, so that small groups are judged
    too. NULL languages and sources form groups of their own. A NULL or empty text has no
    words and fails. Documents that fail are in no estimate; where none passes, d2 is NULL.
    Repeated rows are counted as often as they occur; an empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"),
                       *carry, F.col(text).alias("text"))
    counted = text_stats(slim).drop("text").withColumn("base_failed", base_failed())
    # The key of all documents is written with them: a literal would be no key of a join.
    points = stage(counted.withColumn("every", F.lit(0)), "quality").withColumns({f"x{i}": f for i, f in enumerate(features())})
    passing = points.filter(~F.col("base_failed"))
    every = covariance_determinant(passing, ["every"])
    by_lang = covariance_determinant(passing, ["every", "lang"], every, ["every"])
    robust = covariance_determinant(passing, ["every", "lang", "source"], by_lang, ["every", "lang"]).drop("every")
    placed = _distance(_with(points, robust, ["lang", "source"])).withColumn("d2", F.col("d2") / F.greatest("scale", F.lit(1.0)))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= CHI_CUT)
    return placed.withColumn("kept", kept).select(*counted.columns, "d2", "kept")
