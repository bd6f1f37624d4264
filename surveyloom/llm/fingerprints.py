"""Document fingerprints: bottom-k sketches of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyloom.llm.common import let, stage, words

#: Smallest hashes kept, their bits, and the words in a shingle.
K, BITS, SHINGLE = 64, 40, 5


def sketch(text: Column) -> Column:
    """The K smallest distinct shingle hashes in ascending order; a shorter text is one shingle, an empty one none."""
    def shingles(h):
        runs = F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (SHINGLE - 1), F.lit(0))),
            lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *[F.get(h, i + k) for k in range(1, SHINGLE)]), 64 - BITS))
        short = F.array(F.shiftrightunsigned(F.xxhash64(h), 64 - BITS))
        return F.when(F.size(h) >= SHINGLE, runs).when(F.size(h) > 0, short).otherwise(F.slice(runs, 1, 0))
    hashes = F.transform(words(text), lambda w: F.xxhash64(w))
    return F.slice(F.array_distinct(F.sort_array(let(hashes, shingles))), 1, K)


def merge(a: Column, b: Column) -> Column:
    """The sketch of both parts taken together (shingles that cross the seam are not in either)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, K)


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are alike, an empty one is like no other."""
    both = let(merge(a, b), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(
        F.size(u), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def distinct_shingles(a: Column) -> Column:
    """Estimated number of distinct shingles; exact below K."""
    last = F.get(a, F.lit(K - 1))
    return F.when(F.size(a) < K, F.size(a).cast("double")).otherwise((K - 1) / (last / F.lit(float(1 << BITS))))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has."""
    j = resemblance(a, b)
    return F.least(F.lit(1.0), j / (1 + j) * (distinct_shingles(a) + distinct_shingles(b))
                   / F.greatest(distinct_shingles(a), F.lit(1.0)))


def printed(a: Column) -> Column:
    """The sketch as text: ten hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), BITS // 4, "0")), "")


def neighbours(ids: DataFrame, rows_per_part: int = 100_000) -> DataFrame:
    """For distinct keys k with columns n and pick: nk and npick of the next key downwards; after the last, the first.

    Keys are range-partitioned and written, so that parts stay as they are; the next
    key is found inside a part, and for its last key in the next part's head. Only
    one row for each part meets in one task.
    """
    parts = max(16, -(-ids.count() // rows_per_part))
    cut = stage(ids.repartitionByRange(parts, F.col("k").desc()).withColumn("part", F.spark_partition_id()), "ranges")
    down = Window.partitionBy("part").orderBy(F.col("k").desc())
    inside = cut.withColumn("next", F.lead(F.struct("k", "pick")).over(down))
    heads = cut.groupBy("part").agg(F.max_by(F.struct("k", "pick"), "k").alias("head"))
    along = Window.orderBy("part")
    following = heads.select(
        F.col("part").alias("__part"),
        F.coalesce(F.lead("head").over(along),
                   F.first("head").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .alias("after"))
    found = inside.join(following, F.col("part") == F.col("__part")).withColumn("next", F.coalesce("next", "after"))
    return found.select("k", "n", F.col("next.k").alias("nk"), F.col("next.pick").alias("npick"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next, text_hash.

    The edited text has its last floor(n / 2) code points replaced by the first as many
    of the next document, downwards by id; after the last comes the first. Texts are
    shuffled by id once and read twice: to hand their beginning to the document
    before, and to take it. NULL texts are empty. A NULL id comes last. Where several
    rows have the next id, the one with the smallest hash of its text is the next.
    """
    lowest = -(1 << 63)
    whole = F.coalesce(F.col(text), F.lit(""))
    full = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("k"), whole.alias("text"),
                       F.xxhash64(whole).alias("pick"))
    ids = stage(full.groupBy("k").agg(F.max(F.length("text")).alias("n"), F.min("pick").alias("pick"),
                                      F.count(F.lit(1)).alias("rows")), "ids")
    repeated = bool(ids.filter("rows > 1").take(1))
    pairs = stage(neighbours(ids), "pairs").withColumnsRenamed({"k": "own", "n": "half"})

    sketched = full.withColumn("sketch", sketch(F.col("text")))
    # Written as two comparisons: as a second join key it would ask for another shuffle of the texts.
    same = (F.col("k") == F.col("nk")) & (F.col("pick") <= F.col("npick")) & (F.col("pick") >= F.col("npick"))
    heads = sketched.join(pairs, same).select(
        "own", F.expr("substring(text, 1, cast(half div 2 as int))").alias("head"), F.col("sketch").alias("next_sketch"))
    if repeated:
        heads = heads.dropDuplicates(["own"])
    joined = sketched.join(heads, F.col("k") == F.col("own"))
    edited = F.expr("concat(substring(text, 1, length(text) - length(text) div 2), "
                    "substring(head, 1, cast(length(text) div 2 as int)))")
    done = joined.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited")))
    return done.select(
        F.when(F.col("k") != lowest, F.col("k")).alias("doc_id"), F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"), printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), F.col("pick").alias("text_hash"))
