"""Helpers shared by the operators: written intermediates, word rules, components, exact ranks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyloom.session import shared_folder

#: Characters that end a word, as a literal list and as a regular expression.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
BLANK_RUN = r"[\x20\x09-\x0D]+"

#: A key with more than this fraction of all rows is hot in ``join_heads``; there are fewer such keys than this.
HOT_SHARE = 512


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or the warehouse of a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder.rstrip("/") if folder else f"{shared_folder(spark)}/checkpoints"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, sizes are known after it.

    Each call takes a folder of its own. The files stay until the folder named by
    ``spark.checkpoint.dir`` is cleaned, since the result that reads them is lazy.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a lambda variable, so that it is evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for NULL, empty and blank texts."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def exact_rank(df: DataFrame, key: str, order: list[Column], bucket: Column, n: str, name: str) -> DataFrame:
    """Position from 1 of each row among the rows of ``key``, without a window over a whole key.

    ``bucket`` is an integer that never falls along ``order``, and spreads the rows
    of a key evenly. Rows are numbered inside (key, bucket); what lies before a
    bucket comes from the counts of the buckets. ``n`` gets the rows of the key.
    """
    cut = df.withColumn("__bucket", bucket)
    sizes = cut.groupBy(key, "__bucket").agg(F.count(F.lit(1)).alias("__size"))
    along = Window.partitionBy(key).orderBy("__bucket")
    offsets = sizes.select(
        F.col(key).alias("__key"), F.col("__bucket").alias("__b"),
        (F.sum("__size").over(along) - F.col("__size")).alias("__before"),
        F.sum("__size").over(Window.partitionBy(key)).alias(n))
    within = Window.partitionBy(key, "__bucket").orderBy(*order)
    joined = cut.join(offsets, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__bucket") == F.col("__b")))
    return (joined.withColumn(name, F.col("__before") + F.row_number().over(within))
            .drop("__bucket", "__key", "__b", "__before"))


def join_heads(rows: DataFrame, heads: DataFrame, total: int) -> DataFrame:
    """``rows`` with the columns of ``heads`` of the same key, by an inner join without hot keys.

    ``heads`` has one row for each ``__key``, and in ``__n`` how many of the ``total``
    rows have that ``key``. Keys with more than a ``HOT_SHARE``-th of all rows are
    fewer than ``HOT_SHARE``, as counts add up to the total; these few heads, and only
    these, are broadcast, and their rows stay where they are. All others are shuffled.
    ``rows`` is read twice, so it should be a written table.
    """
    is_hot = F.col("__n") * HOT_SHARE > F.lit(total)
    hot, cold = F.broadcast(heads.filter(is_hot)), heads.filter(~is_hot)
    hot_keys = F.broadcast(heads.filter(is_hot).select("__key"))
    same = F.col("key") == F.col("__key")
    rest = rows.join(hot_keys, same, "left_anti").join(cold, same)
    return rows.join(hot, same).unionByName(rest).drop("__key", "__n")


def bucket_count(rows: int, per_bucket: int = 20_000, least: int = 256) -> int:
    """Buckets for ``exact_rank``: some ten thousand rows each, and enough of them to spread small inputs."""
    return max(least, -(-rows // per_bucket))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Smallest node reachable from each node of undirected ``edges`` (a, b): columns node, root.

    Alternates the large-star and small-star steps until the edges are a forest of
    stars. Every step is a minimum per node, combined before the shuffle, and a join
    of the edges with these minima, in which nodes with very many edges are not
    shuffled (``join_heads``). Each round is written, so that no lineage grows.
    """
    current = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                    .distinct(), name)
    seen = _checksum(current)
    while True:
        both = current.union(current.select("b", "a")).toDF("key", "b")
        large = stage(join_heads(both, _lowest(both), 2 * seen[0]).filter("b > key")
                      .select(F.col("b").alias("a"), F.least("m", "key").alias("b")).distinct(), name)
        edges = large.toDF("key", "b")
        low = _lowest(edges)
        small = (join_heads(edges, low, edges.count()).select("b", "m").filter("b <> m")
                 .union(low.select("__key", "m")).toDF("a", "b").distinct())
        current = stage(small, name)
        now = _checksum(current)
        if now == seen:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                current.select("b", "b").distinct())
        seen = now


def _lowest(edges: DataFrame) -> DataFrame:
    """Least neighbour m and number of edges of each node."""
    return edges.groupBy(F.col("key").alias("__key")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("__n"))


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first()
    return row[0], row[1]
