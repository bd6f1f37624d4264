"""Sharding by proportional stratified interleaving: every shard has the mixture of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import bucket_count, exact_rank, stage


def interleave(rows: DataFrame, n_shards: int, stratum: str, tie: list[str], seed: int = 11) -> DataFrame:
    """Adds shard (0..n_shards-1) and slot (gapless from 0) to narrow ``rows``.

    Rows are shuffled by a seeded hash and ranked within their stratum; ranks become
    fractions of the stratum, and the order of all fractions is cut into shards whose
    counts differ by at most one. Each stratum's fractions begin at a phase of its own,
    drawn from its hash, so that small strata do not all lie at the same places: a stratum
    of one row is as likely in any shard, and many of them are spread evenly.

    Both orders are numbered bucket by bucket (``exact_rank``), so neither a hot
    stratum nor the whole table is sorted in one task. ``tie`` names columns that tell
    rows apart; rows equal in all of them are interchangeable. NULL is a stratum.
    """
    total = rows.count()
    if total == 0:
        return rows.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    bits = (bucket_count(total) - 1).bit_length()
    buckets = 1 << bits
    hashed = rows.withColumn("__h", F.xxhash64(F.lit(seed).cast("long"), *tie))
    ranked = exact_rank(hashed, stratum, [F.col("__h"), *[F.col(t) for t in tie]],
                        F.shiftright("__h", 64 - bits), "__n", "__r")
    phase = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1).cast("long"), stratum), 12) / F.lit(float(1 << 52))
    placed = stage(ranked.withColumn("__f", (F.col("__r") - phase) / F.col("__n"))
                   .withColumn("__cut", F.floor(F.col("__f") * buckets).cast("long"))
                   .withColumn("__all", F.lit(0)).drop("__r", "__n"), "shards")
    order = [F.col("__f"), F.xxhash64(stratum), F.col("__h"), *[F.col(t) for t in tie]]
    lined = exact_rank(placed, "__all", order, F.col("__cut"), "__n", "__r")
    place = F.col("__r") - 1
    shard = F.floor(place * n_shards / F.col("__n"))
    start = F.ceil(shard * F.col("__n") / n_shards)
    return (lined.withColumn("shard", shard.cast("int")).withColumn("slot", (place - start).cast("long"))
            .drop("__h", "__f", "__cut", "__all", "__r", "__n"))


def shard_documents(docs: DataFrame, n_shards: int = 8, seed: int = 11, id_col: str = "doc_id", text: str = "text",
                    source: str = "source") -> DataFrame:
    """Per document: doc_id, source, size (UTF-8 bytes plus one), text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: shard counts are at most one apart. A NULL text has no bytes;
    its checksum is that of the empty text. Copies are rows like any others, because a
    group of copies can be larger than a shard. Repeated rows keep their number. Only
    ids, sizes and checksums are shuffled, never texts. An empty table gives an empty result.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    slim = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"),
                             (F.octet_length(whole) + 1).cast("long").alias("size"),
                             F.crc32(whole.cast("binary")).alias("text_crc32")), "sizes")
    out = interleave(slim, n_shards, "source", ["doc_id", "text_crc32", "size"], seed)
    return out.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
