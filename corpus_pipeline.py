"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm import bpe, linededup, mixing, neardup, quality
from surveyloom.llm.common import shared_root
from surveyloom.llm.queries import MOST_REPEATS, VOCABULARY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, each by its own verdict, also where ids are NULL or repeated.

    The verdict follows from text, language and source, so rows that agree in these and
    the id share it; the text is stood for by two hashes, 96 bits.
    """
    marked = docs.withColumns({"text_xx": F.xxhash64("text"), "text_mm": F.hash("text")})
    keys = ["doc_id", "lang", "source", "text_xx", "text_mm"]
    rejected = quality.quality_rules(marked, carry=("text_xx", "text_mm")).filter("not kept").select(*keys).distinct()
    gone = rejected.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return marked.join(gone, same, "left_anti").select(COLUMNS)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; n_chars follows the text."""
    cut = linededup.line_dedup(docs)
    return cut.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Rows that share an id are one document and stay or go together. Rows with a NULL id
    cannot be told apart and all stay, copies among them too.
    """
    return neardup.keep_one(docs).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated; each document occurs at least once."""
    return mixing.mix_sources(docs, max_repeats=MOST_REPEATS).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids to train on, n_tokens, and the digests of the ids and of what they decode to."""
    back = bpe.round_trip(docs.select("doc_id", "text"), VOCABULARY)
    return back.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good), ("line dedup", cut_lines), ("near dedup", keep_one), ("mixing", mix),
    ("encoding", encode)]

#: Robust estimates, signatures and merges are beyond SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again.

    Documents with NULL, empty or short texts go at the first stage. A NULL id takes part in
    every stage but the choice among copies (``keep_one``) and the loss of lines. Repeated
    rows are documents of their own at the first and the last two stages. Columns beyond
    those of ``documents`` are dropped. An empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
    return docs
