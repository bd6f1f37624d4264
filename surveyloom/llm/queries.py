"""The operators as queries ``(spark, sf_dir) -> DataFrame``, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyloom.llm import (
    bpe,
    chat,
    fingerprints,
    infill,
    linededup,
    mixing,
    neardup,
    pages,
    passages,
    quality,
    search,
    sharding,
    tokenfile,
)

Query = Callable[[SparkSession, str], DataFrame]

#: The vocabulary file that the encoding query takes.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: No source is repeated more often than this by the mixing query.
MOST_REPEATS = 2.0


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def op1_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    return pages.extract_main_text(spark.read.parquet(f"{d}/pages.parquet"))


def op2_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, d))


def op3_chat_formatting(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.read_back(chat.format_chats(rows.unionByName(more)))


def op4_document_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_documents(spark, d))


def op5_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, d))


def op6_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return passages.repeated_passages(_documents(spark, d))


def op7_bpe_encoding(spark: SparkSession, d: str) -> DataFrame:
    return bpe.round_trip_digests(_documents(spark, d), VOCABULARY)


def op8_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    mixed = mixing.mix_sources(_documents(spark, d), max_repeats=MOST_REPEATS)
    return mixed.select("doc_id", "source", "mix_tokens", "epoch", "perm_key")


def op9_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, d)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = linededup.line_dedup(_documents(spark, d).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op11_token_binary(spark: SparkSession, d: str) -> DataFrame:
    return tokenfile.token_file_digests(_documents(spark, d), VOCABULARY, end_id=2)


def op12_fill_in_middle(spark: SparkSession, d: str) -> DataFrame:
    return infill.fill_in_middle_digests(_documents(spark, d))


def op13_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return search.rank_documents(_documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_html_extraction, op2_sharding, op3_chat_formatting, op4_document_fingerprints, op5_minhash_near_dedup,
    op6_substring_dedup, op7_bpe_encoding, op8_source_mixing, op9_quality_rules, op10_line_dedup,
    op11_token_binary, op12_fill_in_middle, op13_ranked_search)}

ORACLES: dict[str, str] = {
    "op10_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
        keyed AS (
            SELECT doc_id, i, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM split),
        repeated AS (
            SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        marked AS (
            SELECT k.*, coalesce(k.doc_id <> r.first, FALSE) AS gone
            FROM keyed k LEFT JOIN repeated r ON k.key = r.key AND length(k.key) >= 10)
        SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op12_fill_in_middle": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS parts,
                   sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents),
        counted AS (
            SELECT *, CASE WHEN text = '' THEN 0 ELSE len(parts) - (parts[-1] = '')::INT END AS n,
                   ('0x' || hex[1:8])::BIGINT AS h1, ('0x' || hex[9:16])::BIGINT AS h2,
                   ('0x' || hex[17:24])::BIGINT AS h3, ('0x' || hex[25:32])::BIGINT AS h4 FROM texts),
        cut AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM counted),
        begun AS (
            SELECT *, CASE WHEN a = 0 THEN '' WHEN a = n THEN text ELSE array_to_string(parts[1:a], chr(10)) || chr(10) END AS prefix,
                   CASE WHEN b = 0 THEN '' WHEN b = n THEN text ELSE array_to_string(parts[1:b], chr(10)) || chr(10) END AS through
            FROM cut),
        formed AS (
            SELECT *, substr(through, length(prefix) + 1) AS middle, substr(text, length(through) + 1) AS suffix,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
                        THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM begun)
        SELECT doc_id, n::BIGINT AS n, form,
               CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM formed""",
    "op13_ranked_search": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
        lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id),
        sizes AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
        norms AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // total AS m FROM lengths, sizes),
        weights AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM tfs, sizes GROUP BY term, docs),
        asked AS (
            SELECT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        items AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
        scores AS (
            SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
            FROM items JOIN weights USING (term) JOIN tfs USING (term) JOIN norms USING (doc_id)
            GROUP BY item_id, doc_id HAVING score > 0),
        ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
            FROM scores)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""",
}
