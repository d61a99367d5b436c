"""The registered queries of the training-data operators, and their SQL.

Each ``opN_<name>`` is thin: it applies its operator with production
parameters to its whole table and derives the digest columns of its contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lexical_search, line_dedup, media, quality, source_audit, toxicity, url_filter
from .common import table
from .exact_dedup import exact_dedup
from .html_extract import extract_main_text
from .line_dedup import dedup_lines
from .packing import pack
from .simhash import near_duplicates
from .suffix_dedup import PASSAGE, repeated_spans


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = media.store_payloads(table(spark, sf_dir, "documents"))
    items = media.sequences(store, "doc_id").drop("row_key")
    found = media.resolve(items, media.store_features(store)).where("kind = 'media'")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's 400 bytes; and what lies in repeated passages of over 50 words, as the pipeline takes them."""
    found = repeated_spans(table(spark, sf_dir, "documents"), passage=PASSAGE)
    size = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["b"])
    return found.select(
        "doc_id",
        (F.octet_length("kept") + size("spans")).alias("n_bytes"),
        size("spans").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.size("passages").cast("long").alias("n_passages"),
        size("passages").alias("passage_bytes"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_sha256")).alias("text_sha256"))


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM t
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("row_key")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_filter.oracle(), "op6_exact_dedup": OP6_SQL, "op11_lexical_search": lexical_search.SQL, "op12_source_audit": source_audit.SQL, "op13_line_dedup": line_dedup.SQL}
