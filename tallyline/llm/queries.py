"""The queries of this folder by name, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import (
    conversations, decontaminate, html_extract, license_scan, line_dedup, lm_score, packing, quality, simhash,
    substring_dedup, token_align, token_counts, url_filter,
)
from tallyline.llm.shared import stage, table

VOCABULARY = "word_bpe_49k.json"
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"
URL_RULES = [
    url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"),
]
#: Hosts with one of these words are the labelled examples of what to block.
BLOCKED_WORDS = (
    "adult", "ads", "bets", "bet", "casino", "escort", "gamble", "pills", "poker", "porn", "sex", "slots", "spam",
    "track", "viagra", "warez", "xxx",
)


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of source/lang directories; those of under 50 words are the licence files there."""
    docs = table(spark, folder, "documents")
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    name = F.when(words < 50, F.concat_ws("-", F.lit("LICENSE"), "doc_id")).otherwise(
        F.concat_ws("/", F.floor(F.col("doc_id") / 1000).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    )
    files = docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", name).alias("path"))
    return license_scan.scanned(files)


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    seen = token_counts.histogram(token_counts.lengths(docs, public_tokenizers.path(VOCABULARY)))
    # The totals read it twice.
    return token_counts.totals(stage(seen, "lengths"))


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.scored(table(spark, folder, "documents"))


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    urls = table(spark, folder, "pages").select("page_id", "url")
    found = url_filter.judged(urls, URL_RULES, url_filter.listed_labels(urls.select("url"), BLOCKED_WORDS))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.deduplicated(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    # The address comes along with the html: one row in, one row out.
    texts = html_extract.extracted(pages.select(F.struct("page_id", "url").alias("page"), "html"), id_col="page")
    return texts.select("page_id.page_id", "page_id.url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents"))


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.restored(table(spark, folder, "conversations"))


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.deduplicated(table(spark, folder, "documents"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_align.aligned(table(spark, folder, "documents"), *map(public_tokenizers.path, ALIGNED))


QUERIES = (
    op1_simhash, op2_license_scan, op3_token_counts, op4_lm_scoring, op5_url_filter, op6_substring_dedup, op7_html_extraction, op8_quality,
    op9_best_fit_packing, op10_decontaminate, op11_conversation_repair, op12_line_dedup, op13_token_alignment,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
