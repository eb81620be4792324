"""One registered query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classify, decontaminate, html_text, line_dedup, mixing, ngram_join, pii, quality_rules, suffix_dedup, token_counts
from .sql import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of each page."""
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in benchmark windows, and the items they are from."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        F.expr("n_hit > 0 and 20 * n_hit >= n_words").alias("contaminated"),
    )


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for each document."""
    found = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of as many tokens as there are, with nine tenths of the greatest entropy and four repeats at most."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of near-equal lines."""
    docs = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    edited = token_counts.apply_edits(counted, token_counts.sample_edits(F.col("text")))
    return edited.select("doc_id", F.col("n_before").alias("n_tokens_before"), "n_tokens", F.length("text").cast("long").alias("n_chars"), "n_encoded")


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose word shingles have a Jaccard similarity of 0.75 or more."""
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


@query
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without the strings of 400 bytes that start elsewhere too; words in runs of over 50 that do."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), passage=51)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words", (F.col("n_passage_words") > 0).alias("repeats_passage"))


@query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document, learnt from labelled rows that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    model = classify.fit(docs, labels.where(~held_out))
    return classify.scored(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", F.expr("cast(score >= 0.3D as int)").alias("predicted"))


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document, in the text as it is (base) and also disguised (spans)."""
    found = pii.personal_data(table(spark, sf_dir, "documents"), redact=False)
    n_found = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long").alias("n_found")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", n_found, (F.col("spans") != "").alias("personal"))
