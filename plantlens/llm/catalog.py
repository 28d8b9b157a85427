"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm import bpe, collocations, html_text, language_model, license_scan, ngram_join, packing, pii, quality, spelling, toxicity, vector_dedup
from plantlens.llm.common import settle, table

#: Documents of more tokens than this are marked by op8.
TOKEN_LIMIT = 1024


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents; digests of the ids and of the decoded bytes."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents"), ranks, offsets=True, decoded=True)
    digest = lambda c: F.sha2(c, 256).alias(f"{c}_sha256")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), digest("ids"), digest("decoded"), digest("offsets"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = html_text.extract(table(spark, sf_dir, "pages"), keep=("url",))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors among all embeddings."""
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in all documents."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the 5-word Jaccard join of all documents."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    counts = bpe.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all documents by base rules and risk-controlled cutoffs."""
    measured = settle(quality.measure(table(spark, sf_dir, "documents")))
    verdicts = quality.judge(measured, quality.calibrate(measured, table(spark, sf_dir, "labels")))
    return verdicts.select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; labels of held-out rows are never read by the fit."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(documents, labels, ~toxicity.held_out())
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.CUTOFF).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best collocations of all documents in each language."""
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by counts and by a log-bilinear model."""
    return language_model.score_texts(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_html_extraction, op3_embedding_near_dedup, op4_best_fit_packing, op5_license_scan, op6_pii, op7_ngram_jaccard, op8_token_counts, op9_quality_rules, op10_toxicity, op11_spelling_variants, op12_collocations, op13_language_model)}
ORACLES: dict[str, str] = {"op9_quality_rules": quality.ORACLE}
