"""A corpus pipeline: quality rules, toxicity, near-duplicates, personal data, packing.

Each stage is written as Parquet into the shared folder and read again, so that a lost executor costs a reread.

All stages take rows one by one: null texts count as empty, texts of any length are handled whole, equal rows (ties,
repeated rows) get equal verdicts, columns besides those of documents are not read, and an empty table gives an empty
table. What a stage does with empty texts, nulls and repeated ids beyond that is said at the stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.llm import ngram_join, packing, pii, quality, toxicity
from plantlens.llm.common import settle, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rules or the risk-controlled cutoffs reject; so empty texts go. Rows that repeat an id are judged by their own texts."""
    labels = table(spark, sf_dir, "labels")
    measured = settle(quality.measure(docs, keep=COLUMNS).withColumn("severity", quality.severity()))
    cutoffs = quality.calibrate(measured, labels)
    return quality.judge(measured, cutoffs).filter("kept").select(*COLUMNS)


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents predicted as toxic. Texts without words score 0 and stay; rows that repeat an id are scored by their own texts."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    scored = toxicity.score(docs, model, keep=COLUMNS[1:])
    return scored.filter(F.col("score") < toxicity.CUTOFF).select(*COLUMNS)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: the one with the least id (null first).

    Rows are told apart by id and text: rows of one id with unlike texts are documents of their own, rows that repeat both are
    copies, of which one stays. Texts without words are nobody's copies and stay.
    """
    keyed = docs.select(*COLUMNS).withColumn("_row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    ids = settle(keyed.select("_row", "doc_id")).distinct()
    parts = settle(ngram_join.jaccard_components(keyed.select("_row", "text"), "_row").filter("n_shingles > 0"))
    copies = settle(parts.groupBy("_row", "component_id").agg(F.count("*").alias("copies")).join(ids, "_row"))
    first = copies.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row"))["_row"].alias("_first"))
    gone = copies.join(first, "component_id").filter(F.col("_row") != F.col("_first")).select("_row")
    left = keyed.join(gone, "_row", "left_anti")
    twice = settle(copies.filter("copies > 1").select("_row"))
    if twice.limit(1).count():  # only rows that repeat are shuffled by their key
        left = left.join(twice, "_row", "left_anti").union(left.join(twice, "_row", "left_semi").dropDuplicates(["_row"]))
    return left.select(*COLUMNS)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; n_chars follows. Null texts stay null; rows that repeat an id are taken one by one."""
    found = pii.find(docs, redact=True, keep=("lang", "source"))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: one row per piece. A null or empty text is the end mark alone; every row is packed."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("toxicity", keep_civil),
    ("n-gram Jaccard join", keep_distinct),
    ("PII", hide_personal),
    ("best-fit packing", pack),
]

#: Toxicity, the join and packing are beyond SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/plantlens/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{k}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
