"""The text pipeline: stages over ``documents``, each written and read again.

Language ID drops documents without a clear language, line dedup takes
boilerplate lines out, the n-gram Jaccard join keeps one document of each group
of near copies, decontamination drops documents that hold a benchmark item, and
packing lays the rest out in sequences of 2048 tokens.  Every stage works on
all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txguard.llm.decontaminate import decontaminate
from txguard.llm.jaccard_join import jaccard_dedup
from txguard.llm.langid import predict, train
from txguard.llm.line_dedup import line_dedup
from txguard.llm.packing import pack_documents
from txguard.llm.queries import tokenizer_path
from txguard.llm.scratch import Scratch
from txguard.session import ship_package, small_batches

#: A document is rejected if less of it than this is known to its best language (words, or n-grams of other words), or if
#: it has no letter.  Unlike a score over the learned languages this does not depend on how many there are.
MIN_KNOWN = 0.5
#: Near copies share 80 % of their five-word shingles or more; op8_ngram_jaccard has three words and 90 %.
COPY_SHINGLE, COPY_PERCENT = 5, 80


def _prepare(spark: SparkSession) -> None:
    ship_package(spark)
    small_batches(spark)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    found = predict(spark, docs, train(spark, docs))
    return found.filter((F.col("lang_pred") != "und") & (F.col("known") >= MIN_KNOWN)).select(docs.columns)


def line_cleaning(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    cleaned = line_dedup(spark, docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return jaccard_dedup(spark, docs, shingle=COPY_SHINGLE, percent=COPY_PERCENT)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return decontaminate(spark, docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return pack_documents(spark, docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_cleaning),
    ("ngram_jaccard", near_copies),
    ("decontamination", benchmark_leaks),
    ("packing", packing),
]

#: Trained scores and token ids are not SQL; README says what the stages are tested against.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
