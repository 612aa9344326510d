"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, source mixing, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` writes each stage as Parquet in the shared folder of
``spark.checkpoint.dir`` and reads it back for the next. ``n_chars`` is recomputed where a stage changes a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlake.llm import jaccard, linededup, mixing, packing, quality
from cinderlake.llm._util import table_cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor match a learned rule; those rejected go."""
    rules = quality.learn_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, rules, keep_text=True).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that are boilerplate across sites."""
    out = linededup.dedup_lines(docs)
    n = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id; all documents without a partner."""
    return jaccard.keep_one(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as the queue takes it."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Learned rules, hash banding and tokenization are beyond SQL; tests/llm/test_pipeline.py holds a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = table_cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
