"""Corpus pipeline: toxic documents go, repeated lines go, one of each near-duplicate group stays, contaminated documents go, the rest is packed.

Each stage reads what its predecessor wrote.  The last returns the packed pieces; the others return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm import decontam, line_dedup, minhash, packing, toxicity
from wardlens.llm.common import cut, read
from wardlens.llm.queries import vocabulary

#: A document goes in the line stage if so many hundredths of its words are in lines of one other document: the similarity of the next stage.
ONE_SOURCE = 80


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, keep=True)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go; so does a document of which nothing is left, or only scraps of a copy.  ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs, least_words=line_dedup.EVERY_LINE, one_source=ONE_SOURCE)
    left = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.withColumn("n_chars", n_chars).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays."""
    return minhash.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxic_stage), ("line_dedup", line_stage), ("near_duplicates", near_stage), ("decontaminate", benchmark_stage), ("packing", packing_stage)]

#: SQL cannot express the toxicity model or the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written as Parquet in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
