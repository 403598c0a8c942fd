"""The corpus pipeline: quality rules, near duplicates, benchmark passages, personal data, token ids.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and gives the next stage's docs.
Between two stages the documents are written as Parquet into the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickfield.llm import decontaminate, jaccard, pieces, pii, quality
from brickfield.llm.runtime import fresh_dir, table, until_the_end

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judge_quality(docs).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all without words, which are in no group.

    It is the one whose id names the group; of several such (repeated rows, or null ids alone) the least row.
    """
    grouped = jaccard.jaccard_components(docs, group_col="_near").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Rows in no group are told apart by all they hold, and equal ones counted; partial sums keep a frequent row small.
    row, alone = F.struct(*COLUMNS), F.col("_near").isNull()
    picked = grouped.groupBy("_near", F.when(alone, row).alias("_own")).agg(F.min(row).alias("_row"), F.count("*").alias("_n"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.when(alone, F.col("_n")).otherwise(F.lit(1).cast("long"))))
    return picked.select("_row", copies.alias("_k")).select("_row.*")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    found = pii.find_pii(docs).withColumn("text", F.col("redacted"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, instead of its text."""
    return pieces.encode_pieces(docs).drop("text")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", token_ids),
]

#: Fertility, homoglyph transducers and BPE are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = fresh_dir(spark, f"stage{k}")
            docs.write.parquet(path)
            until_the_end(spark, path)
            docs = spark.read.parquet(path)
    return docs
