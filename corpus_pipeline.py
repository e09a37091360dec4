"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, then the mix.

Every stage but the last returns the columns of documents, with texts as the stage leaves them; a stage's decisions take
effect on the rows that the next one gets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import leaks, lines, mixing, neardup, quality
from docketry.llm._shared import table, written
from docketry.llm.queries import MIX_WEIGHTS, mix_levels

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; kept ones lose the lines that failed."""
    judged = quality.clean_lines(docs, carry=("lang", "source"))
    kept = judged.where("kept").withColumnRenamed("clean_text", "text")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document each; documents left without a word go."""
    cleaned = lines.dedup_lines(docs, carry=("lang", "source")).withColumnRenamed("kept_text", "text")
    left = cleaned.where(F.col("text").rlike(mixing.WORD))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def of_rows(docs: DataFrame, picked: DataFrame, how: str) -> DataFrame:
    """Semi- or anti-join of documents with doc_id and text_hash, null ids included."""
    hashed, p = docs.withColumn("text_hash", F.xxhash64("text")), picked.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).distinct()
    return hashed.join(p, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), how)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, and one row of each text of that.

    A row is known by its id and text: texts that share an id stay, rows with a null id stay unless others hold their set.
    """
    kept = neardup.near_duplicates(docs, with_hash=True).where("kept")
    return of_rows(docs, kept, "left_semi").dropDuplicates(["doc_id", "text_hash"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, each row by its own text and whatever its id."""
    found = leaks.find_leaks(docs, table(spark, sf_dir, "benchmark"), with_hash=True)
    return of_rows(docs, found.where("contaminated"), "left_anti").select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix selects, with their place in its tree and how many copies it takes."""
    mixed = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, share=0.9, max_epochs=3, seed=17).where("n_copies > 0")
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "n_copies")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("source mix", source_mix),
]

#: Near copies and the mix's hash order have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder, as the next stages read them again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
