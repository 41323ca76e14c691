"""The corpus pipeline: stages over the documents table, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import decontamination, line_dedup, mixing, quality, rows, simhash
from voxtable.session import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier does not reject."""
    model = quality.fit_quality(rows.table(spark, sf_dir, "documents").select("doc_id", "text"), rows.table(spark, sf_dir, "labels"))
    return quality.score_quality(docs.select(*COLUMNS), model, "__score").where(F.col("__score") >= 0.3).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines found in ten or more of the documents that are left."""
    kept = line_dedup.drop_repeated_lines(docs.select(*COLUMNS))
    changed = kept.withColumns({"text": F.when(F.col("text").isNotNull(), F.col("kept_text")), "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))})
    return changed.select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: SimHash fingerprints, then five-word shingles of similarity 0.8 or more."""
    return simhash.one_of_each(docs.select(*COLUMNS), shingle=5, similarity=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark item: 0.8 or more of its five-word shingles."""
    return decontamination.without_contaminated(docs.select(*COLUMNS), rows.table(spark, sf_dir, "benchmark"), shingle=5, threshold=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the mix takes; ``repeats`` says how often the whole document is taken."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where(F.col("taken") > 0)
    return mixed.withColumn("repeats", (F.col("taken") / F.col("size")).cast("int"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources", mixing_stage),
]

#: A trained network scores the documents, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline")
    return docs
