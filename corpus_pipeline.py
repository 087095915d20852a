"""Documents to a training mix: language, near copies, repeated passages, benchmark, mix.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written to the
shared folder and read again as the next stage's documents. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playtrace.llm import decontaminate, ecoc_lang, mixing, substrings, tensor_minhash
from playtrace.llm.tables import restored, table
from playtrace.scratch import saved

#: Texts whose best language has a lower probability are rejected.
MIN_LANGUAGE_SCORE = 0.4
#: Words of a passage that may stand in one place only.
PASSAGE_WORDS = 30


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: texts without a letter or without a likely language go."""
    found = ecoc_lang.identify(docs, F.lit(True), keep_text=True)
    found = found.where((F.col("lang_pred") != ecoc_lang.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return restored(found, docs, "doc_id", "text", "t")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; repeated rows once."""
    groups = saved(tensor_minhash.near_duplicates(docs, shingle=5, percent=80))
    gone = groups.where("k != component_id").select(F.col("k").alias("doc_id")).distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    repeated = groups.where("k = component_id").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    repeated = saved(repeated.where("n > 1").select(F.col("k").alias("doc_id")))
    if repeated.limit(1).count():
        once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(once)
    return kept.select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand in an earlier document; emptied documents go."""
    found = substrings.dedup_substrings(docs, size=PASSAGE_WORDS, layout=True)
    found = found.where("n_removed < n_words or n_words = 0")
    before = F.col("row").getField("n_chars")
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(before).cast("long")
    found = found.withColumn("row", F.col("row").withField("n_chars", n_chars))
    return restored(found, docs, "doc_id", "text", "kept")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document how many of its words the mix takes."""
    return mixing.mix_counts(docs).select(
        F.col("k").alias("doc_id"), "source", "size", "source_size", "target", "taken"
    )


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: Learned models and similarity search are beyond SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result saved and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
