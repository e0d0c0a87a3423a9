"""A training corpus from `documents`, in five stages. Each takes what the one before kept and, but for
the last, returns the columns of documents."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from labelaudit.llm import decontaminate, jaccard_join, language, line_runs, packing
from labelaudit.session import configure, step, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the identifier knows. Texts that are null or without letters go, and
    those whose calibrated score is below the threshold that loses 0.1 % of known examples."""
    model = language.fit(docs)
    named = language.identify(docs, model, COLUMNS)
    return named.where(~model.rejects(F.col("lang_pred"), F.col("score"))).select(COLUMNS)


def no_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines of 50 words or more; those of which nothing is
    left go, n_chars counts what is left of the others."""
    cut = line_runs.drop_repeated_lines(docs)
    kept = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with what tells rows apart in every scan, so that no numbered copy is stored: the id, nulls last, and
    a hash of the text. Rows that it does not tell apart have equal texts."""
    return docs.withColumn("_lot", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("hash")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingle sets the one of least doc_id (nulls last, of equal ids the
    one of least text hash, of equal texts one row); documents without words are in no group."""
    rows = keyed(docs)

    def later() -> DataFrame:
        groups = jaccard_join.near_duplicates(rows.select(F.col("_lot").alias("doc_id"), "text")).where("n_shingles > 0")
        keys = groups.groupBy(F.col("doc_id").alias("_lot")).agg(F.min("component_id").alias("first"), F.count("*").alias("n"))
        return keys.select("_lot", (F.col("_lot") != F.col("first")).alias("_gone"), "n").where("_gone OR n > 1").drop("n")

    told = line_runs.with_gone(rows, step(spark, later, "losers"))
    copies = told.where("NOT _gone").dropDuplicates(["_lot"])
    return told.where("_gone IS NULL").unionByName(copies).select(COLUMNS)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = keyed(docs)
    found = stored(decontaminate.contaminated(rows, bench, ["_lot"]).select("_lot").distinct(), "leaks")
    return rows.join(found, "_lot", "left_anti").select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, packed into sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language_id", known_language), ("line_dedup", no_repeated_lines), ("ngram_jaccard_join", one_of_each_group),
          ("benchmark_decontamination", no_benchmark), ("best_fit_packing", packed)]

# A trained model, tokens and packing are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's documents written to the shared folder and read again."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
