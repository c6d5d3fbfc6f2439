"""The corpus pipeline: language ID, exact and near deduplication, mixing, piece encoding.

Each stage takes the documents that its predecessor kept, with all their columns, and returns them less those that it
drops (the mixing stage repeats some); the last returns the encodings.  Between stages rows are written and read.

Cases, for every stage: columns beside doc_id and text are handed on untouched, whatever their names; an empty table
gives an empty table; texts of any length are read whole.  What nulls, ties and repeated rows give is said per stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import exact_dedup, language_id, mixing, near_dedup, piece_sampling
from tidewire.llm.common import free, keep, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (a null text, or one without a letter) go; equal rows and null ids are judged alike."""
    samples = language_id.training_sample(docs, train_only=False)
    lang, score = free("_lang", docs), free("_score", docs)
    return language_id.with_language(docs, samples, lang=lang, score=score, most_chars=1_000_000).where(F.col(lang) != language_id.UNKNOWN).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) the row with the largest id stays, once; of rows with that id and text any one.

    Null ids stay only where the text has no other.
    """
    sha, one, dup = (free(n, docs) for n in ("_sha", "_one", "_dup"))
    rows = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256))
    found = keep(exact_dedup.exact_dedup(docs, stays="max").select(F.col("doc_id").alias(one), F.col("text_sha256").alias(dup), F.col("kept").alias("kept_")), "exact")
    gone = found.where(~F.col("kept_")).select(one, dup)
    out = rows.join(gone, (rows[sha] == gone[dup]) & rows["doc_id"].eqNullSafe(gone[one]), "left_anti")
    again = found.where("kept_").groupBy(one, dup).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    if not again.isEmpty():  # repeated rows
        out = out.dropDuplicates(["doc_id", sha])
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five words, a similarity of 0.8.

    That is the one with the smallest id, all of its rows if it is repeated; null ids and texts without words stay.
    """
    one = free("_one", docs)
    found = keep(near_dedup.near_dedup(docs).select(F.col("doc_id").alias(one), F.col("kept").alias("kept_")), "near")
    gone = found.where(~F.col("kept_")).select(one)
    return docs.join(gone, docs["doc_id"] == gone[one], "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Good documents' tokens are raised by a quarter; every document stays, some are repeated.

    Null texts and null ids stay as they are; rows with equal ids are repeated alike (the most copies of any of them).
    """
    one, copies, each = (free(n, docs) for n in ("_one", "_copies", "_each"))
    rated = mixing.mix(docs, table(spark, sf_dir, "labels"), lift={"good": 1.25}, low=1.0)
    extra = rated.where(F.col("copies") > 1).groupBy(F.col("doc_id").alias(one)).agg(F.max("copies").alias(copies))
    out = docs.join(extra, docs["doc_id"] == extra[one], "left")
    return out.withColumn(each, F.explode(F.sequence(F.lit(1), F.coalesce(F.col(copies), F.lit(1))))).select(*[docs[c] for c in docs.columns])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text; a null or empty text has one without pieces, repeated rows have equal ones."""
    return piece_sampling.encode(docs, most_chars=500_000)  # executors hold the earlier stages' heap


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("pieces", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
