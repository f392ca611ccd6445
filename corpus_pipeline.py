"""Cleaning pipeline over `documents`: language ID, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet into the shared folder and reads
it back for the next stage. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.common import BROADCAST_IDS, materialize
from roadlens.llm.decontaminate import decontaminate
from roadlens.llm.language_id import fold, keep_identified, train
from roadlens.llm.near_dedup import near_duplicates
from roadlens.llm.packing import added_tokens, pack
from roadlens.llm.substring_dedup import dedup_substrings

#: Texts whose language has a lower posterior probability are rejected, as are those without a letter.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told. Learned from two thirds of the stage's own rows by id.

    Null, empty and letterless texts are rejected; rows are judged one by one, so repeated rows and rows without an id are kept alike.
    """
    learn = docs.where(F.col("doc_id").isNotNull() & ~fold("doc_id", 3, 1))
    return keep_identified(docs, train(learn), LEAST_SCORE)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): that of smallest id.

    Rows are judged by id and text: of rows equal in both one stays, rows of one id with different texts are different documents.
    Rows without an id stay. Texts are shuffled only where more than BROADCAST_IDS rows go.
    """
    rows = docs.withColumn("text_hash", F.xxhash64("text"))
    found = materialize(near_duplicates(docs), "near-decided")
    key = ["doc_id", "text_hash"]
    gone = found.where("not kept").select(*key).distinct()
    repeated = found.where("kept and doc_id is not null").groupBy(*key).count().where("count > 1").select(*key)
    few = lambda ids: F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    left = rows.join(few(gone), key, "left_anti")
    if repeated.limit(1).count():
        again = few(repeated)
        left = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates(key))
    return left.select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of text that an earlier document has; those of which nothing is left go, null and empty texts too.

    Rows of one id with different texts are different documents; rows without an id stay as they are.
    """
    return dedup_substrings(docs, report=False).select(*docs.columns).where(F.length(F.trim("text")) > 0)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, row by row; those that are mostly such passages go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids; a null or empty text is the end id alone."""
    return pack(docs, added=added_tokens()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Naive Bayes over hashed n-grams and tokenisation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
