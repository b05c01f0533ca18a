"""The corpus pipeline: each stage works on all that its predecessor kept.

Null and empty texts fail the quality rules, like every text of fewer than 50 words; null and repeated ids are rows like
any others until near dedup, which keeps rows without an id and takes rows with one id as one document.  An empty table gives
empty stages.  Extra columns are carried up to the last stage, but for those whose names begin with two underscores.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm import decontaminate, line_dedup, minhash, quality, unigram_pieces
from surveyspark.llm.tables import plain, shared_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the plain rules and the language-model ratio accept."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in many of them."""
    return line_dedup.LineIndex(spark).add(docs).drop(docs).select(*plain(docs).columns)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the one with the least id."""
    return minhash.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("__leaks") == 0).select(*plain(docs).columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as piece ids, with whether decoding gives its text back."""
    coded = unigram_pieces.decode(unigram_pieces.encode(docs.select("doc_id", "text")))
    same = F.col("__decoded") == F.replace("text", F.lit(unigram_pieces.MARK), F.lit(" "))
    return coded.select("doc_id", F.size("__ids").alias("n_pieces"), F.col("__ids").alias("ids"), same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("pieces", encode_pieces),
]

#: The language-model ratio, minima and encodings have no SQL form; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = shared_path(spark, f"pipeline-{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
