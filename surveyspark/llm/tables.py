"""Written intermediate tables in the shared folder (lineage is cut there, so lost executors cost no recomputation)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.session import checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plain(docs: DataFrame) -> DataFrame:
    """Without the columns whose names begin with two underscores: those names are the operators' own."""
    return docs.drop(*[c for c in docs.columns if c.startswith("__")])


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and text columns (other columns, whatever their names, take no part), text null kept."""
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias(text_col))
