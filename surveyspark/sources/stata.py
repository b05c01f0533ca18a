"""One-off ingest of Stata ``.dta`` files into Parquet.

Spark's binary-file source lists and reads the files, so any file system that
Spark knows will do; each task decodes its files in chunks with pandas' Stata
reader (only the requested columns) and yields Arrow batches through
``mapInPandas``.  A file is one row, so it must be below Spark's 2 GB limit for
one value.  The result is written once as Parquet, and every later job reads
the columnar copy (pushdown and pruning apply from then on).
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from surveyspark.spec import MISSING_CODES


def read_stata(spark: SparkSession, path_glob: str, schema: StructType, chunksize: int = 100_000) -> DataFrame:
    """Distributed read of ``.dta`` files into a DataFrame with ``schema``."""
    files = spark.read.format("binaryFile").load(path_glob).select("path", "content")
    return decode_stata(files.repartition(max(1, spark.sparkContext.defaultParallelism), "path").select("content"), schema, chunksize)


def decode_stata(files: DataFrame, schema: StructType, chunksize: int = 100_000) -> DataFrame:
    """Rows of Stata files given as a binary column ``content``.

    ``schema`` names the columns to keep (matched case-insensitively) and their
    Spark types.  Stata missing values come through as null.
    """
    from surveyspark.session import ship_module
    ship_module(__name__)
    names = [f.name for f in schema.fields]
    kinds = {f.name: f.dataType.typeName() for f in schema.fields}

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                with pd.read_stata(io.BytesIO(content), iterator=True, convert_categoricals=False) as rdr:
                    lower = {c.lower(): c for c in rdr.variable_labels()}
                cols = [lower[n.lower()] for n in names if n.lower() in lower]
                with pd.read_stata(io.BytesIO(content), columns=cols, convert_categoricals=False, chunksize=chunksize) as rdr:
                    for chunk in rdr:
                        chunk.columns = [c.lower() for c in cols]
                        yield pd.DataFrame({n: _as_spark_type(chunk[n.lower()], kinds[n]) if n.lower() in chunk.columns else None for n in names})

    return files.select("content").mapInPandas(decode, schema)


def _as_spark_type(col: pd.Series, kind: str) -> pd.Series:
    """Stata stores missing numbers as NaN-like codes and has no missing string:
    integers come back as nullable integers, strings as text ('' when empty)."""
    if kind in ("integer", "long", "short", "byte"):
        return pd.to_numeric(col, errors="coerce").astype("Int64")
    if kind == "string":
        return col.astype("string").fillna("")
    return col


def encode_stata(df: DataFrame) -> DataFrame:
    """Each Arrow batch of ``df`` as the bytes of one ``.dta`` file (column ``content``): integers with missing values
    become Stata numeric missing, strings keep Stata's empty-string convention."""
    from surveyspark.session import ship_module
    ship_module(__name__)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            out = pdf.copy()
            for c in out.columns:
                if pd.api.types.is_integer_dtype(out[c]) or out[c].dtype.name.startswith("Int"):
                    out[c] = out[c].astype("float64")
                elif out[c].dtype == object or pd.api.types.is_string_dtype(out[c]):
                    out[c] = out[c].fillna("").astype(str)
            file = io.BytesIO()
            out.to_stata(file, write_index=False, version=118)
            yield pd.DataFrame({"content": [file.getvalue()]})

    return df.mapInPandas(encode, "content binary")


def ingest_stata(spark: SparkSession, path_glob: str, schema: StructType, out_path: str,
                 chunksize: int = 100_000) -> str:
    """Read ``.dta`` files and write them once as Parquet; returns ``out_path``."""
    read_stata(spark, path_glob, schema, chunksize).write.mode("overwrite").parquet(out_path)
    return out_path


def sentinel_counts(df: DataFrame, cols: Sequence[str], codes: Sequence[int] = MISSING_CODES) -> DataFrame:
    """Rows per column still holding a sentinel code (checked right after ingest)."""
    return df.agg(*[F.sum(F.col(c).isin(list(codes)).cast("long")).alias(c) for c in cols])
