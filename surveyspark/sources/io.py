"""Readers and writers: pruned loads, guarded loads and saves, label extracts,
the class-weight side table, and the space-delimited district list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from surveyspark.session import checkpoint_dir
from surveyspark.functions.exprs import present


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def load_pruned(spark: SparkSession, path: str, columns: Sequence[str], force: Sequence[str] = (),
                fmt: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """Read only ``columns`` (plus the ``force`` columns) with lower-case names.

    Column pruning reaches the scan (``ReadSchema`` lists only these).  A
    missing path raises FileNotFoundError naming it.
    """
    if not _path_exists(spark, path):
        raise FileNotFoundError(f"Data file not found: {path}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    try:
        df = reader.load(path)
    except AnalysisException as e:                 # e.g. removed between check and read
        raise FileNotFoundError(f"Data file not found: {path}") from e
    wanted = list(dict.fromkeys([*columns, *force]))
    cols = present(df, wanted)
    return df.select(*[F.col(c).alias(c.lower()) for c in cols])


def load_min_rows(spark: SparkSession, path: str, min_rows: int = 1, fmt: str = "parquet",
                  schema: StructType | None = None, description: str = "table") -> DataFrame:
    """Read a table and require at least ``min_rows`` rows.

    The check is ``limit(min_rows).count()``: it stops scanning as soon as
    enough rows are seen, instead of counting the whole table.
    """
    if not _path_exists(spark, path):
        raise FileNotFoundError(f"{description} not found: {path}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    got = df.limit(min_rows).count()
    if got < min_rows:
        raise ValueError(f"{description} at {path} has {got} rows; at least {min_rows} required")
    return df


def computed(df: DataFrame, counts: dict[str, Column] | None = None, also: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """(the rows, written once to the checkpoint folder; ``rows`` and the aggregates of ``counts``, observed by that write).

    No further job counts anything.  ``also`` names observations (``DataFrame.observe``) made earlier in the plan, whose
    values are added.  An observation next to the write counts every partition once; below a shuffle, a task that runs
    again after a lost executor would count twice, so make earlier ones in the stage that writes.

    Observations have names here and are read from the plan that ran.  An ``Observation`` object would leave a manager on
    the session that can't be serialised, after which MLlib models that hold a training summary can't transform.
    """
    checkpoint_dir(df.sparkSession)
    seen = df.observe("written", F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in (counts or {}).items()])
    out = seen.checkpoint(eager=True)
    metrics = seen._jdf.queryExecution().observedMetrics()
    values: dict = {}
    for name in ("written", *also):
        row = metrics.apply(name)
        values.update(zip(row.schema().fieldNames(), (row.get(i) for i in range(row.size()))))
    return out, values


def save_observed(df: DataFrame, path: str, counts: dict[str, Column] | None = None, fmt: str = "parquet", mode: str = "overwrite",
                  partition_by: Sequence[str] = ()) -> dict:
    """Write a non-empty table (error if empty, and what is at ``path`` stays); parents are created by the writer.

    The rows are computed once, into the checkpoint folder; that write observes ``rows`` and the aggregates of
    ``counts``, which are returned, and the table is written from there.
    """
    df, values = computed(df, counts)
    if not values["rows"]:
        raise ValueError(f"refusing to save an empty table to {path}")
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return values


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by: Sequence[str] = ()) -> str:
    """:func:`save_observed`, returning the path."""
    save_observed(df, path, None, fmt, mode, partition_by)
    return path


#: Name of the column that holds a line that doesn't fit the schema.
BAD_LINE = "_corrupt_record"


def load_csv(spark: SparkSession, path: str, schema: StructType | str, bad_path: str | None = None, header: bool = True,
             description: str = "CSV table") -> tuple[DataFrame, dict]:
    """(the rows that fit ``schema``, {"lines", "bad"}) of CSV files.

    A line that is too short or too long, or has a value that its type can't hold, is bad: it is left out of the rows,
    and written as it stands, with its file's name, to ``bad_path`` (Parquet, replaced; without a path it is only
    counted).  The files are parsed once, whole lines whichever columns are used later, into the checkpoint folder;
    that write observes both counts.  One line is one record; a quote inside a quoted field is doubled.  Empty fields are null; blank lines are no lines; files that only have a header
    give no rows.  A missing path raises FileNotFoundError naming it.
    """
    if not _path_exists(spark, path):
        raise FileNotFoundError(f"{description} not found: {path}")
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if {BAD_LINE, "_file"} & set(schema.names):
        raise ValueError(f"{BAD_LINE} and _file are kept for bad lines")
    read = (spark.read.format("csv").schema(StructType([*schema.fields, StructField(BAD_LINE, StringType())]))
            .option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE)
            .option("escape", '"').load(path))
    rows, counts = computed(read.withColumn("_file", F.col("_metadata.file_path")), {"lines": F.count(F.lit(1)), "bad": F.count(BAD_LINE)})
    if bad_path is not None:
        rows.where(F.col(BAD_LINE).isNotNull()).select(F.col("_file").alias("file"), F.col(BAD_LINE).alias("line")) \
            .write.mode("overwrite").parquet(bad_path)
    return rows.where(F.col(BAD_LINE).isNull()).select(*[f"`{c}`" for c in schema.names]), {k: counts[k] for k in ("lines", "bad")}


def label_extract(df: DataFrame, id_col: str, targets: Sequence[str]) -> DataFrame:
    """Row key and the targets present, keeping rows where all of them are present."""
    ts = present(df, targets)
    return df.select(id_col, *ts).dropna(how="any", subset=ts)


# -- class-weight side table ------------------------------------------------------------------

def save_class_weights(weights: DataFrame, path: str) -> str:
    """Write (label, weight) rows as JSON lines."""
    weights.select("label", F.col("weight").cast("double").alias("weight")).coalesce(1) \
        .write.mode("overwrite").json(path)
    return path


def load_class_weights(spark: SparkSession, path: str, labels: Sequence[str], default: float = 2.0) -> DataFrame:
    """(label, weight) for every label; labels absent from the file (or a missing
    file) get ``default``."""
    want = spark.createDataFrame([(l,) for l in labels], "label string")
    if _path_exists(spark, path):
        got = spark.read.schema("label string, weight double").json(path)
        return want.join(got, "label", "left").select(
            "label", F.coalesce(F.col("weight"), F.lit(float(default))).alias("weight"))
    return want.select("label", F.lit(float(default)).alias("weight"))


# -- district list ------------------------------------------------------------------------------

#: The state list goes into every task; a longer list is an error, never cut.
MAX_STATES = 100_000


def parse_district_lines(text: DataFrame, states: DataFrame, header_prefix: str = "S.No.") -> DataFrame:
    """Parse a space-delimited ``<n> <state> <district>`` list.

    ``text`` has one row per file (``read.text(path, wholetext=True)``).
    Inside each file a line that does not start with a number or the header
    continues the record before it (joined with a space, or directly when it
    starts with a hyphen).  Repeated page headers are dropped.  The state is
    the longest entry of ``states`` equal to the line's first words, however
    many words it has; the district is what follows it.  Every record gives a
    row, equal records included; without a known state the state is null and
    the district is the whole rest.  No join and no shuffle: the state list
    (at most ``MAX_STATES`` entries) is one array in each task.
    Output: (n, state, district).
    """
    name = F.col(f"`{states.columns[0]}`")
    known = states.select(name.alias("state")).where("state is not null").distinct()
    n_states, most_words = known.agg(F.count("*"), F.max(F.size(F.split("state", " ")))).first()
    if n_states > MAX_STATES:
        raise ValueError(f"{n_states} states; at most {MAX_STATES} can be sent to every task")
    hdr = header_prefix.replace(".", r"\.")
    body = F.regexp_replace(F.col("value"), r"\r\n?", "\n")
    body = F.regexp_replace(body, rf"\n(?!\d+ |{hdr})(-)", "$1")
    body = F.regexp_replace(body, rf"\n(?!\d+ |{hdr})", " ")
    lines = text.select(F.explode(F.split(body, "\n")).alias("line")).select(F.trim("line").alias("line"))
    recs = lines.where(F.col("line").rlike(r"^\d+ ")).select(
        F.regexp_extract("line", r"^(\d+) (.*)$", 1).cast("int").alias("n"),
        F.regexp_extract("line", r"^(\d+) (.*)$", 2).alias("rest"))
    recs = recs.withColumn("_words", F.split("rest", " ")).withColumn("_known", known.agg(F.collect_list("state")).scalar())
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("_words") - 1, F.lit(most_words or 1)))),
                        lambda k: F.array_join(F.slice("_words", F.lit(1), k), " "))
    recs = recs.withColumn("_heads", F.when(F.size("_words") > 1, F.array_intersect(heads, "_known")))
    # heads grow in length, and array_intersect keeps their order: the last one is the longest
    state = F.get("_heads", F.size("_heads") - 1)
    recs = recs.withColumn("state", state)
    district = F.when(F.col("state").isNull(), F.col("rest")).otherwise(F.trim(F.expr("substring(rest, length(state) + 2)")))
    return recs.select("n", "state", district.alias("district"))
