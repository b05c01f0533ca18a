"""Order statistics and running sums that never put a whole group in one task.

A window ``partitionBy(g).orderBy(x)`` sends every row of group ``g`` to one
task.  When one group holds a third of the table that task holds a third of
the table.  The helpers here split the order key into buckets first:

1. a partial aggregation counts (or sums) per ``(group, bucket)`` -- at most
   ``groups x buckets`` rows however large the input is;
2. a window over that small histogram gives each bucket its offset;
3. the exact running value of a row is its bucket's offset plus a window
   *inside* its ``(group, bucket)``; those windows are many and small.

Ties are handled by pre-aggregating to distinct order values where the
caller asks for it, so a value repeated a billion times is one row.
All results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKETS = 1 << 16


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
            null_safe: bool = True) -> DataFrame:
    """Equi-join on ``keys`` (null-safe by default) keeping one copy of each key."""
    keys = list(keys)
    if not keys:
        raise ValueError("join_on needs at least one key (no cross joins)")
    if not null_safe:
        return left.join(right, keys, how)
    r = right
    ren = {k: f"__r_{k}" for k in keys}
    for k, v in ren.items():
        r = r.withColumnRenamed(k, v)
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[ren[k]])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out.drop(*ren.values())


def _default_for(dt) -> Column | None:
    from pyspark.sql import types as T
    if isinstance(dt, T.NumericType):
        return F.lit(0).cast(dt)
    if isinstance(dt, T.StringType):
        return F.lit("")
    if isinstance(dt, T.BooleanType):
        return F.lit(False)
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(0).cast("timestamp").cast(dt)
    return None


def with_group_keys(df: DataFrame, cols: Sequence[str], prefix: str = "_g") -> tuple[DataFrame, list[str]]:
    """Non-null stand-ins for group columns: (value or a type default, is-null flag) per column.

    Grouping, partitioning and equi-joining on these is the same as on the
    original columns with null as its own group, but the join keys are plain
    columns: a join can reuse the hash partitioning a window already made
    instead of shuffling the big side again on ``coalesce``/``isnull``
    expressions.  Columns of other types keep their value (null-safe joins
    are then used by :func:`join_on`).
    """
    keys = []
    for i, c in enumerate(cols):
        d = _default_for(df.schema[c].dataType)
        if d is None:
            keys.append(c)
            continue
        df = df.withColumn(f"{prefix}{i}v", F.coalesce(F.col(c), d)).withColumn(f"{prefix}{i}n", F.col(c).isNull())
        keys += [f"{prefix}{i}v", f"{prefix}{i}n"]
    return df, keys


def range_bucket(v: Column, lo: Column, hi: Column, n_buckets: int) -> Column:
    """Monotone bucket id in [0, n_buckets) of ``v`` within [lo, hi]."""
    span = hi.cast("double") - lo.cast("double")
    raw = F.floor((v.cast("double") - lo.cast("double")) / span * F.lit(float(n_buckets)))
    return F.when(span <= 0, F.lit(0)).otherwise(
        F.least(F.greatest(raw, F.lit(0)), F.lit(n_buckets - 1))).cast("int")


def with_range_buckets(df: DataFrame, part_cols: Sequence[str], value_col: str,
                       bucket_col: str = "_b", n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Add ``bucket_col``: an equal-width bucket of ``value_col`` per group (min/max pass)."""
    mm = df.groupBy(*part_cols).agg(F.min(value_col).alias("_lo"), F.max(value_col).alias("_hi"))
    out = join_on(df, mm, part_cols)
    return out.withColumn(bucket_col, range_bucket(F.col(value_col), F.col("_lo"), F.col("_hi"),
                                                   n_buckets)).drop("_lo", "_hi")


def with_sorted_buckets(df: DataFrame, part_cols: Sequence[str], value_col: str, bucket_col: str = "_b") -> DataFrame:
    """Add ``bucket_col``: the number of the range partition that holds the row.

    The frame is range-partitioned by ``(part_cols, value_col)`` and written once
    to the shared checkpoint folder, so the number is monotone in the value
    within a group, fixed from then on, and every bucket has about the same
    number of rows however the values are spread or share prefixes.  Rows with
    equal keys share a bucket: reduce to distinct values first.
    """
    from surveyspark.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(*part_cols, value_col).withColumn(bucket_col, F.spark_partition_id()).checkpoint(eager=True)


def prefix_sums(df: DataFrame, part_cols: Sequence[str], order_cols: Sequence[str],
                sum_cols: Sequence[str], bucket_col: str, descending: bool = False,
                inclusive: bool = False) -> DataFrame:
    """For each row add ``<c>_before``: the sum of ``c`` over rows of the same
    group that come earlier in ``order_cols`` (plus the row itself when
    ``inclusive``).

    ``bucket_col`` must be monotone (non-decreasing) in ``order_cols``.
    Rows must be totally ordered by ``order_cols`` within a group; pre-aggregate
    ties first when they can occur.
    """
    part_cols, order_cols, sum_cols = list(part_cols), list(order_cols), list(sum_cols)
    bucket_order = F.col(bucket_col).desc() if descending else F.col(bucket_col).asc()
    row_order = [F.col(c).desc() if descending else F.col(c).asc() for c in order_cols]
    keyed, keys = with_group_keys(df, part_cols, "_pk")
    plain = all(k not in part_cols for k in keys)

    hist = keyed.groupBy(*keys, bucket_col).agg(*[F.sum(c).alias(c) for c in sum_cols])
    wb = Window.partitionBy(*keys).orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = hist.select(*keys, bucket_col,
                          *[F.coalesce(F.sum(c).over(wb), F.lit(0)).alias(f"_off_{c}")
                            for c in sum_cols])

    frame_end = 0 if inclusive else -1
    wr = Window.partitionBy(*keys, bucket_col).orderBy(*row_order).rowsBetween(
        Window.unboundedPreceding, frame_end)
    inner = keyed.select("*", *[F.coalesce(F.sum(c).over(wr), F.lit(0)).alias(f"_in_{c}")
                                for c in sum_cols])
    # plain keys: the join reuses the window's partitioning of the big side
    out = join_on(inner, offsets, keys + [bucket_col], null_safe=not plain)
    for c in sum_cols:
        out = out.withColumn(f"{c}_before", F.col(f"_off_{c}") + F.col(f"_in_{c}"))
    extra = [k for k in keys if k not in part_cols]
    return out.drop(*[f"_off_{c}" for c in sum_cols], *[f"_in_{c}" for c in sum_cols], *extra)


def distinct_values(values: DataFrame, part_cols: Sequence[str], value_col: str) -> DataFrame:
    """(part_cols, _v, _n, _b): distinct non-null values with their multiplicity, in sorted buckets.

    A value repeated a billion times is one row.  The table is written once;
    ranking reads it several times, and its lineage (scan, joins, dedup) is cut.
    """
    v = values.select(*part_cols, F.col(value_col).alias("_v")).where(F.col("_v").isNotNull())
    return with_sorted_buckets(v.groupBy(*part_cols, "_v").agg(F.count(F.lit(1)).alias("_n")), part_cols, "_v")


def select_ranks(values: DataFrame, part_cols: Sequence[str], value_col: str, ranks: DataFrame) -> DataFrame:
    """Exact order statistics: for each ``(group, rank)`` row of ``ranks`` return
    the ``rank``-th smallest non-null ``value_col`` of that group (1-based).

    A histogram over sorted buckets tells which bucket holds each rank; windows
    run inside those buckets only, so no task ever holds a whole group.

    Output columns: ``part_cols``, ``rank``, ``value``.  Ranks outside
    ``[1, n]`` produce no row.
    """
    part_cols = list(part_cols)
    return _ranks_in_buckets(distinct_values(values, part_cols, value_col), part_cols, ranks)


def _ranks_in_buckets(dv: DataFrame, part_cols: list[str], ranks: DataFrame) -> DataFrame:
    hist = dv.groupBy(*part_cols, "_b").agg(F.sum("_n").alias("_bn"))
    wb = Window.partitionBy(*part_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_hi_rank", F.sum("_bn").over(wb)).withColumn(
        "_lo_rank", F.col("_hi_rank") - F.col("_bn") + 1)

    rb = join_on(ranks.select(*part_cols, "rank"), hist, part_cols).where(
        F.col("rank").between(F.col("_lo_rank"), F.col("_hi_rank"))).select(
        *part_cols, "rank", "_b", "_lo_rank")

    wanted = rb.select(*part_cols, "_b").distinct()
    inb = join_on(dv, wanted, part_cols + ["_b"], "left_semi")
    wv = Window.partitionBy(*part_cols, "_b").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, 0)
    inb = inb.withColumn("_cum", F.sum("_n").over(wv))

    local_rank = F.col("rank") - F.col("_lo_rank") + 1
    out = join_on(rb, inb, part_cols + ["_b"]).where(
        (local_rank > F.col("_cum") - F.col("_n")) & (local_rank <= F.col("_cum")))
    return out.select(*part_cols, "rank", F.col("_v").alias("value"))


def exact_quantiles(values: DataFrame, part_cols: Sequence[str], value_col: str, quantiles: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles (the pandas / ``percentile_cont`` rule), exact.

    Returns ``part_cols``, ``q``, ``value`` (double).  Groups whose values are
    all null produce no row.  With no ``part_cols`` the whole frame is one group.
    """
    part_cols = list(part_cols)
    if not part_cols:
        return exact_quantiles(values.withColumn("__all", F.lit(0)), ["__all"], value_col, quantiles).drop("__all")
    dv = distinct_values(values, part_cols, value_col)
    counts = dv.groupBy(*part_cols).agg(F.sum("_n").alias("_cnt"))
    q = F.explode(F.array(*[F.lit(float(x)) for x in quantiles])).alias("q")
    h = (F.col("_cnt") - 1) * F.col("q")
    qs = counts.select(*part_cols, "_cnt", q).withColumn("_h", h)
    side = F.explode(F.array(F.struct(F.lit("lo").alias("side"), (F.floor("_h").cast("long") + 1).alias("rank")),
                             F.struct(F.lit("hi").alias("side"), (F.ceil("_h").cast("long") + 1).alias("rank")))).alias("s")
    wanted = qs.select(*part_cols, "q", "_h", side).select(*part_cols, "q", "_h", "s.side", "s.rank")
    found = _ranks_in_buckets(dv, part_cols, wanted.select(*part_cols, "rank").distinct())
    both = join_on(wanted, found, part_cols + ["rank"])
    g = both.groupBy(*part_cols, "q", "_h").agg(
        F.max(F.when(F.col("side") == "lo", F.col("value").cast("double"))).alias("_x"),
        F.max(F.when(F.col("side") == "hi", F.col("value").cast("double"))).alias("_y"))
    value = F.col("_x") + (F.col("_h") - F.floor("_h")) * (F.col("_y") - F.col("_x"))
    return g.select(*part_cols, "q", value.alias("value"))
