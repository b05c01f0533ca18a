"""Profiling and distributions.  Each operator is one aggregate pass (or a
partial-aggregating ``groupBy``) whose output is a long result table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.functions.exprs import col_lookup, count_if, numeric_columns, present
from surveyspark.functions.ordered import exact_quantiles
from surveyspark.operators.labels import prevalence
from surveyspark.operators.split import HASH_BITS, ROWS_PER_BUCKET, hash_bucket, hash_key
from surveyspark.spec import (GROUP_CODE_LABELS, MISSING_CODE_TEXT, OTHER_CODE_TEXT, PUBLISHED_PREVALENCE,
                              SurveySpec)


def bands_frame(spark, bands: Sequence[tuple[str, float, float]]) -> DataFrame:
    return spark.createDataFrame([(l, float(a), float(b)) for l, a, b in bands],
                                 "label string, lo double, hi double")


def prevalence_bands(df: DataFrame, spec: SurveySpec,
                     bands: Sequence[tuple[str, float, float]] | None = None) -> DataFrame:
    """Measured prevalence against inclusive bands: (label, prevalence, lo, hi, status).

    A label with a band but no column gives a FAIL row with null prevalence.
    Labels are matched to columns without regard to case; both sides have one row per label.
    """
    b = bands_frame(df.sparkSession, bands or spec.bands)
    p = prevalence(df, spec.targets).withColumnRenamed("label", "_column")
    j = b.join(p, F.lower("label") == F.lower("_column"), "left")
    status = F.when(F.col("prevalence").between(F.col("lo"), F.col("hi")), "PASS").otherwise("FAIL")
    return j.select("label", "prevalence", "lo", "hi", status.alias("status"))


def prevalence_vs_published(df: DataFrame, spec: SurveySpec, published: dict[str, float] | None = None
                            ) -> DataFrame:
    """Measured prevalence next to the published national figure: (label, measured, published, difference)."""
    pub = published or PUBLISHED_PREVALENCE
    p = prevalence(df, spec.targets)
    ref = F.create_map(*[x for k, v in pub.items() for x in (F.lit(k), F.lit(float(v)))])
    return p.select("label", F.col("prevalence").alias("measured"), ref[F.col("label")].alias("published"),
                    F.round(F.col("prevalence") - ref[F.col("label")], 4).alias("difference"))


def missing_rates(df: DataFrame, cols: Sequence[str] | None = None, positive_only: bool = True) -> DataFrame:
    """(column, missing, missing_rate) in one pass; by default only columns with
    missing values, sorted by rate descending."""
    cols = list(cols) if cols is not None else df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *[count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot(["__n"], cols, "column", "missing")
    out = long.select("column", "missing", F.round(
        F.col("missing") / F.greatest(F.col("__n"), F.lit(1)).cast("double"), 4).alias("missing_rate"))
    if positive_only:
        out = out.where(F.col("missing") > 0)
    return out.orderBy(F.col("missing_rate").desc(), F.col("column"))


def column_profile(df: DataFrame, cols: Sequence[str] | None = None, exact_distinct: bool = False
                   ) -> DataFrame:
    """Per column: dtype, null count, null share (4 places), numeric min/max, distinct count.

    Everything comes from one aggregate; distinct counts are HyperLogLog estimates (standard error
    5 %).  With ``exact_distinct`` they are counted from one shuffle of (column, value) pairs with map-side dedup.
    For profiles that later batches extend, see :func:`column_sketches`.
    """
    cols = list(cols) if cols is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    numeric = {c for c in cols if types[c].typeName() in
               ("byte", "short", "integer", "long", "float", "double", "decimal")}
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        aggs.append(count_if(F.col(c).isNull()).alias(f"nc_{c}"))
        mn = F.min(F.col(c)).cast("double") if c in numeric else F.lit(None).cast("double")
        mx = F.max(F.col(c)).cast("double") if c in numeric else F.lit(None).cast("double")
        aggs += [mn.alias(f"mn_{c}"), mx.alias(f"mx_{c}")]
        if not exact_distinct:
            aggs.append(F.approx_count_distinct(F.col(c)).cast("long").alias(f"nd_{c}"))
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("column"), F.lit(types[c].simpleString()).alias("dtype"),
        F.col(f"nc_{c}").alias("null_count"),
        F.round(F.col(f"nc_{c}") / F.greatest(F.col("__n"), F.lit(1)).cast("double"), 4).alias("null_pct"),
        F.col(f"mn_{c}").alias("min"), F.col(f"mx_{c}").alias("max"),
        (F.col(f"nd_{c}") if not exact_distinct else F.lit(None).cast("long")).alias("nunique"))
        for c in cols]))
    prof = wide.select(rows.alias("r")).select("r.*")
    if exact_distinct:
        long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
            [], cols, "column", "value").where(F.col("value").isNotNull())
        nd = long.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("nunique"))
        prof = prof.drop("nunique").join(nd, "column", "left").withColumn(
            "nunique", F.coalesce(F.col("nunique"), F.lit(0)).cast("long"))
    return prof


#: log2 of a sketch's registers; the standard error of an estimate is about 1.04 / sqrt(2^SKETCH_LG).
SKETCH_LG = 12


def column_sketches(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """What later batches can be added to, per column (and per value of the batch columns ``by``): rows, null count,
    numeric min and max, and a HyperLogLog sketch of the values (a few KB).

    One aggregation; rows of a batch are combined before the shuffle.  The result is made to be written (append each
    batch's) and read by :func:`merge_sketches`.  Empty input gives no rows with ``by``, else one per column with null sketch.
    """
    cols = [c for c in (list(cols) if cols is not None else df.columns) if c not in by]
    numeric = set(numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        v = F.col(f"`{c}`")
        aggs += [F.count(v).alias(f"c_{c}"), F.hll_sketch_agg(v.cast("string"), SKETCH_LG).alias(f"sk_{c}")]
        aggs += [(f(v) if c in numeric else F.lit(None)).cast("double").alias(f"{k}_{c}") for f, k in ((F.min, "mn"), (F.max, "mx"))]
    rows = [F.struct(F.lit(c).alias("column"), F.col("__n").alias("rows"), (F.col("__n") - F.col(f"`c_{c}`")).alias("null_count"),
                     F.col(f"`mn_{c}`").alias("min"), F.col(f"`mx_{c}`").alias("max"), F.col(f"`sk_{c}`").alias("sketch")) for c in cols]
    return df.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """One profile of all batches in a :func:`column_sketches` table: (column, rows, null_count, null_pct, min, max, nunique);
    ``nunique`` is estimated from the union of the sketches, so a value in several batches counts once."""
    g = sketches.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("null_count").alias("null_count"), F.min("min").alias("min"),
                                       F.max("max").alias("max"), F.hll_union_agg("sketch", F.lit(False)).alias("sketch"))
    share = F.round(F.col("null_count") / F.greatest(F.col("rows"), F.lit(1)).cast("double"), 4)
    return g.select("column", "rows", "null_count", share.alias("null_pct"), "min", "max",
                    F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).cast("long").alias("nunique"))


def profile_samples(df: DataFrame, id_col: str, cols: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """First ``k`` non-missing values of each column in id order: (column, pos, id, value).

    The per-column top-k is planned as a window group limit, so each partition
    ships at most ``k`` rows per column before the shuffle.
    """
    cols = [c for c in (cols or df.columns) if c != id_col]
    long = df.select(id_col, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [id_col], cols, "column", "value").where(F.col("value").isNotNull())
    w = Window.partitionBy("column").orderBy(id_col)
    return long.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).select(
        "column", F.col("pos").cast("int").alias("pos"), F.col(id_col).alias("id"), "value")


def head_rows(df: DataFrame, id_col: str, k: int = 3) -> DataFrame:
    """First ``k`` rows in id order (a top-k, no full sort)."""
    return df.orderBy(id_col).limit(k)


#: Leading hash bits that one histogram of :func:`sample_n` adds: at most 2^15 buckets.
SAMPLE_BITS = 15


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """A seeded sample of exactly ``n`` rows (all, if there are fewer), independent of partitioning: the ``n`` smallest
    md5(id|seed) keys, ties by id.

    Histograms over leading hash bits narrow down the bucket that holds the last key until it has at most
    ``rows_per_bucket`` rows; only these are ordered.  What is returned is a filter on the input, without shuffle or
    sort, however large ``n``.  Ids should be unique: of equal ids at the cut, any are taken to make up ``n``.
    """
    keyed = df.withColumn("_k", hash_key(id_col, seed)).withColumn("_b", hash_bucket(F.col("_k"), HASH_BITS))
    total, bits, lead, need = None, 0, 0, int(n)
    while bits < HASH_BITS and need > 0 and (total is None or total > rows_per_bucket):
        inside = keyed if not bits else keyed.where(F.shiftright("_b", HASH_BITS - bits) == lead)
        bits += SAMPLE_BITS
        hist = inside.groupBy(F.shiftright("_b", HASH_BITS - bits).alias("at")).agg(F.count(F.lit(1)).alias("n"))
        upto = hist.withColumn("upto", F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
        cut = upto.where(F.col("upto") >= need).orderBy("at").first()                  # of at most 2^15 rows
        if cut is None:
            return df
        total, lead, need = cut["n"], cut["at"], need - (cut["upto"] - cut["n"])
    if need <= 0:
        return df.limit(0)
    place = F.struct(F.col("_k").alias("k"), F.col(id_col).alias("i"))
    at = F.shiftright("_b", HASH_BITS - bits)
    inside = keyed.where(at == lead).select(place.alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    upto = inside.withColumn("upto", F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)))
    last = upto.where(F.col("upto") >= need).orderBy("p").first()                      # of at most rows_per_bucket distinct ids
    ties, wanted = last["n"], need - (last["upto"] - last["n"])
    key, same_id = F.lit(last["p"]["k"]), F.col(id_col).eqNullSafe(F.lit(last["p"]["i"]))
    if last["p"]["i"] is None:                                                         # null is the smallest id
        lower = F.lit(False)
    else:
        lower = F.coalesce(F.col(id_col) < F.lit(last["p"]["i"]), F.lit(True))
    before = (at < lead) | (at == lead) & ((F.col("_k") < key) | (F.col("_k") == key) & lower)
    tied = (at == lead) & (F.col("_k") == key) & same_id
    if ties == wanted:
        return keyed.where(before | tied).drop("_k", "_b")
    return keyed.where(before).unionByName(keyed.where(tied).limit(wanted)).drop("_k", "_b")


def value_counts_labelled(df: DataFrame, col: str, book: dict | None = None,
                          missing_text: str = MISSING_CODE_TEXT, other_text: str = OTHER_CODE_TEXT) -> DataFrame:
    """Counts of each value including missing, share of all rows (4 places), and display
    text: the book's label, ``other_text`` for an unlisted code, ``missing_text`` for missing.
    The default book is the group-code table."""
    book = GROUP_CODE_LABELS if book is None else book
    name = col_lookup(df, col)
    g = df.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1))).scalar()      # scalar subquery, evaluated once
    if book:
        items = []
        for k, v in book.items():
            items += [F.lit(k), F.lit(v)]
        text = F.coalesce(F.create_map(*items)[F.col("value")], F.lit(other_text))
    else:
        text = F.col("value").cast("string")
    label = F.when(F.col("value").isNull(), F.lit(missing_text)).otherwise(text)
    return g.select("value", label.alias("display"), "count",
                    F.round(F.col("count") / total.cast("double"), 4).alias("share"))


def prevalence_by_group(df: DataFrame, targets: Sequence[str], group_cols: Sequence[str],
                        digits: int = 3) -> DataFrame:
    """Prevalence of every target per value of every group column, missing groups dropped.

    Group columns are unpivoted so all groups come out of one ``groupBy``.
    """
    ts, gs = present(df, targets), present(df, group_cols)
    long = df.select(*ts, *[F.col(g).cast("string").alias(g) for g in gs]).unpivot(
        ts, gs, "feature", "group_value").where(F.col("group_value").isNotNull())
    return long.groupBy("feature", "group_value").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(F.col(t).cast("double")), digits).alias(t) for t in ts])


def describe(df: DataFrame, cols: Sequence[str], digits: int = 3) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear interpolation, exact), max."""
    cols = present(df, cols)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], cols, "column", "value").where(F.col("value").isNotNull())
    mom = long.groupBy("column").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("value"), digits).alias("mean"),
        F.round(F.stddev_samp("value"), digits).alias("std"),
        F.round(F.min("value"), digits).alias("min"), F.round(F.max("value"), digits).alias("max"))
    q = exact_quantiles(long, ["column"], "value", [0.25, 0.5, 0.75])
    qw = q.groupBy("column").pivot("q", [0.25, 0.5, 0.75]).agg(F.first("value"))
    qw = qw.select("column", *[F.round(F.col(f"`{v}`"), digits).alias(n) for v, n in
                               ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    return mom.join(qw, "column").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int = 2) -> DataFrame:
    """Pairwise-complete Pearson correlation of every pair, one aggregate, each pair computed once: (a, b, r)."""
    cols = present(df, cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs.append(F.corr(F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double")))
                    .alias(f"c{i}"))
    wide = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                        F.round(F.col(f"c{i}"), digits).alias("r"))
                               for i, pair in enumerate(pairs) for a, b in sorted({pair, pair[::-1]})]))
    return wide.select(rows.alias("x")).select("x.*")


def histogram(df: DataFrame, col: str, bins: int = 60) -> DataFrame:
    """Equal-width histogram over [min, max] (last bin closed): (bin, bin_lo, bin_hi, count, mean),
    the mean (the plot's marker) to 4 places.

    Min, max and mean are one scalar subquery; the counts are a
    partial-aggregating ``groupBy(bin)``.
    """
    name = col_lookup(df, col)
    x = F.col(name).cast("double")
    rng = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mean"))).scalar()
    lo, hi = rng["lo"], rng["hi"]
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) / width), F.lit(bins - 1))).cast("int")
    g = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return g.select("bin", (lo + F.col("bin") * width).alias("bin_lo"),
                    (lo + (F.col("bin") + 1) * width).alias("bin_hi"), "count", F.round(rng["mean"], 4).alias("mean"))


def distinct_codes(df: DataFrame, col: str) -> DataFrame:
    name = col_lookup(df, col)
    return df.select(F.col(name).alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")


def label_value_counts(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Counts of 0 / 1 / missing per label: (label, value, count)."""
    ts = present(df, targets)
    long = df.select(*[F.col(t).cast("int").alias(t) for t in ts]).unpivot([], ts, "label", "value")
    return long.groupBy("label", "value").agg(F.count(F.lit(1)).alias("count"))
