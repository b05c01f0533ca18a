"""Deterministic stratified train/test split and cross-validation folds.

A row's place is decided by ``md5(id|seed)``, so the split is the same on
any cluster size and partitioning (unlike ``randomSplit``).

Exact mode: the test set takes ``T = ceil(f * N)`` rows; per-stratum quotas
by largest remainder (ties by stratum value); within a stratum the rows
with the smallest hashes.  Ranks come from bucketed running counts
(:func:`surveyspark.functions.ordered.prefix_sums`) keyed on the leading hash
bits -- as many bits as make a bucket of the largest stratum hold about 200k
rows -- so a stratum holding most of the table is spread over many small
window partitions instead of one.

Fast mode: test iff the hash fraction is below ``f``; no shuffle, the
proportions are approximate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.functions.exprs import present
from surveyspark.functions.ordered import join_on, prefix_sums
from surveyspark.session import checkpoint_dir
from surveyspark.spec import SurveySpec


def hash_key(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


ROWS_PER_BUCKET = 200_000


HASH_BITS = 60


def hash_bucket(h: Column, bits: int = 16) -> Column:
    """The leading ``bits`` (up to 60) bits of the hex hash as a long: monotone in the hash order."""
    bits = max(0, min(HASH_BITS, int(bits)))
    lead = F.conv(F.substring(h, 1, HASH_BITS // 4), 16, 10).cast("long")
    return F.shiftright(lead, HASH_BITS - bits) if bits else F.lit(0).cast("long")


def bucket_bits(largest_group: int | None, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Enough leading hash bits that a bucket of the largest group holds about
    ``rows_per_bucket`` rows (hashes are uniform)."""
    if not largest_group or largest_group <= rows_per_bucket:
        return 0
    return min(HASH_BITS, math.ceil(math.log2(largest_group / rows_per_bucket)))


def stratum_quotas(counts: DataFrame, strat: str, test_size: float) -> DataFrame:
    """Largest-remainder quotas: (strat, n, quota) with sum(quota) = ceil(f * N).

    ``counts`` has one row per stratum, so the global window here runs on a
    table as small as the number of strata.
    """
    w_all = Window.partitionBy()
    c = counts.withColumn("_N", F.sum("n").over(w_all))
    c = c.withColumn("_T", F.ceil(F.lit(float(test_size)) * F.col("_N").cast("double")).cast("long"))
    c = c.withColumn("_fl", F.expr("(_T * n) div _N")).withColumn("_rem", F.expr("(_T * n) % _N"))
    c = c.withColumn("_extra", F.col("_T") - F.sum("_fl").over(w_all))
    c = c.withColumn("_rr", F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(strat).asc())))
    return c.select(strat, "n", (F.col("_fl") + F.when(F.col("_rr") <= F.col("_extra"), 1).otherwise(0))
                    .cast("long").alias("quota"))


def stratified_split(df: DataFrame, id_col: str, strat_col: str, test_size: float = 0.2,
                     seed: int = 42, mode: str = "exact", split_col: str = "split",
                     rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``split`` ('train' / 'test') to every row of ``df``."""
    h = hash_key(id_col, seed)
    if mode == "fast":
        frac = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(float(16 ** 8))
        return df.withColumn(split_col, F.when(frac < F.lit(test_size), "test").otherwise("train"))
    counts, largest, few = stratum_counts(df, strat_col)
    keyed = df.withColumn("_h", h).withColumn("_b", hash_bucket(F.col("_h"), bucket_bits(largest, rows_per_bucket))).withColumn("_one", F.lit(1))
    quotas = stratum_quotas(counts, strat_col, test_size).select(strat_col, "quota")
    ranked = prefix_sums(keyed, [strat_col], ["_h", id_col], ["_one"], "_b")
    out = join_on(ranked, F.broadcast(quotas) if few else quotas, [strat_col])
    return out.withColumn(split_col, F.when(F.col("_one_before") < F.col("quota"), "test")
                          .otherwise("train")).drop("_h", "_b", "_one", "_one_before", "quota")


#: Up to this many strata the counts are a literal table that goes to every task, so no shuffle is keyed on the stratum alone.
FEW_STRATA = 10_000


def stratum_counts(df: DataFrame, strat_col: str) -> tuple[DataFrame, int | None, bool]:
    """((stratum, n), the largest n, whether there are few strata)."""
    counts = df.groupBy(strat_col).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.limit(FEW_STRATA + 1).collect()
    if len(rows) <= FEW_STRATA:
        return df.sparkSession.createDataFrame(rows, counts.schema), max((r["n"] for r in rows), default=None), True
    return counts, counts.agg(F.max("n")).first()[0], False


def split_table(df: DataFrame, spec: SurveySpec, mode: str = "exact") -> DataFrame:
    """The reference split: drop rows with a missing target, stratify on ``spec.stratify_col``."""
    checkpoint_dir(df.sparkSession)
    base = df.dropna(how="any", subset=present(df, spec.targets)).checkpoint(eager=True)   # counted, ranked and joined below
    return stratified_split(base, spec.id_col, spec.stratify_col, spec.test_size, spec.seed, mode)


def split_balance(split_df: DataFrame, strat_col: str, split_col: str = "split") -> DataFrame:
    """Rows per (split, stratum) and the stratum share inside each split."""
    g = split_df.groupBy(split_col, strat_col).agg(F.count(F.lit(1)).alias("n"))
    tot = split_df.groupBy(split_col).agg(F.count(F.lit(1)).alias("_t"))
    return g.join(tot, split_col).select(split_col, F.col(strat_col).cast("int").alias("stratum"), "n", F.round(
        F.col("n") / F.col("_t").cast("double"), 4).alias("share"))


def split_summary(split_df: DataFrame, spec: SurveySpec, n_features: int, n_cols_full: int,
                  split_col: str = "split") -> DataFrame:
    """(split, rows, cols) for the cleaned table, X_train/X_test and y_train/y_test."""
    g = split_df.agg(F.count(F.lit(1)).alias("all"),
                     F.sum(F.when(F.col(split_col) == "train", 1).otherwise(0)).cast("long").alias("train"),
                     F.sum(F.when(F.col(split_col) == "test", 1).otherwise(0)).cast("long").alias("test"))
    nt = len(spec.targets)
    def row(name, n, cols):
        return F.struct(F.lit(name).alias("split"), F.col(n).cast("long").alias("rows"),
                        F.lit(int(cols)).alias("cols"))

    rows = F.explode(F.array(row("cleaned", "all", n_cols_full), row("X_train", "train", n_features),
                             row("X_test", "test", n_features), row("y_train", "train", nt),
                             row("y_test", "test", nt)))
    return g.select(rows.alias("r")).select("r.*")


def cv_folds(df: DataFrame, id_col: str, strat_col: str, k: int = 5, seed: int = 42,
             fold_col: str = "fold", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Stratified fold id: the row's hash rank inside its stratum, modulo k.
    Every fold gets floor or ceil of n_s / k rows of each stratum."""
    _, largest, _ = stratum_counts(df, strat_col)
    keyed = df.withColumn("_h", hash_key(id_col, seed)).withColumn(
        "_b", hash_bucket(F.col("_h"), bucket_bits(largest, rows_per_bucket))).withColumn("_one", F.lit(1))
    ranked = prefix_sums(keyed, [strat_col], ["_h", id_col], ["_one"], "_b")
    return ranked.withColumn(fold_col, (F.col("_one_before") % k).cast("int")).drop(
        "_h", "_b", "_one", "_one_before")


def fold_sizes(folded: DataFrame, strat_col: str, fold_col: str = "fold") -> DataFrame:
    return folded.groupBy(fold_col, strat_col).agg(F.count(F.lit(1)).alias("n"))


__all__: Sequence[str] = ["stratified_split", "split_table", "split_balance", "split_summary", "cv_folds",
                          "stratum_quotas", "fold_sizes"]
