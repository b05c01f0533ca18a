"""Registered queries: split, metrics, benchmark reshaping, fairness."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyspark.operators import clean, fairness, metrics, split
from surveyspark.plans import inputs
from surveyspark.plans.oracle_inputs import OBS, SCORED
from surveyspark.plans.q_clean import FP_CTES, SPEC, obs
from surveyspark.plans.registry import register, union_all
from surveyspark.spec import FNR_TOLERANCE

PAIRS = [("quality", "p_quality"), ("toxic", "p_toxic")]
LABELS = [t for t, _ in PAIRS]
GROUPS = ["lang", "source"]
# Three cut rules scored as "models" (name, threshold): the benchmark rows.
CUTS = [("cut_40", 0.4), ("cut_50", 0.5), ("cut_60", 0.6)]


def scored_long(spark, sf):
    return metrics.long_scores(inputs.scored(spark, sf), PAIRS, keep=GROUPS)


def long_groups(spark, sf):
    return fairness.long_groups(scored_long(spark, sf), None, GROUPS)


def models_long(spark, sf):
    """Long scores crossed with the cut rules by a per-row Generate (no join)."""
    cuts = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(t).alias("cut")) for m, t in CUTS]))
    l = scored_long(spark, sf)
    return l.select("*", cuts.alias("_m")).select(*l.columns, "_m.*")


def benchmark(spark, sf):
    """(model, label, recall, precision, f1, roc_auc, n_test) for the three cut rules.
    AUC does not depend on the cut, so it is computed once per label and joined."""
    ml = models_long(spark, sf)
    c = metrics._rates(metrics.confusion_counts(ml, "cut", ["model", "label"]))
    auc = metrics.roc_auc(scored_long(spark, sf))
    j = c.join(auc, "label")
    return j.select("model", "label", F.round("recall_raw", 4).alias("recall"),
                    F.round("precision_raw", 4).alias("precision"), F.round("f1_raw", 4).alias("f1"),
                    "roc_auc", "n_test")


# -- SQL fragments ---------------------------------------------------------------------------

LONG = SCORED + ",\nlong AS (" + union_all([
    f"SELECT id, lang, source, '{t}' AS label, {t} AS y, {p} AS p FROM scored WHERE {t} IS NOT NULL"
    for t, p in PAIRS]) + ")"

CONF = ("SELECT label, CAST(count_if(p >= {t} AND y = 1) AS BIGINT) AS tp, CAST(count_if(p >= {t} AND y = 0) AS BIGINT) AS fp, "
        "CAST(count_if(p < {t} AND y = 1) AS BIGINT) AS fn, CAST(count_if(p < {t} AND y = 0) AS BIGINT) AS tn, "
        "CAST(count(*) AS BIGINT) AS n_test FROM long GROUP BY label")

RATES = ("CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall_raw, "
         "CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision_raw, "
         "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1_raw")

AUC = ("ps AS (SELECT label, p, CAST(count_if(y = 1) AS BIGINT) AS pos, CAST(count_if(y = 0) AS BIGINT) AS neg "
       "FROM long GROUP BY label, p),\n"
       "run AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY label ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING "
       "AND 1 PRECEDING), 0) AS nb FROM ps),\n"
       "auc AS (SELECT label, CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(CAST(pos AS DOUBLE) * (CAST(nb AS DOUBLE) + "
       "CAST(neg AS DOUBLE) / 2.0)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS roc_auc_raw "
       "FROM run GROUP BY label)")


@register("binary_metrics", f"WITH {LONG}, c AS ({CONF.format(t='0.5')}), r AS (SELECT *, {RATES} FROM c) "
          "SELECT label, round(recall_raw, 4) AS recall, round(precision_raw, 4) AS precision, round(f1_raw, 4) AS f1, "
          "0.5::DOUBLE AS threshold, n_test FROM r")
def q_binary_metrics(spark, sf):
    return metrics.binary_metrics(scored_long(spark, sf), 0.5)


@register("confusion_counts", f"WITH {LONG} {CONF.format(t='0.5')}")
def q_confusion(spark, sf):
    return metrics.confusion_counts(scored_long(spark, sf), 0.5)


@register("roc_auc", f"WITH {LONG}, {AUC} SELECT label, round(roc_auc_raw, 4) AS roc_auc FROM auc")
def q_roc_auc(spark, sf):
    return metrics.roc_auc(scored_long(spark, sf))


ML_RAW = f"WITH {LONG}, {AUC}, c AS ({CONF.format(t='0.5')}), r AS (SELECT c.*, {RATES}, auc.roc_auc_raw FROM c LEFT JOIN auc USING (label)) "


@register("multilabel_metrics", ML_RAW + "SELECT label, round(recall_raw, 4) AS recall, round(precision_raw, 4) "
          "AS precision, round(f1_raw, 4) AS f1, round(roc_auc_raw, 4) AS roc_auc, n_test FROM r")
def q_multilabel(spark, sf):
    return metrics.multilabel_metrics(scored_long(spark, sf))


@register("macro_avg", ML_RAW + "SELECT round(avg(recall_raw), 4) AS recall, round(avg(f1_raw), 4) AS f1, "
          "round(avg(roc_auc_raw), 4) AS roc_auc FROM r")
def q_macro(spark, sf):
    return metrics.macro_avg(scored_long(spark, sf))


@register("roc_points", f"WITH {LONG}, ps AS (SELECT label, p, count_if(y = 1) AS pos, count_if(y = 0) AS neg "
          "FROM long GROUP BY label, p), tot AS (SELECT label, count_if(y = 1) AS PP, count_if(y = 0) AS NN FROM long "
          "GROUP BY label), run AS (SELECT *, sum(pos) OVER (PARTITION BY label ORDER BY p DESC ROWS BETWEEN "
          "UNBOUNDED PRECEDING AND CURRENT ROW) AS cp, sum(neg) OVER (PARTITION BY label ORDER BY p DESC ROWS "
          "BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM ps) "
          "SELECT run.label, p AS threshold, CASE WHEN NN = 0 THEN NULL ELSE CAST(cn AS DOUBLE) / CAST(NN AS DOUBLE) END AS fpr, "
          "CASE WHEN PP = 0 THEN NULL ELSE CAST(cp AS DOUBLE) / CAST(PP AS DOUBLE) END AS tpr FROM run JOIN tot USING (label) "
          "UNION ALL SELECT label, CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM tot")
def q_roc_points(spark, sf):
    return metrics.roc_points(scored_long(spark, sf))


# -- benchmark tables ----------------------------------------------------------------------------

_CUTS_VALUES = ", ".join(f"('{m}', {t}::DOUBLE)" for m, t in CUTS)
BENCH = (f"WITH {LONG}, {AUC}, cuts(model, cut) AS (VALUES {_CUTS_VALUES}), "
         "ml AS (SELECT long.*, cuts.model, cuts.cut FROM long, cuts), "
         "c AS (SELECT model, label, CAST(count_if(p >= cut AND y = 1) AS BIGINT) AS tp, "
         "CAST(count_if(p >= cut AND y = 0) AS BIGINT) AS fp, CAST(count_if(p < cut AND y = 1) AS BIGINT) AS fn, "
         "CAST(count(*) AS BIGINT) AS n_test FROM ml GROUP BY model, label), "
         f"r AS (SELECT c.*, {RATES} FROM c), "
         "bench AS (SELECT model, r.label, round(recall_raw, 4) AS recall, round(precision_raw, 4) AS precision, "
         "round(f1_raw, 4) AS f1, round(roc_auc_raw, 4) AS roc_auc, n_test FROM r JOIN auc USING (label)) ")


@register("benchmark_rows", BENCH + "SELECT * FROM bench")
def q_benchmark_rows(spark, sf):
    return benchmark(spark, sf)


@register("benchmark_table", BENCH + "SELECT * FROM bench WHERE label <> 'macro_avg' ORDER BY label, recall DESC")
def q_benchmark_table(spark, sf):
    return metrics.benchmark_table(benchmark(spark, sf))


@register("benchmark_union", BENCH + "SELECT model, label, recall, precision, f1, roc_auc, n_test, "
          "CAST(NULL AS VARCHAR) AS family FROM bench WHERE model <> 'cut_60' UNION ALL "
          "SELECT model, label, recall, precision, f1, roc_auc, n_test, 'new' AS family FROM bench WHERE model = 'cut_60'")
def q_benchmark_union(spark, sf):
    b = benchmark(spark, sf)
    base = b.where(F.col("model") != "cut_60")
    new = b.where(F.col("model") == "cut_60").withColumn("family", F.lit("new"))
    return metrics.benchmark_union(base, new)


@register("recall_pivot", BENCH + "SELECT model, " + ", ".join(
    f"first(recall) FILTER (WHERE label = '{l}') AS {l}" for l in LABELS)
    + ", round((" + " + ".join(f"coalesce(first(recall) FILTER (WHERE label = '{l}'), 0.0)" for l in LABELS)
    + ") / CAST(nullif(" + " + ".join(f"CAST(first(recall) FILTER (WHERE label = '{l}') IS NOT NULL AS INTEGER)"
                                      for l in LABELS)
    + ", 0) AS DOUBLE), 4) AS mean_recall FROM bench GROUP BY model")
def q_recall_pivot(spark, sf):
    return metrics.recall_pivot(benchmark(spark, sf), LABELS)


@register("benchmark_by_label", BENCH + "SELECT * FROM bench WHERE label = 'quality' ORDER BY recall DESC")
def q_benchmark_by_label(spark, sf):
    return metrics.benchmark_by_label(benchmark(spark, sf), "quality")


@register("model_gate", BENCH + ", m AS (SELECT model, avg(recall) AS raw FROM bench GROUP BY model) "
          "SELECT model, round(raw, 4) AS mean_recall, CAST(rank() OVER (ORDER BY raw DESC) AS INTEGER) AS rank, "
          "raw > (SELECT raw FROM m WHERE model = 'cut_50') AS beats_baseline FROM m")
def q_model_gate(spark, sf):
    return metrics.model_gate(benchmark(spark, sf), "cut_50")


# -- fairness ---------------------------------------------------------------------------------------

LG = LONG + ",\nlg AS (" + union_all([
    f"SELECT id, label, y, p, '{g}' AS feature, CAST({g} AS VARCHAR) AS group_value FROM long WHERE {g} IS NOT NULL"
    for g in GROUPS]) + ")"

FNR_G = ("SELECT label, feature, group_value, CAST(count(*) AS BIGINT) AS n, "
         "CAST(count_if(p < 0.5 AND y = 1) AS BIGINT) AS fn, CAST(count_if(p >= 0.5 AND y = 1) AS BIGINT) AS tp "
         "FROM lg GROUP BY label, feature, group_value")
FNR_RATES = ("CASE WHEN fn + tp = 0 THEN 0.0 ELSE CAST(fn AS DOUBLE) / CAST(fn + tp AS DOUBLE) END AS fnr, "
             "CASE WHEN fn + tp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(fn + tp AS DOUBLE) END AS recall")


@register("fnr_by_group", f"WITH {LG}, g AS ({FNR_G}) SELECT *, {FNR_RATES} FROM g")
def q_fnr_by_group(spark, sf):
    return fairness.fnr_by_group(long_groups(spark, sf))


@register("fnr_overall", f"WITH {LONG}, g AS (SELECT label, CAST(count(*) AS BIGINT) AS n, "
          "CAST(count_if(p < 0.5 AND y = 1) AS BIGINT) AS fn, CAST(count_if(p >= 0.5 AND y = 1) AS BIGINT) AS tp "
          f"FROM long GROUP BY label) SELECT *, {FNR_RATES} FROM g")
def q_fnr_overall(spark, sf):
    return fairness.fnr_overall(scored_long(spark, sf))


@register("equity_report", f"WITH {LG}, g AS ({FNR_G}), r AS (SELECT *, {FNR_RATES} FROM g) "
          "SELECT label, feature AS sensitive_feature, group_value, round(fnr, 4) AS fnr, round(recall, 4) AS recall, "
          f"fnr > {FNR_TOLERANCE} AS fnr_exceeds_tolerance FROM r")
def q_equity_report(spark, sf):
    return fairness.equity_report(long_groups(spark, sf), 0.5, FNR_TOLERANCE)


THRESH = (f"WITH RECURSIVE {LG},\n"
          "st AS (SELECT label, feature, group_value, count_if(y = 1) AS P, count_if(y = 1 AND p < 0.5) AS below "
          "FROM lg GROUP BY ALL),\n"
          f"k0 AS (SELECT *, CAST(floor({FNR_TOLERANCE}::DOUBLE * CAST(P AS DOUBLE)) AS BIGINT) AS k0 FROM st),\n"
          f"kk AS (SELECT *, CASE WHEN P = 0 THEN NULL WHEN CAST(k0 + 1 AS DOUBLE) / CAST(P AS DOUBLE) <= {FNR_TOLERANCE}::DOUBLE "
          f"THEN k0 + 1 WHEN CAST(k0 AS DOUBLE) / CAST(P AS DOUBLE) > {FNR_TOLERANCE}::DOUBLE THEN k0 - 1 ELSE k0 END AS k, "
          f"P > 0 AND CAST(below AS DOUBLE) / CAST(P AS DOUBLE) > {FNR_TOLERANCE}::DOUBLE AS needs FROM k0),\n"
          "ranked AS (SELECT label, feature, group_value, p, row_number() OVER (PARTITION BY label, feature, group_value "
          "ORDER BY p) AS rn FROM lg WHERE y = 1),\n"
          "xs AS (SELECT kk.label, kk.feature, kk.group_value, ranked.p AS x FROM kk JOIN ranked ON "
          "kk.label = ranked.label AND kk.feature = ranked.feature AND kk.group_value = ranked.group_value "
          "AND ranked.rn = kk.k + 1 WHERE kk.needs),\n"
          "bis(label, feature, group_value, x, it, lo, hi, best) AS (SELECT label, feature, group_value, x, 0, "
          "0.01::DOUBLE, 0.49::DOUBLE, 0.5::DOUBLE FROM xs UNION ALL SELECT label, feature, group_value, x, it + 1, "
          "CASE WHEN (lo + hi) / 2.0 <= x THEN (lo + hi) / 2.0 ELSE lo END, "
          "CASE WHEN (lo + hi) / 2.0 <= x THEN hi ELSE (lo + hi) / 2.0 END, "
          "CASE WHEN (lo + hi) / 2.0 <= x THEN (lo + hi) / 2.0 ELSE best END FROM bis WHERE it < 20),\n"
          "fin AS (SELECT label, feature, group_value, round_even(best, 4) AS t FROM bis WHERE it = 20),\n"
          "thr AS (SELECT kk.label, kk.feature, kk.group_value, CAST(kk.P AS BIGINT) AS P, "
          "CASE WHEN kk.needs THEN fin.t ELSE 0.5::DOUBLE END AS threshold FROM kk LEFT JOIN fin ON "
          "kk.label = fin.label AND kk.feature = fin.feature AND kk.group_value = fin.group_value)\n")


@register("threshold_correction", THRESH + "SELECT * FROM thr")
def q_threshold_correction(spark, sf):
    return fairness.threshold_correction(long_groups(spark, sf), FNR_TOLERANCE)


@register("fnr_after_correction", THRESH + ", j AS (SELECT lg.*, thr.threshold FROM lg JOIN thr ON "
          "lg.label = thr.label AND lg.feature = thr.feature AND lg.group_value = thr.group_value) "
          "SELECT label, feature, group_value, first(threshold) AS threshold, "
          "CAST(count_if(p < threshold AND y = 1) AS BIGINT) AS fn, CAST(count_if(p >= threshold AND y = 1) AS BIGINT) AS tp, "
          "round(CASE WHEN count_if(y = 1) = 0 THEN 0.0 ELSE CAST(count_if(p < threshold AND y = 1) AS DOUBLE) / "
          "CAST(count_if(y = 1) AS DOUBLE) END, 4) AS fnr FROM j GROUP BY label, feature, group_value")
def q_fnr_after(spark, sf):
    lg = long_groups(spark, sf)
    return fairness.fnr_after_correction(lg, fairness.threshold_correction(lg, FNR_TOLERANCE))


@register("align_by_key", f"WITH {SCORED} SELECT s.id, s.quality, s.toxic, s.p_quality, s.p_toxic, d.lang AS doc_lang, "
          "d.source AS doc_source, d.n_chars FROM scored s JOIN documents d ON s.id = d.doc_id")
def q_align(spark, sf):
    s = inputs.scored(spark, sf).select("id", "quality", "toxic", "p_quality", "p_toxic")
    d = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("doc_lang"),
                                                     F.col("source").alias("doc_source"), "n_chars")
    return fairness.align_by_key(s, d, "id")


@register("flag_join", f"WITH {OBS}, flags AS (SELECT DISTINCT lower(trim(n.n_name)) AS k FROM nation n JOIN region r "
          "ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA') "
          "SELECT obs.*, CASE WHEN flags.k IS NULL THEN 0 ELSE 1 END AS is_flagged FROM obs "
          "LEFT JOIN flags ON lower(trim(obs.nation)) = flags.k")
def q_flag_join(spark, sf):
    """Flag rows whose nation is in a list derived from the nation/region tables
    (the bounded 25-row dimension, so the list is broadcast)."""
    n = inputs.table(spark, sf, "nation")
    r = inputs.table(spark, sf, "region").where(F.col("r_name") == "ASIA")
    flags = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("state"))
    out = fairness.flag_join(obs(spark, sf), flags, [("nation", "state")], broadcast_ok=True)
    return out.withColumn("is_flagged", F.col("is_flagged").cast("int"))


# -- split ------------------------------------------------------------------------------------------

SPLIT = (f"{FP_CTES},\n"
         "base AS (SELECT * FROM fp WHERE stunted IS NOT NULL AND underweight IS NOT NULL AND wasted IS NOT NULL),\n"
         "k AS (SELECT *, md5(CAST(id AS VARCHAR) || '|42') AS h FROM base),\n"
         "cnt AS (SELECT stunted AS s, count(*) AS n FROM k GROUP BY 1),\n"
         "tot AS (SELECT sum(n) AS NN, CAST(ceil(0.2::DOUBLE * CAST(sum(n) AS DOUBLE)) AS BIGINT) AS T FROM cnt),\n"
         "q0 AS (SELECT s, n, (T * n) // NN AS fl, (T * n) % NN AS rem FROM cnt, tot),\n"
         "q1 AS (SELECT *, row_number() OVER (ORDER BY rem DESC, s ASC) AS rr FROM q0),\n"
         "q AS (SELECT s, fl + CASE WHEN rr <= (SELECT T FROM tot) - (SELECT sum(fl) FROM q0) THEN 1 ELSE 0 END AS quota FROM q1),\n"
         "r AS (SELECT k.*, row_number() OVER (PARTITION BY stunted ORDER BY h, id) AS rn FROM k),\n"
         "sp AS (SELECT r.* EXCLUDE (h, rn), CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split "
         "FROM r JOIN q ON r.stunted = q.s)\n")


def split_frame(spark, sf):
    return split.split_table(clean.clean_chain(obs(spark, sf), SPEC), SPEC)


@register("stratified_split", SPLIT + "SELECT * FROM sp")
def q_split(spark, sf):
    return split_frame(spark, sf)


@register("split_balance", SPLIT + ", g AS (SELECT split, stunted, count(*) AS n FROM sp GROUP BY 1, 2) "
          "SELECT split, CAST(stunted AS INTEGER) AS stratum, CAST(n AS BIGINT) AS n, "
          "round(CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY split) AS DOUBLE), 4) AS share FROM g")
def q_split_balance(spark, sf):
    return split.split_balance(split_frame(spark, sf), "stunted")


N_FEATURES, N_COLS_FULL = 11, 17


@register("split_summary", SPLIT + ", c AS (SELECT CAST(count(*) AS BIGINT) AS a, CAST(count_if(split = 'train') AS BIGINT) "
          "AS tr, CAST(count_if(split = 'test') AS BIGINT) AS te FROM sp) "
          f"SELECT 'cleaned' AS split, a AS rows, {N_COLS_FULL} AS cols FROM c UNION ALL SELECT 'X_train', tr, {N_FEATURES} FROM c "
          f"UNION ALL SELECT 'X_test', te, {N_FEATURES} FROM c UNION ALL SELECT 'y_train', tr, 3 FROM c "
          "UNION ALL SELECT 'y_test', te, 3 FROM c")
def q_split_summary(spark, sf):
    fp = clean.clean_chain(obs(spark, sf), SPEC)
    n_features = len(clean.feature_select(fp, SPEC).columns) - 1
    n_full = len(fp.columns) - 1
    return split.split_summary(split.split_table(fp, SPEC), SPEC, n_features, n_full)


@register("cv_folds", f"{FP_CTES},\n"
          "base AS (SELECT * FROM fp WHERE stunted IS NOT NULL AND underweight IS NOT NULL AND wasted IS NOT NULL) "
          "SELECT id, stunted, CAST((row_number() OVER (PARTITION BY stunted ORDER BY md5(CAST(id AS VARCHAR) || '|42'), id) - 1) "
          "% 5 AS INTEGER) AS fold FROM base")
def q_cv_folds(spark, sf):
    fp = clean.clean_chain(obs(spark, sf), SPEC)
    base = fp.dropna(how="any", subset=list(SPEC.targets)).select("id", "stunted")
    return split.cv_folds(base, "id", "stunted", 5, 42)


@register("split_fast", f"{FP_CTES},\n"
          "base AS (SELECT * FROM fp WHERE stunted IS NOT NULL AND underweight IS NOT NULL AND wasted IS NOT NULL) "
          "SELECT *, CASE WHEN CAST(('0x' || substr(md5(CAST(id AS VARCHAR) || '|42'), 1, 8)) AS BIGINT) / "
          "4294967296.0::DOUBLE < 0.2::DOUBLE THEN 'test' ELSE 'train' END AS split FROM base")
def q_split_fast(spark, sf):
    """Fast split mode: test iff the row's hash fraction is below the test share (no shuffle)."""
    return split.split_table(clean.clean_chain(obs(spark, sf), SPEC), SPEC, mode="fast")
