"""Data-quality gates as one table.

Every gate is a row ``(section, seq, gate, status, actual, lo, hi)`` with
status PASS / FAIL / INFO and inclusive bounds.  All scalar facts a preset
needs come from **one** aggregate pass; only the duplicate gate needs a
shuffle (a partial-aggregating ``groupBy`` over the row data).  The table is
a lazy DataFrame; the hard runner collects it (a handful of rows) and raises
on the first failure in gate order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.exprs import col_lookup, count_if, numeric_columns, present
from surveyspark.operators.clean import duplicate_count
from surveyspark.session import checkpoint_dir
from surveyspark.spec import BANDS_BROAD, SurveySpec


class ValidationError(Exception):
    """Raised by the hard runner; carries the gate row that failed."""

    def __init__(self, gate: str, status: str = "FAIL", actual: float | None = None, lo: float | None = None,
                 hi: float | None = None) -> None:
        self.gate, self.status, self.actual, self.lo, self.hi = gate, status, actual, lo, hi
        seen = "no value" if actual is None else f"{actual:g}"
        bounds = f"[{'' if lo is None else f'{lo:g}'}, {'' if hi is None else f'{hi:g}'}]"
        super().__init__(f"gate {gate}: {seen} is outside {bounds}")


def _sum(cols: Sequence[Column]) -> Column:
    total = F.lit(0).cast("long")
    for c in cols:
        total = total + c
    return total


def facts(df: DataFrame, spec: SurveySpec, bands: Sequence[tuple[str, float, float]],
          key_features: Sequence[str] = ()) -> DataFrame:
    """One aggregate pass with every scalar the presets need (one row)."""
    nums = numeric_columns(df, exclude=[spec.id_col])
    codes = list(spec.missing_codes)
    zs = present(df, spec.z_cols)
    ts = present(df, spec.targets)
    pairs = [(z, t) for z, t in spec.label_map.items() if col_lookup(df, z) and col_lookup(df, t)]
    aggs = [F.count(F.lit(1)).alias("n"),
            _sum([count_if(F.col(c).isin(codes)) for c in nums]).alias("codes"),
            _sum([count_if(~F.col(z).between(spec.z_min, spec.z_max)) for z in zs]).alias("out_z"),
            _sum([count_if(F.col(z).isNotNull() & F.col(t).isNull()) for z, t in pairs]).alias("orphans"),
            _sum([count_if(F.col(t).isNull()) for t in ts]).alias("label_nulls"),
            _sum([count_if(F.col(t).isNotNull() & ~F.col(t).isin(0, 1)) for t in ts]).alias("nonbinary")]
    for t in ts:
        aggs += [F.avg(F.col(t).cast("double")).alias(f"prev_{t}"),
                 count_if(F.col(t).isNotNull() & ~F.col(t).isin(0, 1)).alias(f"nonbin_{t}"),
                 count_if(F.col(t) == 1).alias(f"pos_{t}")]
    kf = present(df, key_features)
    aggs.append(_sum([count_if(F.col(c).isNull()) for c in kf]).alias("key_nulls"))
    return df.agg(*aggs)


def _row(section: str, seq: int, gate: str, status: Column, actual: Column,
         lo: float | None = None, hi: float | None = None) -> Column:
    return F.struct(F.lit(section).alias("section"), F.lit(seq).alias("seq"), F.lit(gate).alias("gate"),
                    status.alias("status"), actual.cast("double").alias("actual"),
                    F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"))


def _within(actual: Column, lo: float | None, hi: float | None) -> Column:
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (actual >= F.lit(lo))
    if hi is not None:
        ok = ok & (actual <= F.lit(hi))
    return F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")


def _table(f: DataFrame, rows: list[Column]) -> DataFrame:
    return f.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def _facts_with_dups(df: DataFrame, spec: SurveySpec, bands, key_features=()) -> DataFrame:
    f = facts(df, spec, bands, key_features)
    dups = duplicate_count(df, spec.id_col).select("duplicates").scalar()   # the only shuffle
    return f.withColumn("dups", dups)


def all_facts(df: DataFrame, spec: SurveySpec, key_features: Sequence[str] = ()) -> DataFrame:
    """The one-row table that every runner needs, computed once into the checkpoint folder (pass it as ``f``)."""
    checkpoint_dir(df.sparkSession)
    return _facts_with_dups(df, spec, spec.bands, key_features).checkpoint(eager=True)


def gates_soft(df: DataFrame, spec: SurveySpec, section: str = "soft validation",
               record_passing_prevalence: bool = False, f: DataFrame | None = None) -> DataFrame:
    """Six checks, all failures kept.  Prevalence rows appear only when they fail
    (the soft runner records no pass row for prevalence) unless asked."""
    f = f or _facts_with_dups(df, spec, spec.bands)
    rows = [
        _row(section, 1, "row_count", _within(F.col("n"), spec.min_rows, None), F.col("n"), spec.min_rows, None),
        _row(section, 2, "no_missing_codes", _within(F.col("codes"), None, 0), F.col("codes"), None, 0),
        _row(section, 3, "z_score_scale", _within(F.col("out_z"), None, 0), F.col("out_z"), None, 0),
        _row(section, 4, "label_binary", _within(F.col("nonbinary"), None, 0), F.col("nonbinary"), None, 0),
        _row(section, 5, "no_duplicates", _within(F.col("dups"), None, spec.max_duplicates), F.col("dups"),
             None, spec.max_duplicates),
    ]
    seq = 6
    for label, lo, hi in spec.bands:
        if col_lookup(df, label) is None:
            rows.append(_row(section, seq, f"{label}_column_present", F.lit("FAIL"), F.lit(None), None, None))
        else:
            p = F.col(f"prev_{label}")
            rows.append(_row(section, seq, f"{label}_prevalence", _within(p, lo, hi), F.round(p, 4), lo, hi))
        seq += 1
    t = _table(f, rows)
    if not record_passing_prevalence:
        t = t.where((F.col("seq") <= 5) | (F.col("status") == "FAIL"))
    return t


def gates_hard(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """Evaluate the six checks in order and raise on the first failure."""
    t = gates_soft(df, spec, "full validation", record_passing_prevalence=True)
    for r in t.orderBy("seq").collect():        # six rows
        if r["status"] == "FAIL":
            raise ValidationError(r["gate"], r["status"], r["actual"], r["lo"], r["hi"])
    return t


def gates_labels(df: DataFrame, spec: SurveySpec, bands=BANDS_BROAD,
                 section: str = "label integrity", f: DataFrame | None = None) -> DataFrame:
    """V1 targets present, V2 binary per label (missing allowed), V3-V5 prevalence
    in the broad bands, V6 row count, V7 no valid z with a missing label."""
    f = f or facts(df, spec, bands)
    missing = [t for t in spec.targets if col_lookup(df, t) is None]
    rows = [_row(section, 1, "V1_targets_present", F.lit("FAIL" if missing else "PASS"), F.lit(len(missing)),
                 None, 0)]
    seq = 2
    for t in spec.targets:
        if col_lookup(df, t) is not None:
            a = F.col(f"nonbin_{t}")
            rows.append(_row(section, seq, f"V2_{t}_binary", _within(a, None, 0), a, None, 0))
        seq += 1
    for i, (label, lo, hi) in enumerate(bands):
        code = f"V{3 + i}"
        if col_lookup(df, label) is None:
            rows.append(_row(section, seq, f"{code}_{label}_prevalence", F.lit("FAIL"), F.lit(None), lo, hi))
        else:
            p = F.col(f"prev_{label}")
            rows.append(_row(section, seq, f"{code}_{label}_prevalence", _within(p, lo, hi), F.round(p, 4), lo, hi))
        seq += 1
    rows.append(_row(section, seq, "V6_row_count", _within(F.col("n"), spec.min_rows, None), F.col("n"),
                     spec.min_rows, None))
    rows.append(_row(section, seq + 1, "V7_z_label_consistency", _within(F.col("orphans"), None, 0),
                     F.col("orphans"), None, 0))
    return _table(f, rows)


def gates_initial(df: DataFrame, spec: SurveySpec, audit_entries: Column | None = None,
                  key_features: Sequence[str] = ("hv270", "b4", "v025"), bands=BANDS_BROAD,
                  section: str = "initial validation", f: DataFrame | None = None) -> DataFrame:
    """The twelve post-load gates G1-G12.  G11 (key features without nulls) is
    INFO only and never blocks; G12 needs at least 3 audit-log entries."""
    f = f or _facts_with_dups(df, spec, bands, key_features)
    required = [*spec.z_cols, *spec.targets]
    missing = [c for c in required if col_lookup(df, c) is None]
    ts = present(df, spec.targets)
    rows = [
        _row(section, 1, "G1_row_count", _within(F.col("n"), spec.min_rows, None), F.col("n"), spec.min_rows, None),
        _row(section, 2, "G2_no_missing_codes", _within(F.col("codes"), None, 0), F.col("codes"), None, 0),
        _row(section, 3, "G3_z_in_range", _within(F.col("out_z"), None, 0), F.col("out_z"), None, 0),
    ]
    for i, (label, lo, hi) in enumerate(bands):
        own = col_lookup(df, label)
        p = F.col(f"prev_{own}") if own in ts else F.lit(None)
        rows.append(_row(section, 4 + i, f"G{4 + i}_{label}_prevalence", _within(p, lo, hi), F.round(p, 4), lo, hi))
    bad = F.col("nonbinary") + F.col("label_nulls")
    rows += [
        _row(section, 7, "G7_labels_binary_no_missing", _within(bad, None, 0), bad, None, 0),
        _row(section, 8, "G8_no_duplicates", _within(F.col("dups"), None, 0), F.col("dups"), None, 0),
        _row(section, 9, "G9_required_columns", F.lit("FAIL" if missing else "PASS"), F.lit(len(missing)), None, 0),
    ]
    pos_ok = F.lit(True)
    for t in spec.targets:
        own = col_lookup(df, t)
        pos_ok = pos_ok & (F.col(f"pos_{own}") > 0) if own in ts else F.lit(False)
    min_pos = F.least(*[F.col(f"pos_{t}") for t in ts]) if ts else F.lit(0)
    rows.append(_row(section, 10, "G10_class_weights", F.when(pos_ok, "PASS").otherwise("FAIL"), min_pos, 1, None))
    rows.append(_row(section, 11, "G11_key_features_no_nulls",
                     F.when(F.col("key_nulls") == 0, "PASS").otherwise("INFO"), F.col("key_nulls"), None, 0))
    if audit_entries is not None:
        rows.append(_row(section, 12, "G12_audit_log_entries", _within(audit_entries, 3, None), audit_entries, 3, None))
    return _table(f, rows)


def gate_summary(gates: DataFrame) -> DataFrame:
    """Per section: passes, failures, infos and the overall verdict (INFO never blocks)."""
    return gates.groupBy("section").agg(
        count_if(F.col("status") == "PASS").alias("n_pass"),
        count_if(F.col("status") == "FAIL").alias("n_fail"),
        count_if(F.col("status") == "INFO").alias("n_info"),
        F.bool_and(F.col("status") != "FAIL").alias("all_passed"))


class ValidationReport:
    """Section-based validation log: start a section, record pass / fail / info
    checks, finish it (True when nothing failed; INFO never blocks).  Recording
    outside a section is an error.  Rows are a handful of driver-side records,
    appended to a Parquet table in one write."""

    def __init__(self, spark):
        self.spark = spark
        self._rows: list[tuple] = []
        self._section: str | None = None
        self._seq = 0

    def start_section(self, title: str) -> None:
        self._section, self._seq = title, 0

    def _add(self, status: str, check: str, actual: float | None = None) -> None:
        if self._section is None:
            raise RuntimeError("start_section() must be called before recording a check")
        self._seq += 1
        self._rows.append((self._section, self._seq, check, status,
                           None if actual is None else float(actual), None, None))

    def pass_(self, check: str, actual: float | None = None) -> None:
        self._add("PASS", check, actual)

    def fail_(self, check: str, actual: float | None = None) -> None:
        self._add("FAIL", check, actual)

    def info_(self, check: str, actual: float | None = None) -> None:
        self._add("INFO", check, actual)

    def finish_section(self) -> bool:
        if self._section is None:
            raise RuntimeError("no section is open")
        ok = all(r[3] != "FAIL" for r in self._rows if r[0] == self._section)
        self._section = None
        return ok

    def table(self) -> DataFrame:
        from surveyspark.spec import GATE_SCHEMA
        return self.spark.createDataFrame(self._rows, GATE_SCHEMA)

    def write(self, path: str) -> None:
        self.table().write.mode("append").parquet(path)
