"""Row-wise recoding and cleaning: sentinels, scaling, bounds, decoding,
clipping, the composite deprivation index, exact dedup and the fixed-order
cleaning chain.

Every row-wise step is one ``select`` so Catalyst collapses the chain into a
single projection inside whole-stage codegen.  Counting helpers compute all
columns in one ``agg`` (one job, one scan) and return a long table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.functions.exprs import (col_lookup, count_if, nan_to_null, not_in_or_null,
                                         numeric_columns, present, require_columns)
from surveyspark.spec import (EDUCATION_ORDINAL, IMPROVED_SANITATION, IMPROVED_WATER,
                              SurveySpec)


def _long_counts(df: DataFrame, exprs: dict[str, Column], name_col: str, value_col: str) -> DataFrame:
    """One aggregate pass producing ``{name: count}`` as rows (name, count)."""
    if not exprs:
        schema = f"{name_col} string, {value_col} long"
        return df.sparkSession.createDataFrame([], schema)
    wide = df.agg(*[e.alias(k) for k, e in exprs.items()])
    return wide.unpivot([], list(exprs), name_col, value_col)


# -- P1 sentinel codes -------------------------------------------------------

def replace_codes(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """Sentinel codes -> null in every numeric column except the row id; NaN -> null."""
    skip = {spec.id_col.lower()}
    codes = list(spec.missing_codes)
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name.lower() in skip or f.name in (None,):
            out.append(c)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.when(~nan_to_null(c).isin(codes), c).alias(f.name))
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                                     T.DecimalType)):
            out.append(F.when(~c.isin(codes), c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def code_hits(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """Per numeric column, how many values are sentinel codes: (column, hits)."""
    cols = numeric_columns(df, exclude=[spec.id_col])
    codes = list(spec.missing_codes)
    return _long_counts(df, {c: count_if(F.col(c).isin(codes)) for c in cols}, "column", "hits")


# -- P2 scaling --------------------------------------------------------------

def scale_z(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """Raw x100 z columns -> double / 100, renamed; bad values -> null; sources dropped."""
    raw = {col_lookup(df, r): z for r, z in spec.z_map.items() if col_lookup(df, r)}
    keep = [F.col(c) for c in df.columns if c not in raw]
    scaled = [(F.expr(f"try_cast(`{r}` as double)") / F.lit(spec.z_scale)).alias(z)
              for r, z in raw.items()]
    return df.select(*keep, *scaled)


# -- P3/P4/P5/P6 bounds and missing rows ---------------------------------------

def out_of_range(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """Per z column, non-missing values outside the inclusive bounds: (column, n_out)."""
    zs = present(df, spec.z_cols)
    return _long_counts(
        df, {z: count_if(~F.col(z).between(spec.z_min, spec.z_max)) for z in zs},
        "column", "n_out")


def bounds_null(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """z values outside [z_min, z_max] -> null."""
    zs = set(present(df, spec.z_cols))
    return df.select(*[
        F.when(F.col(c).between(spec.z_min, spec.z_max), F.col(c)).alias(c) if c in zs else F.col(c)
        for c in df.columns])


def drop_all_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows whose ``cols`` are all missing; partial rows stay."""
    return df.dropna(how="all", subset=list(cols))


def drop_any_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows with any missing value in ``cols``."""
    return df.dropna(how="any", subset=list(cols))


# -- P10 codebook decoding -------------------------------------------------------

def _codebook_map(book: dict[int, str]) -> Column:
    items = []
    for code, label in book.items():
        items += [F.lit(float(code)), F.lit(label)]
    return F.create_map(*items)


def decode_codebook(df: DataFrame, spec: SurveySpec, skip: Sequence[str] = ()) -> DataFrame:
    """Code -> text for the codebook columns present; unmapped codes -> null (values compare as given: 12.7 is no code 12).

    The codebook is a handful of fixed literals, so it is an inline map
    lookup (no join).  Columns in ``skip`` (the protected group column) keep codes.
    """
    skip_l = {s.lower() for s in skip}
    books = {col_lookup(df, c): b for c, b in spec.codebook.items()
             if col_lookup(df, c) and c.lower() not in skip_l}
    return df.select(*[
        _codebook_map(books[c])[F.col(c).cast("double")].alias(c) if c in books else F.col(c)
        for c in df.columns])


def decode_new_nulls(df: DataFrame, spec: SurveySpec, skip: Sequence[str] = ()) -> DataFrame:
    """Per decoded column, values that were present but have no codebook entry."""
    skip_l = {s.lower() for s in skip}
    exprs = {}
    for c, book in spec.codebook.items():
        name = col_lookup(df, c)
        if name and c.lower() not in skip_l:
            decoded = _codebook_map(book)[F.col(name).cast("double")]
            exprs[name] = count_if(F.col(name).isNotNull() & decoded.isNull())
    return _long_counts(df, exprs, "column", "new_nulls")


#: A codebook table up to this many entries and characters of text is sent to every task.
BOOK_ENTRIES, BOOK_CHARS = 200_000, 16 << 20
#: Codes that hold at least one row in this many are looked up apart when the codebook is joined by a shuffle.
HOT_SHARE = 500
SALTS = 1024


def decode_by_table(df: DataFrame, book: DataFrame, columns: Sequence[str] | None = None, max_entries: int = BOOK_ENTRIES,
                    max_chars: int = BOOK_CHARS) -> DataFrame:
    """Code -> text by a codebook table (column, code, text), for the columns named in it (or only ``columns``).

    Unmapped and missing codes give null; values compare as given (12.7 is no code 12).  Column names match in any case;
    equal entries count once; two texts for one code are an error.  One aggregation over the book tells each column's
    entries and characters.  A book within both bounds is broadcast.  A larger one is joined by a shuffle on the code: codes
    that at least one row in ``HOT_SHARE`` has (at most that many) are looked up by a broadcast of just their entries, and
    their rows, like rows without a code, are dealt evenly over the join's partitions, where they match nothing.
    """
    entries = book.select(F.lower("column").alias("column"), "code", "text").where("code is not null").distinct()
    per_code = entries.groupBy("column", "code").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    size = {r["column"]: r for r in per_code.groupBy("column").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("chars").alias("chars"), F.max("n").alias("texts")).collect()}
    wanted = [c for c in (columns if columns is not None else df.columns) if c.lower() in size]
    clash = [c for c in wanted if size[c.lower()]["texts"] > 1]
    if clash:
        raise ValueError(f"codebook has several texts for one code in {clash}")
    names = df.columns
    for c in (n for n in present(df, wanted)):
        of = entries.where(F.col("column") == c.lower())
        code = F.col("code").cast("string") if df.schema[c].dataType.typeName() == "string" else F.col("code")
        of = of.select(code.alias("__code"), F.col("text").alias("__text"))
        small = size[c.lower()]["entries"] <= max_entries and size[c.lower()]["chars"] <= max_chars
        df = _decode_small(df, of, c) if small else _decode_large(df, of, c)
        df = df.select(*[F.col("__text").alias(n) if n == c else F.col(f"`{n}`") for n in names])
    return df


def _decode_small(df: DataFrame, of: DataFrame, c: str) -> DataFrame:
    return df.join(F.broadcast(of), F.col(f"`{c}`") == F.col("__code"), "left")


def _decode_large(df: DataFrame, of: DataFrame, c: str) -> DataFrame:
    counts = df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("__hot")).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1))).first()[0]
    hot = [r["__hot"] for r in counts.where(F.col("__n") >= total / HOT_SHARE).select("__hot").collect()]      # at most HOT_SHARE
    hot_codes = df.sparkSession.createDataFrame([(h,) for h in hot], T.StructType([T.StructField("__hot", df.schema[c].dataType)]))
    hot_book = F.broadcast(hot_codes).join(of, F.col("__hot") == F.col("__code"), "left").select("__hot", F.col("__text").alias("__hot_text"))
    df = df.join(F.broadcast(hot_book), F.col(f"`{c}`") == F.col("__hot"), "left")
    apart = F.col("__hot").isNotNull() | F.col(f"`{c}`").isNull()
    df = df.withColumn("__salt", F.when(apart, F.lit(1) + F.pmod(F.xxhash64(*[f"`{n}`" for n in df.columns if not n.startswith("__")]),
                                                                 F.lit(SALTS))).otherwise(F.lit(0)).cast("long"))
    of = of.withColumn("__at", F.lit(0).cast("long"))
    out = df.join(of.hint("merge"), (F.col(f"`{c}`") == F.col("__code")) & (F.col("__salt") == F.col("__at")), "left")
    return out.withColumn("__text", F.when(F.col("__hot").isNotNull(), F.col("__hot_text")).otherwise(F.col("__text")))


# -- P11 clipping -------------------------------------------------------------------

def clip_bounds(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """Clip the bounded column to [clip_lo, clip_hi]; missing stays missing."""
    name = col_lookup(df, spec.clip_col)
    if name is None:
        return df
    c = F.col(name)
    dt = df.schema[name].dataType
    clipped = F.when(c.isNotNull(), F.greatest(F.lit(spec.clip_lo), F.least(c, F.lit(spec.clip_hi))))
    return df.select(*[clipped.cast(dt).alias(name) if x == name else F.col(x) for x in df.columns])


def clip_counts(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """Values below and above the clip bounds: (side, n)."""
    name = col_lookup(df, spec.clip_col)
    if name is None:
        return _long_counts(df, {}, "side", "n")
    c = F.col(name)
    return _long_counts(df, {"below": count_if(c < spec.clip_lo), "above": count_if(c > spec.clip_hi)},
                        "side", "n")


# -- P12 composite index --------------------------------------------------------------

def deprivation_components(df: DataFrame, spec: SurveySpec) -> list[Column]:
    comps: list[Column] = []
    w = col_lookup(df, spec.wealth_col)
    if w:
        wq = F.expr(f"try_cast(`{w}` as double)")
        comps.append(F.lit(1.0) - (wq - F.lit(1.0)) / F.lit(4.0))
    e = col_lookup(df, spec.education_col)
    if e:
        items = []
        for k, v in EDUCATION_ORDINAL.items():
            items += [F.lit(k), F.lit(float(v))]
        edu = F.create_map(*items)[F.col(e).cast("string")]
        comps.append(F.lit(1.0) - edu / F.lit(3.0))
    t = col_lookup(df, spec.toilet_col)
    if t:
        comps.append(not_in_or_null(F.col(t), IMPROVED_SANITATION).cast("double"))
    wa = col_lookup(df, spec.water_col)
    if wa:
        comps.append(not_in_or_null(F.col(wa), IMPROVED_WATER).cast("double"))
    return comps


def deprivation_index(df: DataFrame, spec: SurveySpec, out_col: str = "sdi") -> DataFrame:
    """Mean of the available components (missing ones skipped), half-even to 4 places.

    Components: inverted wealth quintile, inverted education ordinal, toilet
    not improved, water not improved (a missing category counts as not improved).
    No component column present -> the frame is returned unchanged.
    """
    comps = deprivation_components(df, spec)
    if not comps:
        return df
    total, n = None, None
    for c in comps:
        v = F.coalesce(c, F.lit(0.0))
        k = c.isNotNull().cast("int")
        total = v if total is None else total + v
        n = k if n is None else n + k
    mean = F.when(n > 0, total / n.cast("double"))
    return df.withColumn(out_col, F.bround(mean, 4))


# -- P13/P14/P15/P16 schema helpers ----------------------------------------------------

def detect_group_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate present in the schema (metadata only, no job)."""
    for c in candidates:
        name = col_lookup(df, c)
        if name:
            return name
    return None


def assert_columns_exist(df: DataFrame, required: Sequence[str], context: str = "DataFrame") -> None:
    require_columns(df, required, context)


def feature_select(df: DataFrame, spec: SurveySpec, features: Sequence[str] | None = None) -> DataFrame:
    """Row id + features: an explicit list, or every column but targets and z."""
    if features is None:
        ex = {c.lower() for c in (*spec.targets, *spec.z_cols, spec.id_col)}
        features = [c for c in df.columns if c.lower() not in ex]
    return df.select(spec.id_col, *features)


def fill_label_zero(df: DataFrame, spec: SurveySpec) -> DataFrame:
    """Missing target treated as negative (multi-label fitting only)."""
    return df.fillna(0, subset=present(df, spec.targets))


# -- R1 exact dedup ------------------------------------------------------------------------

def dedup_exact(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Drop exact duplicate rows.

    With a surrogate ``id_col`` the row data excludes it and the smallest id of
    each duplicate group is kept, so the result is deterministic.  A duplicate
    group of any size collapses in the map-side partial aggregate.
    """
    if id_col is None or col_lookup(df, id_col) is None:
        return df.dropDuplicates()
    idn = col_lookup(df, id_col)
    data = [c for c in df.columns if c != idn]
    kept = df.groupBy(*data).agg(F.min(idn).alias(idn))
    return kept.select(*df.columns)


def duplicate_count(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """Rows that exact dedup would remove: one row (rows, distinct_rows, duplicates)."""
    idn = col_lookup(df, id_col) if id_col else None
    data = [c for c in df.columns if c != idn]
    g = df.groupBy(*data).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").cast("long").alias("rows"),
                 F.count(F.lit(1)).cast("long").alias("distinct_rows"),
                 F.sum(F.col("_n") - 1).cast("long").alias("duplicates"))


# -- O1 fixed-order chain ----------------------------------------------------------------

def clean_chain(df: DataFrame, spec: SurveySpec, impute_from: DataFrame | None = None,
                materialize: bool = True) -> DataFrame:
    """dedup -> detect group column -> decode -> impute -> clip -> index -> dedup.

    Imputation statistics are fitted on ``impute_from`` (default: the
    deduplicated input itself, which is what the reference pipeline does).
    The fit reads the deduplicated table several times (distinct values,
    size check, medians, modes) and the result reads it once more, so by
    default it is checkpointed once into the shared folder: the input scan,
    joins and dedup shuffle run once, and the lineage is cut there.
    """
    from surveyspark.operators import impute
    from surveyspark.session import checkpoint_dir

    d1 = dedup_exact(df, spec.id_col)
    if materialize:
        checkpoint_dir(d1.sparkSession)
        d1 = d1.checkpoint(eager=True)
    group = detect_group_column(d1, spec.group_candidates)
    skip = [group] if group else []
    dec = decode_codebook(d1, spec, skip=skip)
    stats = impute.fit_imputer(impute_from if impute_from is not None else dec, spec, group)
    imp = impute.apply_imputer(dec, stats)
    clipped = clip_bounds(imp, spec)
    idx = deprivation_index(clipped, spec)
    return dedup_exact(idx, spec.id_col)
