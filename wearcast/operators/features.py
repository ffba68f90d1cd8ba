"""Feature selection, catalog, request coercion and validation (#10-#15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions import exprs as X
from ..session import jit_sized
from .preprocess import Prep


def select_features(df: DataFrame, keep=(S.KEY,)) -> DataFrame:
    """Available features in group order, then available targets; excluded
    columns are dropped (#10). ``keep`` columns go first."""
    keep = [c for c in keep if c in df.columns]
    return df.select(*keep, *S.available(df.columns, S.FEATURE_ORDER),
                     *S.available(df.columns, S.TARGETS))


def feature_kinds(columns) -> tuple[list[str], list[str]]:
    feats = S.available(columns, S.FEATURE_ORDER)
    cat = [f for f in S.CATEGORICAL_FEATURES if f in feats]
    return cat, [f for f in feats if f not in cat]


#: Options on a page; a catalog row shows the first page.
PAGE = 100


def feature_options(prep: Prep) -> DataFrame:
    """(feature, position, option): one row per class of every categorical feature, position from 0 in sorted order
    (#11). The options are a table; no row or task holds all of them."""
    tables = [t.select(F.lit(f).alias("feature"), F.col("code").cast("long").alias("position"),
                       F.col("class").alias("option")) for f, t in prep.classes.items()]
    return reduce(DataFrame.unionByName, tables)


def options_page(prep: Prep, feature: str, page: int = 0, size: int = PAGE) -> DataFrame:
    """The options of one feature at positions ``page * size`` and on, at most ``size`` of them."""
    at = F.col("position")
    return feature_options(prep).where((F.col("feature") == feature) & (at >= page * size) & (at < (page + 1) * size))


def feature_catalog(spark, prep: Prep, shown: int | None = PAGE) -> DataFrame:
    """One row per model feature: position, name, type, the number of options and the first ``shown`` of them (None:
    all, comma-joined) for categorical ones, guidance text for numerical ones (#11). Built from the fitted package:
    a handful of rows; ``feature_options`` is the table of all options, one a row."""
    rows = [(i, f, "categorical" if f in prep.categorical else "numerical") for i, f in enumerate(prep.features)]
    df = spark.createDataFrame(rows, "position int, name string, type string")
    options, many = F.lit(None).cast("string"), F.lit(0).cast("long")
    for f, classes in prep.classes.items():
        page = F.array_sort(F.collect_list(F.struct("position", "option")))
        listed = options_page(prep, f, size=shown) if shown else feature_options(prep).where(F.col("feature") == f)
        joined = listed.agg(F.array_join(F.transform(page, lambda x: x["option"]), ",").alias("o")).scalar()
        options = F.when(F.col("name") == f, joined).otherwise(options)
        many = F.when(F.col("name") == f, classes.agg(F.count(F.lit(1)).alias("n")).scalar()).otherwise(many)
    df = df.withColumn("n_options", many).withColumn("options", options)
    expr = F.when(F.col("type") == "categorical", F.lit(None).cast("string"))
    for name, text in S.GUIDANCE.items():
        expr = expr.when(F.col("name") == name, F.lit(text))
    expr = expr.when(F.col("name").contains("days_since"), X.days_since_guidance(F.col("name")))
    return df.withColumn("guidance", expr.otherwise(F.lit("")))


def coerce_numeric(df: DataFrame, cols, error_col: str = "error") -> DataFrame:
    """Request texts -> doubles (#13). Missing tokens become NULL (imputed
    later); any other non-number fails the row: ``error_col`` gets a message
    for the first bad feature in order.

    Staged projections: each text is trimmed once, matched once and cast
    once; the error message only combines per-column boolean flags."""
    jit_sized(df.sparkSession)
    texts = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    typed = [c for c in cols if c not in texts]
    d = df.withColumns({f"_t_{c}": X.strip_ws(F.col(c)) for c in texts})
    d = d.withColumns({f"_n_{c}": F.when(F.col(f"_t_{c}").rlike(S.NUMBER_PATTERN),
                                         F.col(f"_t_{c}").try_cast("double")) for c in texts})
    d = d.withColumns({f"_f_{c}": X.finite(F.col(f"_n_{c}")) for c in texts})
    # the (costlier) missing-token test only runs for texts that are not numbers
    d = d.withColumns({f"_m_{c}": F.when(F.col(f"_f_{c}"), F.lit(False)).otherwise(
        X.request_missing(F.col(c), F.col(f"_t_{c}"))) for c in texts})
    first_bad = F.lit(None).cast("string")
    for c in reversed(texts):
        bad = ~F.col(f"_m_{c}") & ~F.col(f"_f_{c}")
        msg = F.concat(F.lit(f"could not convert string to float: {c}='"), F.col(c), F.lit("'"))
        first_bad = F.when(bad, msg).otherwise(first_bad)
    err = F.col(error_col) if error_col in df.columns else F.lit(None).cast("string")
    d = d.withColumn(error_col, F.coalesce(err, first_bad))
    d = d.withColumns({
        **{c: F.when(F.col(f"_f_{c}") & ~F.col(f"_m_{c}"), F.col(f"_n_{c}")) for c in texts},
        **{c: X.nan_to_null(F.col(c).cast("double")) for c in typed}})
    return d.drop(*[f"_{k}_{c}" for c in texts for k in "tnmf"])


def known_category(df: DataFrame, prep: Prep, col: str = "model", out: str = "known") -> DataFrame:
    """True where the category (NULL read as 'unknown') is a fitted class (#14): a join with the class table."""
    if col not in prep.classes:
        return df.withColumn(out, F.lit(False))
    known = prep.classes[col].select(F.col("class").alias("_class"))
    value = F.coalesce(F.col(col).cast("string"), F.lit(S.UNKNOWN))
    d = df.withColumn("_value", value).join(known, F.col("_value") == F.col("_class"), "left")
    return d.withColumn(out, F.col("_class").isNotNull()).drop("_value", "_class")


def validate_requests(df: DataFrame, features, error_col: str = "error") -> DataFrame:
    """``success``/``error`` per request (#15): a feature absent from the
    request (column missing, or listed in ``absent_features``) or a bad number
    fails it; missing values pass (they are imputed)."""
    err = F.col(error_col) if error_col in df.columns else F.lit(None).cast("string")
    missing_cols = [f for f in features if f not in df.columns]
    if missing_cols:
        err = F.coalesce(err, F.lit(f"missing feature(s): {missing_cols}"))
    if "absent_features" in df.columns:
        absent = F.array_intersect(F.col("absent_features"), F.array(*[F.lit(f) for f in features]))
        err = F.coalesce(err, F.when(F.size(absent) > 0, F.concat(
            F.lit("missing feature(s): "), F.array_join(absent, ", "))))
    out = df.withColumn(error_col, err)
    present = [f for f in features if f in df.columns]
    numeric = [f for f in present if f not in S.CATEGORICAL_FEATURES]
    out = coerce_numeric(out, numeric, error_col)
    return out.withColumn("success", F.col(error_col).isNull())
