"""Preprocessing (#30-#38): missing report, target floors, label encoding,
median imputation, standard scaling. Medians, means and scales are a few plain
values applied as literals; the classes of a categorical feature are a table
(class, code) that is joined on the class and never passes through the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..session import written
from .stats import exact_median


@dataclass
class Prep:
    features: list[str]
    categorical: list[str]
    numerical: list[str]
    classes: dict[str, DataFrame] = field(default_factory=dict)  # feature -> (class, code)
    unknown: dict[str, int] = field(default_factory=dict)  # feature -> code of 'unknown'
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    scales: dict[str, float] = field(default_factory=dict)

    def to_json(self) -> str:
        """Everything but the class tables."""
        return json.dumps({k: v for k, v in vars(self).items() if k != "classes"}, sort_keys=True)

    @staticmethod
    def from_json(text: str, classes: dict[str, DataFrame] | None = None) -> "Prep":
        return Prep(**json.loads(text), classes=classes or {})

    def first_class(self, feature: str) -> str | None:
        """The first class of a feature but 'unknown'."""
        r = self.classes[feature].where(F.col("class") != S.UNKNOWN).orderBy("code").first()
        return r["class"] if r else None


# --------------------------------------------------------------------------- reports

def missing_report(train: DataFrame, cols) -> DataFrame:
    """Nulls and null % per numerical feature on train, only where > 0 (#30)."""
    cols = list(cols)
    aggs = [F.count(F.lit(1)).alias("_rows")] + [
        F.count_if(F.col(c).isNull()).alias(c) for c in cols]
    wide = train.agg(*aggs)
    stacked = F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"),
                 F.col(c).alias("n_missing")) for i, c in enumerate(cols)]))
    long = wide.select("_rows", stacked)
    return long.where(F.col("n_missing") > 0).select(
        "position", "feature", "n_missing",
        F.round(F.col("n_missing") / F.col("_rows") * 100, 6).alias("pct_missing"))


def floor_targets(df: DataFrame, targets=None, suffix: str = "") -> DataFrame:
    """``floor`` of each target (as double, like numpy), after the split (#38)."""
    targets = S.available(df.columns, targets or S.TARGETS)
    return df.select(
        *[c for c in df.columns if c not in targets or suffix],
        *[F.floor(F.col(t)).cast("double").alias(t + suffix) for t in targets])


def target_floor_stats(train: DataFrame, targets=None) -> DataFrame:
    """Mean and sample std of each target before and after the floor (#31)."""
    targets = S.available(train.columns, targets or S.TARGETS)
    aggs = []
    for t in targets:
        fl = F.floor(F.col(t)).cast("double")
        aggs += [F.avg(t).alias(f"om_{t}"), F.stddev_samp(t).alias(f"os_{t}"),
                 F.avg(fl).alias(f"fm_{t}"), F.stddev_samp(fl).alias(f"fs_{t}")]
    wide = train.agg(*aggs)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("target"),
                 F.round(f"om_{t}", 6).alias("orig_mean"), F.round(f"os_{t}", 6).alias("orig_std"),
                 F.round(f"fm_{t}", 6).alias("floor_mean"), F.round(f"fs_{t}", 6).alias("floor_std"))
        for t in targets])))


# --------------------------------------------------------------------------- fit

def feature_lists(columns) -> tuple[list[str], list[str], list[str]]:
    features = S.available(columns, S.FEATURE_ORDER)
    categorical = [f for f in S.CATEGORICAL_FEATURES if f in features]
    numerical = [f for f in features if f not in categorical]
    return features, categorical, numerical


def ranked(values: DataFrame, column: str, out: str) -> DataFrame:
    """Distinct ``values`` with their place in sorted order from 0 as ``out`` (long), written once.

    Values are range-partitioned (ranges of about equal size, whatever prefixes they share) and sorted inside each
    range; a range's rows are numbered where they stand, and the counts of the ranges before it are added: one row
    a range, so no task sorts or numbers more than its own range."""
    here = F.monotonically_increasing_id()  # range number in the upper bits, place inside the range in the lower 33
    placed = written(written(values, "values").repartitionByRange(column).sortWithinPartitions(column)
                     .select(column, here.alias("_at")), "placed")
    size, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(size.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.withColumn("_range", size).join(F.broadcast(starts), "_range").select(
        column, (inside + F.col("_before")).alias(out))


def encode_fit(train: DataFrame, categorical) -> dict[str, DataFrame]:
    """(class, code) per categorical feature (#34): distinct classes in sorted order, codes from 0.

    Missing becomes ``'unknown'``; ``'unknown'`` is always a class, in its
    sorted place, so unseen values have a code. Classes are ranked by ranges
    (``ranked``): no task sorts all of them."""
    out = {}
    for c in categorical:
        seen = train.select(F.coalesce(F.col(c).cast("string"), F.lit(S.UNKNOWN)).alias("class"))
        always = train.sparkSession.createDataFrame([(S.UNKNOWN,)], "class string")
        out[c] = ranked(seen.unionByName(always).distinct(), "class", "code")
    return out


def fit_preprocess(train: DataFrame) -> Prep:
    """Fit encoder, imputer and scaler on the training rows (#33, #34, #37)."""
    features, categorical, numerical = feature_lists(train.columns)
    prep = Prep(features=features, categorical=categorical, numerical=numerical)
    # Written once: every transform reads the small tables instead of fitting them again.
    prep.classes = {c: written(t, f"classes-{c}") for c, t in encode_fit(train, categorical).items()}
    prep.unknown = {c: t.where(F.col("class") == S.UNKNOWN).first()["code"] for c, t in prep.classes.items()}
    medians = exact_median(train, numerical)
    empty = [c for c, v in medians.items() if v is None]
    if empty:
        raise ValueError(f"cannot impute all-missing feature(s): {empty}")
    prep.medians = medians
    processed = impute(encode(train, prep), prep)
    aggs = []
    for f in features:
        aggs += [F.avg(F.col(f).cast("double")).alias(f"m_{f}"),
                 F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}")]
    row = processed.agg(*aggs).first()
    prep.means = {f: row[f"m_{f}"] for f in features}
    prep.scales = {f: (row[f"s_{f}"] if row[f"s_{f}"] else 1.0) for f in features}
    return prep


# --------------------------------------------------------------------------- transforms

def encode(df: DataFrame, prep: Prep, unseen: str = "unknown",
           error_col: str | None = None) -> DataFrame:
    """Category -> code (#35): NULL -> 'unknown'; unseen -> 'unknown' (default)
    or, with ``unseen='error'``, NULL code plus a message in ``error_col``."""
    out = df
    for c in prep.categorical:
        tab = prep.classes[c].select(F.col("class").alias("_class"), F.col("code").alias("_code"))
        v = F.coalesce(F.col(c).cast("string"), F.lit(S.UNKNOWN))
        out = out.withColumn("_value", v).join(tab, F.col("_value") == F.col("_class"), "left")
        if unseen == "error":
            if error_col:
                msg = F.concat(F.lit(f"unseen category for {c}: '"), F.col(c).cast("string"), F.lit("'"))
                prev = F.col(error_col) if error_col in out.columns else F.lit(None).cast("string")
                out = out.withColumn(error_col, F.coalesce(prev, F.when(F.col("_code").isNull(), msg)))
            out = out.withColumn(c, F.col("_code").cast("double"))
        else:
            out = out.withColumn(c, F.coalesce(F.col("_code"), F.lit(prep.unknown[c])).cast("double"))
        out = out.drop("_value", "_class", "_code")
    return out


def impute(df: DataFrame, prep: Prep) -> DataFrame:
    """Numerical NULL -> train median (#36)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(prep.medians[c])))
                           for c in prep.numerical})


def missing_count(cols) -> F.Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c).isNull().cast("int")
    return total


def scale(df: DataFrame, prep: Prep, suffix: str = "") -> DataFrame:
    """(x - mean) / population std, std 0 -> 1, for all features (#37)."""
    cols = {f + suffix: (F.col(f).cast("double") - F.lit(float(prep.means[f])))
            / F.lit(float(prep.scales[f])) for f in prep.features}
    return df.withColumns(cols)


def apply_preprocess(df: DataFrame, prep: Prep, unseen: str = "unknown") -> DataFrame:
    return scale(impute(encode(df, prep, unseen), prep), prep)


def scaling_check(scaled: DataFrame, cols) -> DataFrame:
    """Mean and population std of scaled features (#32)."""
    cols = list(cols)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    wide = scaled.agg(*aggs)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"),
                 F.round(f"m_{c}", 6).alias("mean"), F.round(f"s_{c}", 6).alias("std"))
        for i, c in enumerate(cols)])))
