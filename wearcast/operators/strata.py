"""Stratum labels (#21-#24): row mean of targets, equal-width bins, combined label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import exprs as X


def row_mean(df: DataFrame, cols=None, out: str = "mean_ttf") -> DataFrame:
    """Mean of the available target columns per row, NULLs skipped (#21)."""
    cols = S.available(df.columns, cols or S.TARGETS)
    if not cols:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, X.row_mean(cols))


def bin_stats(df: DataFrame, cols) -> dict[str, tuple[float | None, float | None]]:
    """(min, max) of each column in one aggregate pass (a one-row result)."""
    if not cols:
        return {}
    aggs = []
    for c in cols:
        aggs += [F.min(F.col(c).cast("double")).alias(f"mn_{c}"),
                 F.max(F.col(c).cast("double")).alias(f"mx_{c}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"mn_{c}"], row[f"mx_{c}"]) for c in cols}


def equal_width_bin(df: DataFrame, col: str, labels, out: str,
                    stats: tuple[float | None, float | None] | None = None) -> DataFrame:
    """Equal-width, right-closed bins over the column's [min, max] (#22).

    The edges come from one global min/max aggregate (partial aggregation per
    partition, so it scales); the binning itself is a projection.
    """
    mn, mx = stats if stats is not None else bin_stats(df, [col])[col]
    if mn is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    return df.withColumn(out, X.equal_width_bin(F.col(col).cast("double"), mn, mx, labels))


_PARTS = [
    # (source column, bin labels or None for the category itself, output column)
    ("model", None, "model_part"),
    ("mean_ttf", S.TTF_RANGE_LABELS, "ttf_range"),
    ("age", S.AGE_GROUP_LABELS, "age_group"),
    ("error_count", S.ERROR_LEVEL_LABELS, "error_level"),
]


def strata_labels(df: DataFrame, out: str = "stratum", keep_parts: bool = False) -> DataFrame:
    """``model_ttfRange_ageGroup_errorLevel`` per row (#23).

    A missing value prints as ``'nan'``; an absent input column gives
    ``'default'``. One aggregate pass computes all bin edges.
    """
    has_targets = bool(S.available(df.columns, S.TARGETS))
    d = row_mean(df, out="mean_ttf") if has_targets else df
    binned = [c for c, labels, _ in _PARTS
              if labels is not None and c in d.columns and (c != "mean_ttf" or has_targets)]
    stats = bin_stats(d, binned)
    parts = []
    for src, labels, name in _PARTS:
        present = src in d.columns and (src != "mean_ttf" or has_targets)
        if not present:
            expr = F.lit(S.STRATUM_ABSENT)
        elif labels is None:
            expr = F.coalesce(F.col(src).cast("string"), F.lit(S.STRATUM_MISSING))
        else:
            mn, mx = stats[src]
            expr = (F.lit(S.STRATUM_MISSING) if mn is None else
                    F.coalesce(X.equal_width_bin(F.col(src).cast("double"), mn, mx, labels),
                               F.lit(S.STRATUM_MISSING)))
        parts.append(expr.alias(name))
    d = d.select("*", *parts)
    d = d.withColumn(out, F.concat_ws("_", *[F.col(n) for _, _, n in _PARTS]))
    if not keep_parts:
        d = d.drop(*[n for _, _, n in _PARTS])
        if has_targets and "mean_ttf" not in df.columns:
            d = d.drop("mean_ttf")
    return d


def strata_count(labelled: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Number of distinct strata (#24)."""
    return labelled.agg(F.count_distinct(F.col(stratum)).alias("n_strata"))
