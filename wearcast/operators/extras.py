"""Capabilities the reference README claims without code (#62-#66).

The definitions here are ours (documented in the README):

* folds: ``fold = first 60 bits of md5('<seed>-fold-' || key) mod k``, a
  projection (no global rank, so no single-task sort);
* cross-validation: fit on k-1 folds, evaluate the held-out fold with the
  same metric aggregation as the holdout;
* outliers: 1.5 x IQR fences from exact quartiles; rows are flagged, never
  dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import exprs as X
from .stats import exact_quantiles


def fold_assignment(df: DataFrame, k: int = 5, seed: int = S.SEED, key: str = S.KEY,
                    out: str = "fold") -> DataFrame:
    """Add ``fold`` in 0..k-1 (#63)."""
    h = X.hash_prefix(X.hash_order(F.col(key), f"{seed}-fold-"))
    return df.withColumn(out, F.pmod(h, F.lit(k)).cast("int"))


def fold_sizes(folded: DataFrame, fold: str = "fold") -> DataFrame:
    return folded.groupBy(fold).agg(F.count(F.lit(1)).alias("n_rows"))


def iqr_fences(df: DataFrame, cols, factor: float = 1.5) -> dict[str, tuple]:
    """{col: (q1, q3, lower, upper)} from exact quartiles. A fence beyond the largest double is infinite and flags
    nothing; quartiles at one infinity have no distance."""
    q = exact_quantiles(df, cols, (0.25, 0.75))
    out = {}
    for c, (q1, q3) in q.items():
        if q1 is None:
            out[c] = (None, None, None, None)
        else:
            iqr = 0.0 if q1 == q3 else q3 - q1
            out[c] = (q1, q3, q1 - factor * iqr, q3 + factor * iqr)
    return out


def outlier_flags(df: DataFrame, cols, factor: float = 1.5,
                  fences: dict | None = None) -> DataFrame:
    """Add ``{col}_outlier`` (value outside the fences; NULL stays NULL) (#65)."""
    fences = fences or iqr_fences(df, cols, factor)
    return df.withColumns({
        f"{c}_outlier": (F.col(c) < F.lit(fences[c][2])) | (F.col(c) > F.lit(fences[c][3]))
        for c in cols if fences[c][0] is not None})


def outlier_summary(df: DataFrame, cols, factor: float = 1.5) -> DataFrame:
    """(feature, q1, q3, lower, upper, n_outliers) per column."""
    fences = iqr_fences(df, cols, factor)
    flagged = outlier_flags(df, cols, factor, fences)
    live = [c for c in cols if fences[c][0] is not None]
    counts = flagged.agg(*[F.count_if(F.col(f"{c}_outlier")).alias(c) for c in live])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(fences[c][0]).alias("q1"),
                 F.lit(fences[c][1]).alias("q3"), F.lit(fences[c][2]).alias("lower"),
                 F.lit(fences[c][3]).alias("upper"), F.col(c).alias("n_outliers"))
        for c in live])))
