"""k-fold cross-validation (#62, ours): folds by seeded hash; for each fold
the preprocessing and the four regressors are fitted on the other folds and
evaluated on it with the holdout metric aggregation.

A fold's design matrix (its rows preprocessed by what the other folds gave, with
the side each is on) is written once to the shared folder. It doesn't depend on the
model's parameters, so all points of a grid share it. The models are fitted on all rows
outside the fold."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import metrics as M
from ..operators import model as ML
from ..operators.extras import fold_assignment
from ..operators.preprocess import apply_preprocess, fit_preprocess
from ..session import written
from .training import Prepared


@dataclass
class FoldDesign:
    """Key, scaled features, floored targets and ``split`` of every row, as one fold sees them."""
    fold: int
    rows: DataFrame
    features: list[str]
    targets: list[str]


def fold_designs(p: Prepared, k: int = 5, seed: int = S.SEED, key: str = S.KEY,
                 parallelism: int = 3) -> list[FoldDesign]:
    """Preprocessing fitted ``k`` times, on the rows outside each fold, and its result written."""
    data = fold_assignment(p.split.drop("split"), k, seed, key)
    targets = S.available(data.columns, S.TARGETS)

    def one(fold: int) -> FoldDesign:
        d = data.withColumn("split", F.when(F.col("fold") == fold, F.lit("test")).otherwise(F.lit("train")))
        prep = fit_preprocess(d.where(F.col("split") == "train"))
        x = apply_preprocess(d, prep)
        x = x.withColumns({t: F.floor(F.col(t)).cast("double") for t in targets})
        x = x.select(key, *prep.features, *targets, "split")
        return FoldDesign(fold, written(x, f"fold-{fold}"), prep.features, targets)

    return _together(one, range(k), parallelism)


def fold_scores(design: FoldDesign, params: dict, key: str = S.KEY) -> DataFrame:
    """Metrics of one fold under one set of model parameters."""
    t = design.targets
    model = ML.fit_multi(design.rows.where(F.col("split") == "train"), design.features, {x: x for x in t}, params, key=key)
    long = M.predictions_long(ML.predict(design.rows, model), t, key, "split")
    return M.metrics_by_target(long).withColumn("fold", F.lit(design.fold))


def _together(work, items, parallelism: int) -> list:
    """Independent pieces of work whose jobs share the cluster, a few at a time."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(work, items))


def cross_validate(p: Prepared, k: int = 5, profile: str = "smoke", seed: int = S.SEED,
                   key: str = S.KEY, params: dict | None = None,
                   parallelism: int = 3) -> DataFrame:
    """The metrics of every fold, fitted on all rows outside it."""
    designs = fold_designs(p, k, seed, key, parallelism)
    params = params or ML.gbt_params(profile)
    return reduce(DataFrame.unionByName, _together(lambda d: fold_scores(d, params, key), designs, parallelism))


def fold_metrics(predicted: DataFrame, k: int = 5, seed: int = S.SEED, key: str = S.KEY) -> DataFrame:
    """Metrics of given ``pred_*`` columns with each fold in turn as the test rows (the aggregation
    of ``cross_validate``)."""
    data = fold_assignment(predicted, k, seed, key)
    targets = S.available(data.columns, S.TARGETS)
    side = lambda i: F.when(F.col("fold") == i, F.lit("test")).otherwise(F.lit("train"))
    out = [M.metrics_by_target(M.predictions_long(data.withColumn("split", side(i)), targets, key, "split"))
           .withColumn("fold", F.lit(i)) for i in range(k)]
    return reduce(DataFrame.unionByName, out)
