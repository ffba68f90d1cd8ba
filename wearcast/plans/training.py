"""The training pipeline: features -> exact stratified split of all rows -> fit
preprocessing on all train rows -> floor targets -> one GBT per target on all
train rows -> predictions -> metrics and importances -> package.

Every statistic, transform, fit, prediction and metric covers all rows; only a caller who names ``fit_rows`` gets
trees of a stratified draw of so many train rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import metrics as M
from ..operators import model as ML
from ..operators.features import select_features
from ..operators.preprocess import Prep, encode, fit_preprocess, impute, scale
from ..operators.sampling import Draw, stratified_sample, stratified_split
from ..operators.strata import strata_labels
from ..session import dropped, jit_sized, kept, written
from ..sources.package import Package


@dataclass
class Prepared:
    """The steps up to the model, each worked out when first asked for."""
    obs: DataFrame                              # the input observations
    sample_size: int | Draw = S.SAMPLE_SIZE     # of the sampling step and its reports
    seed: int = S.SEED
    key: str = S.KEY

    @cached_property
    def labelled(self) -> DataFrame:
        """All rows with their stratum."""
        return strata_labels(self.obs)

    @cached_property
    def sample(self) -> DataFrame:
        """The exact stratified sample (with its strata)."""
        return stratified_sample(self.labelled, "stratum", self.sample_size, self.seed, self.key)

    @cached_property
    def sample_split(self) -> DataFrame:
        """The sample as train and test rows, for the sample report."""
        return self._split(self.sample)

    @cached_property
    def split(self) -> DataFrame:
        """Key, features and targets of all rows as train and test rows; the fits pass over it several
        times, so it is written once to the shared folder."""
        rows, self._split_path = kept(self._split(self.obs), "split", compression="zstd")
        return rows

    def drop_split(self) -> None:
        """Frees the disk of the split rows once nothing reads them any more; asked for again, they are made anew."""
        if "split" in vars(self):
            dropped(self.obs.sparkSession, self._split_path)
            del self.split

    def _split(self, df: DataFrame) -> DataFrame:
        chosen = select_features(df, keep=(self.key,))
        return stratified_split(chosen, "model", S.TEST_FRACTION, self.seed, self.key)

    @cached_property
    def prep(self) -> Prep:
        """Fitted on all train rows."""
        return fit_preprocess(self.train)

    @property
    def train(self) -> DataFrame:
        return self.split.where(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.split.where(F.col("split") == "test")


def prepare(obs: DataFrame, sample_size: int | Draw = S.SAMPLE_SIZE, seed: int = S.SEED,
            key: str = S.KEY) -> Prepared:
    jit_sized(obs.sparkSession)
    return Prepared(obs, sample_size, seed, key)


def processed(p: Prepared, key: str = S.KEY, rows: DataFrame | None = None) -> DataFrame:
    """Split rows (all, or the given ``rows`` of them) with ``orig_*`` (raw), ``proc_*`` (encoded + imputed) and
    scaled features under their own names; targets floored in place with
    the raw value kept as ``{target}_orig``."""
    feats = p.prep.features
    targets = S.available(p.split.columns, S.TARGETS)
    d = (p.split if rows is None else rows).select(
        key, "split", *feats,
        *[F.col(f).alias(f"orig_{f}") for f in feats],
        *[F.floor(F.col(t)).cast("double").alias(t) for t in targets],
        *[F.col(t).alias(f"{t}_orig") for t in targets])
    d = impute(encode(d, p.prep), p.prep)
    d = d.select("*", *[F.col(f).alias(f"proc_{f}") for f in feats])
    return scale(d, p.prep)


@dataclass
class Trained:
    prepared: Prepared
    package: Package
    predicted: DataFrame   # processed split rows + pred_* columns, worked out wherever they are read
    long: DataFrame
    metrics: DataFrame
    importance: DataFrame

    @cached_property
    def scored(self) -> DataFrame:
        """``predicted``, for what reads it several times: written once to the shared folder when first asked for."""
        return written(self.predicted, "scored", compression="zstd")


def train(spark: SparkSession, obs: DataFrame, profile: str = "test",
          fit_rows: int | None = None, seed: int = S.SEED, key: str = S.KEY,
          params: dict | None = None, prepared: Prepared | None = None) -> Trained:
    """Fit the package on all train rows, or with ``fit_rows`` its trees on so many of them (an
    exact draw, proportional by model); predictions and metrics
    cover all rows. ``prepared`` reuses an earlier split and preprocessing fit
    of the same ``obs``."""
    p = prepared if prepared is not None else prepare(obs, seed=seed, key=key)
    data = processed(p, key)
    targets = S.available(data.columns, S.TARGETS)
    params = params or ML.gbt_params(profile)
    fitted = p.train
    if fit_rows is not None:
        fitted = stratified_sample(fitted, "model" if "model" in p.split.columns else None, fit_rows, seed, key)
    model = ML.fit_multi(processed(p, key, fitted), p.prep.features,
                         {t: t for t in targets}, params, key=key)
    predicted = ML.predict(data, model)
    long = M.predictions_long(predicted, targets, key, "split")
    metrics = written(M.metrics_by_target(long), "metrics")  # a row a target, from one pass; no scored row is stored for it
    imp = ML.importance(spark, model, p.prep.features)
    pkg = Package(prep=p.prep, model=model, targets=targets, params=params,
                  metrics=metrics, importance=imp)
    return Trained(p, pkg, predicted, long, metrics, imp)


def holdout(t: Trained, key: str = S.KEY) -> DataFrame:
    """Test rows of a trained pipeline (#8)."""
    return holdout_table(t.scored, t.prepared.prep.features, t.package.targets, key)


def holdout_table(scored: DataFrame, feats, targets, key: str = S.KEY) -> DataFrame:
    """Test rows: original, processed and scaled features, original and
    floored targets, predictions (#8)."""
    test = scored.where(F.col("split") == "test")
    return test.select(
        key,
        *[F.col(f"orig_{f}") for f in feats],
        *[F.col(f"proc_{f}") for f in feats],
        *[F.col(f).alias(f"scaled_{f}") for f in feats],
        *[F.col(f"{x}_orig") for x in targets],
        *[F.col(x).alias(f"{x}_floor") for x in targets],
        *[F.col(S.pred_col(x)) for x in targets])
