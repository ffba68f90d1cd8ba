"""
``(spark, sf_dir)``, reads the driver tables and returns a DataFrame whose
column names match the SQL oracle in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import extras as EX
from ..operators import features as FT
from ..operators import log as LG
from ..operators import metrics as M
from ..operators import model as ML
from ..operators import preprocess as PP
from ..operators import sampling as SM
from ..operators import scoring as SC
from ..operators import strata as ST
from ..session import scratch_path
from ..sources.observations import (fixture_observations, fixture_request_lines, fixture_requests,
                                    read_observations, unreadable_fields, with_fixed_predictions)
from ..sources.requests import read_requests
from . import oracle as O
from .training import Prepared, Trained, holdout_table, prepare, processed, train

Query = Callable[[SparkSession, str], DataFrame]
MODEL_PROFILE = "test"

#: The registered sampling queries draw a fifth of the rows, so most strata give only some of theirs.
SAMPLE = SM.Draw("fraction", 0.2)


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_observations(spark, sf_dir)


def prepared(spark: SparkSession, sf_dir: str) -> Prepared:
    return prepare(observations(spark, sf_dir), SAMPLE)


def trained(spark: SparkSession, sf_dir: str, profile: str | None = None) -> Trained:
    return train(spark, observations(spark, sf_dir), profile or MODEL_PROFILE)


def _requests(spark, sf_dir) -> DataFrame:
    return fixture_requests(observations(spark, sf_dir))


def _request_lines(spark, sf_dir) -> DataFrame:
    """F3 written as JSON lines and read by the reader (#2); made-up ids show as 'md5'."""
    path = scratch_path(spark, "requests")
    fixture_request_lines(observations(spark, sf_dir)).write.text(path)
    r = read_requests(spark, path)
    return r.withColumn("request_id", F.when(F.col("request_id").startswith("md5-"), F.lit("md5"))
                        .otherwise(F.col("request_id")))


def _split_pred(spark, sf_dir) -> DataFrame:
    """F2 on the split rows: predictions from raw targets, targets floored."""
    p = prepared(spark, sf_dir)
    return PP.floor_targets(with_fixed_predictions(p.split))


def _metrics(spark, sf_dir) -> DataFrame:
    long = M.predictions_long(_split_pred(spark, sf_dir), S.TARGETS, S.KEY, "split")
    return M.metrics_by_target(long)


def _pred_all(spark, sf_dir) -> DataFrame:
    return with_fixed_predictions(observations(spark, sf_dir))


def _round_metrics(m: DataFrame, cols) -> DataFrame:
    return m.select(*[r6(c).alias(c) if c not in ("Target", "Short_Term_Count") else F.col(c)
                      for c in cols])


# --------------------------------------------------------------------------- queries

def _observation_file(spark, sf_dir) -> DataFrame:
    """F1 as a CSV file with texts that mean missing, infinite or nothing at all in ``volt``, read by the reader (#1)."""
    path = scratch_path(spark, "observations")
    order = F.substring_index(F.col(S.KEY), "-", 1).cast("long")
    volt = (F.when(order % 43 == 0, F.lit("nan")).when(order % 47 == 0, F.lit("inf"))
            .when(order % 49 == 0, F.lit("bad")).otherwise(F.col("volt").cast("string")))
    observations(spark, sf_dir).withColumn("volt", volt).write.option("header", True).csv(path)
    return read_observations(spark, path, fmt="csv", unreadable="unreadable")


def q_scan_observations(spark, sf_dir):
    return _observation_file(spark, sf_dir).drop("unreadable")


def q_unreadable_fields(spark, sf_dir):
    return unreadable_fields(_observation_file(spark, sf_dir))


def q_scan_requests(spark, sf_dir):
    return _request_lines(spark, sf_dir).withColumn("absent_features", F.array_join("absent_features", ","))


def q_select_features(spark, sf_dir):
    return FT.select_features(observations(spark, sf_dir))


def q_feature_kinds(spark, sf_dir):
    return FT.feature_catalog(spark, prepared(spark, sf_dir).prep, shown=None)


def q_feature_options(spark, sf_dir):
    return FT.feature_options(prepared(spark, sf_dir).prep)


def q_coerce_numeric(spark, sf_dir):
    req = _requests(spark, sf_dir)
    num = [f for f in S.FEATURE_ORDER if f not in S.CATEGORICAL_FEATURES]
    out = FT.coerce_numeric(req, num, "error")
    return out.select("request_id", "model", *num, "error")


def q_known_category(spark, sf_dir):
    return FT.known_category(_requests(spark, sf_dir), prepared(spark, sf_dir).prep).select(
        "request_id", "model", "known")


def q_validate_request(spark, sf_dir):
    v = FT.validate_requests(_request_lines(spark, sf_dir), S.FEATURE_ORDER)
    return v.select("request_id", "success", "error")


def q_short_term_rows(spark, sf_dir):
    fl = PP.floor_targets(observations(spark, sf_dir).select(S.KEY, *S.TARGETS))
    return SC.short_term_rows(fl)


def q_sample_predictions(spark, sf_dir):
    test = _split_pred(spark, sf_dir).where(F.col("split") == "test")
    sp = SC.sample_predictions(test)
    return sp.select(S.KEY, "target", "actual", "predicted", r6("abs_error").alias("abs_error"),
                     r6("error_pct").alias("error_pct"), "short_term")


def q_row_mean_ttf(spark, sf_dir):
    return ST.row_mean(observations(spark, sf_dir)).select(S.KEY, "mean_ttf")


def q_equal_width_bins(spark, sf_dir):
    obs = ST.row_mean(observations(spark, sf_dir))
    stats = ST.bin_stats(obs, ["mean_ttf", "age", "error_count"])
    d = ST.equal_width_bin(obs, "mean_ttf", S.TTF_RANGE_LABELS, "ttf_range", stats["mean_ttf"])
    d = ST.equal_width_bin(d, "age", S.AGE_GROUP_LABELS, "age_group", stats["age"])
    d = ST.equal_width_bin(d, "error_count", S.ERROR_LEVEL_LABELS, "error_level", stats["error_count"])
    return d.select(S.KEY, "ttf_range", "age_group", "error_level")


def q_strata_labels(spark, sf_dir):
    return prepared(spark, sf_dir).labelled.select(S.KEY, "stratum")


def q_strata_count(spark, sf_dir):
    return ST.strata_count(prepared(spark, sf_dir).labelled)


def q_strata_sizes(spark, sf_dir):
    return SM.allocation(prepared(spark, sf_dir).labelled, "stratum", SAMPLE)


def q_sample_report(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return SM.sample_report(p.obs, p.sample, p.sample_split)


def q_stratified_sample(spark, sf_dir):
    return prepared(spark, sf_dir).sample.select(S.KEY, "stratum")


def q_train_test_split(spark, sf_dir):
    return prepared(spark, sf_dir).split.select(S.KEY, "model", "split")


def q_missing_report(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return PP.missing_report(p.train, p.prep.numerical)


def q_target_floor_stats(spark, sf_dir):
    return PP.target_floor_stats(prepared(spark, sf_dir).train, S.TARGETS)


def q_scaling_check(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return PP.scaling_check(PP.apply_preprocess(p.train, p.prep), p.prep.features[:5])


def q_impute_fit(spark, sf_dir):
    p = prepared(spark, sf_dir)
    rows = [(c, float(p.prep.medians[c])) for c in p.prep.numerical]
    return spark.createDataFrame(rows, "feature string, median double").select(
        "feature", r6("median").alias("median"))


def q_encode_fit(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return PP.encode_fit(p.train, ["model"])["model"].withColumn("code", F.col("code").cast("long"))


def q_encode_transform(spark, sf_dir):
    p = prepared(spark, sf_dir)
    d = p.split.select(S.KEY, "split", F.col("model").alias("_raw"), "model")
    enc = PP.encode(d, p.prep)
    return enc.select(S.KEY, "split", F.col("_raw").alias("model"), F.col("model").alias("model_code"))


def q_impute_transform(spark, sf_dir):
    p = prepared(spark, sf_dir)
    d = p.split.withColumn("n_missing", PP.missing_count(p.prep.numerical).cast("int"))
    d = PP.impute(d, p.prep)
    return d.select(S.KEY, "split", *p.prep.numerical, "n_missing")


def q_scale_features(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return PP.apply_preprocess(p.split, p.prep).select(S.KEY, "split", *[r6(f).alias(f) for f in p.prep.features])


def q_floor_targets(spark, sf_dir):
    return PP.floor_targets(observations(spark, sf_dir).select(S.KEY, *S.TARGETS))


def q_predictions_long(spark, sf_dir):
    return M.predictions_long(_split_pred(spark, sf_dir), S.TARGETS, S.KEY, "split")


def q_metrics_by_target(spark, sf_dir):
    return _round_metrics(_metrics(spark, sf_dir), M.METRIC_COLUMNS)


def q_short_term_metrics(spark, sf_dir):
    m = M.short_term_metrics(_metrics(spark, sf_dir))
    return _round_metrics(m, m.columns)


def q_overfitting(spark, sf_dir):
    m = M.overfitting(_metrics(spark, sf_dir))
    return _round_metrics(m, m.columns)


def q_metrics_overall(spark, sf_dir):
    m = M.metrics_overall(_metrics(spark, sf_dir))
    return m.select("n_targets", *[r6(c).alias(c) for c in m.columns if c != "n_targets"])


def q_metrics_table(spark, sf_dir):
    m = M.metrics_table(_metrics(spark, sf_dir))
    return m.select("Target", *[(F.col(c) + F.lit(0.0)).alias(c) for c in m.columns if c != "Target"])


def q_efficiency(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return M.efficiency(p.split, p.prep.features, S.TARGETS, S.REFERENCE_PARAMS["n_estimators"])


def q_component_status(spark, sf_dir):
    return SC.component_status(_pred_all(spark, sf_dir))


def q_machine_summary(spark, sf_dir):
    return SC.machine_summary(_pred_all(spark, sf_dir))


def q_recommendation(spark, sf_dir):
    return SC.recommendation(_pred_all(spark, sf_dir))


def q_component_priority(spark, sf_dir):
    return SC.component_priority(_pred_all(spark, sf_dir))


def q_prediction_response(spark, sf_dir):
    """Responses to F2 rows; some rows come with an error, some without predictions."""
    order = F.substring_index(F.col(S.KEY), "-", 1).cast("long")
    d = _pred_all(spark, sf_dir)
    d = d.withColumns({S.pred_col(t): F.when(order % 59 != 0, F.col(S.pred_col(t))) for t in S.TARGETS})
    d = d.withColumn("success", order % 53 != 0).withColumn("error", F.when(~F.col("success"), F.lit("bad volt")))
    r = SC.response(d, success_col="success")
    res = F.col("response")
    back = F.from_json("response_json", r.schema["response"].dataType)
    return r.select(
        S.KEY, res["success"].alias("success"), res["error"].alias("error"),
        F.coalesce(F.size(res["results"]), F.lit(0)).alias("n_results"),
        F.array_join(F.transform(res["results"], lambda x: x["status"]), ",").alias("statuses"),
        *[res["summary"][c].cast("double").alias(c)
          for c in ("min_weeks", "avg_weeks", "critical_components", "total_components")],
        res["recommendation"]["title"].alias("title"), res["recommendation"]["detail"].alias("detail"),
        F.get_json_object("response_json", "$.recommendation.title").alias("json_title"),
        F.get_json_object("response_json", "$.results[3].component").alias("json_component"),
        back.eqNullSafe(res).alias("json_reads_back"))


def q_log_rows(spark, sf_dir):
    return LG.log_rows(_pred_all(spark, sf_dir), O.LOG_TS)


def q_log_scan(spark, sf_dir):
    """One log of a batch job and two streams, read back (#4, #5, #61)."""
    from ..streaming.queries import shared_log
    return shared_log(spark, sf_dir, O.LOG_TS)


def q_log_union(spark, sf_dir):
    d = with_fixed_predictions(prepared(spark, sf_dir).split)
    old = LG.log_rows(d.where(F.col("split") == "train"), O.LOG_TS).drop("max_ttf_weeks")
    new = LG.log_rows(d.where(F.col("split") == "test"), O.LOG_TS)
    return LG.union_log(old, new)


def q_fleet_status_counts(spark, sf_dir):
    return SC.fleet_status_counts(SC.component_status(_pred_all(spark, sf_dir)))


def q_fold_assignment(spark, sf_dir):
    return EX.fold_assignment(observations(spark, sf_dir), 5).select(S.KEY, "fold")


def q_outlier_flags(spark, sf_dir):
    num = [f for f in S.FEATURE_ORDER if f not in S.CATEGORICAL_FEATURES]
    return EX.outlier_flags(observations(spark, sf_dir), num).select(
        S.KEY, *[F.col(f"{c}_outlier").cast("string").alias(f"{c}_outlier") for c in num])


def q_topk_importance(spark, sf_dir):
    """Over the correlation measure, which has an exact definition (the model's is ``feature_importance``)."""
    num = [f for f in S.FEATURE_ORDER if f not in S.CATEGORICAL_FEATURES]
    imp = ML.correlation_importance(PP.floor_targets(observations(spark, sf_dir)), num, S.TARGETS)
    return ML.topk_importance(imp.withColumn("Importance", r6("Importance")))


def q_holdout_table(spark, sf_dir):
    """The holdout columns around F2 predictions."""
    p = prepared(spark, sf_dir)
    d = processed(p).withColumns({S.pred_col(t): F.col(f"{t}_orig") * F.lit(0.9) - F.lit(0.6) for t in S.TARGETS})
    h = holdout_table(d, p.prep.features, S.TARGETS)
    return h.withColumns({c: r6(c) for c in h.columns if c.startswith("scaled_")})


def q_stream_status(spark, sf_dir):
    """The status report on a stream of F2 rows, through the file sink."""
    from ..streaming.queries import stream_status_tables
    return stream_status_tables(spark, sf_dir)


def q_stream_score(spark, sf_dir):
    """The ``stream`` job on arriving JSON requests with a saved model, restarted between two lots (#60)."""
    from ..streaming.queries import stream_responses
    r, res = stream_responses(spark, sf_dir, lambda: trained(spark, sf_dir, "smoke")), F.col("response")
    shown = F.when(F.col("request_id").startswith("md5-"), F.lit("md5")).otherwise(F.col("request_id"))
    return r.select(shown.alias("request_id"), res["success"].alias("success"), res["error"].alias("error"),
                    F.coalesce(F.size(res["results"]), F.lit(0)).alias("n_predictions"))


def q_cross_validation(spark, sf_dir):
    """The folds' metrics of F2 predictions; the model-backed run is ``cross_validate``."""
    from .crossval import fold_metrics
    m = fold_metrics(PP.floor_targets(_pred_all(spark, sf_dir)), k=3)
    return m.select("fold", "Target", "Short_Term_Count", *[
        r6(c).alias(c) for c in M.METRIC_COLUMNS if c not in ("Target", "Short_Term_Count")])


# ----- model-backed queries

def q_score_fleet(spark, sf_dir):
    """Every request with its inputs, verdict and number of predictions (their values: tests/test_model.py)."""
    t = trained(spark, sf_dir, "smoke")
    scored = SC.score(_requests(spark, sf_dir), t.package.prep, t.package.model)
    n = F.lit(0)
    for target in t.package.targets:
        n = n + F.col(S.pred_col(target)).isNotNull().cast("int")
    return scored.select("request_id", *S.FEATURE_ORDER, "success", "error", n.alias("n_predictions"))


def q_fit_predict_test(spark, sf_dir):
    t = trained(spark, sf_dir)
    return t.scored.where(F.col("split") == "test").select(
        S.KEY, *[F.col(S.pred_col(x)) for x in t.package.targets])


def q_feature_importance(spark, sf_dir):
    return trained(spark, sf_dir).importance


def q_fit_facts(spark, sf_dir):
    """What must hold of any good fit: all test rows predicted, with less error than the mean of the test rows."""
    t = trained(spark, sf_dir, "smoke")
    err = F.sqrt(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2)))
    return t.long.where(F.col("split") == "test").groupBy("target").agg(
        F.count(F.lit(1)).alias("test_rows"), F.count("predicted").alias("predicted_rows"),
        (err < F.lit(0.5) * F.stddev_pop("actual")).alias("beats_mean"))


def q_importance_facts(spark, sf_dir):
    """Importances of every target: one for each feature, none negative, together 1."""
    i = F.col("Importance")
    return trained(spark, sf_dir, "smoke").importance.groupBy("Target").agg(
        F.count_distinct("Feature").alias("n_features"), F.count_if(i < 0).alias("n_negative"),
        F.round(F.sum(i), 6).alias("total"))


def q_cross_validation_fit(spark, sf_dir):
    """Folds fitted and evaluated with their models: what doesn't depend on the trees, and a bound on the error."""
    from .crossval import cross_validate
    m = cross_validate(prepared(spark, sf_dir), k=2, profile="smoke")
    return m.select("fold", "Target", "Short_Term_Count", (F.col("Test_R2") > 0.5).alias("fits"))


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_") and callable(fn)
}

#: No SQL can fit the trees: rows-only check, values in tests/test_model.py.
NO_ORACLE = {"fit_predict_test", "feature_importance"}


def oracle_sql() -> dict[str, str]:
    sql = O.queries()
    return {k: sql[k] for k in QUERIES if k in sql and k not in NO_ORACLE}
