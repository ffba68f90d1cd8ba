"""Sinks, package metadata, tuning and retraining."""

import os

from pyspark.sql import functions as F

from wearcast import schema as S
from wearcast.operators.log import append_log, log_rows, read_log, union_log
from wearcast.operators import model as ML
from wearcast.operators.model import parameter_table
from wearcast.plans.training import holdout
from wearcast.plans.tuning import param_grid, retrain, tune
from wearcast.session import scratch_path
from wearcast.sources.observations import fixture_observations, with_fixed_predictions
from wearcast.sources.package import export_csv, write_holdout

from conftest import SF001


def test_package_info_and_example(trained_small):
    pkg = trained_small.package
    info = pkg.info()
    assert info["features"] == S.FEATURE_ORDER and info["total_features"] == 11
    assert info["excluded_features"] == S.EXCLUDED and info["targets"] == S.TARGETS
    ex = pkg.example_request()
    assert ex["model"] == "model1" and ex["volt"] == 168.5 and ex["days_since_comp3_maint"] == 22


def test_parameter_table(spark):
    rows = {r["name"]: r["value"] for r in parameter_table(spark).collect()}
    assert rows["n_estimators"] == "500" and rows["learning_rate"] == "0.05" and len(rows) == 15


def test_holdout_and_csv_export(spark, trained_small):
    h = holdout(trained_small)
    path = scratch_path(spark, "holdout")
    write_holdout(h, path)
    back = spark.read.parquet(path)
    assert back.count() == h.count() == trained_small.scored.where(F.col("split") == "test").count()
    assert {"orig_volt", "proc_volt", "scaled_volt", "ttf_comp1_weeks_orig", "ttf_comp1_weeks_floor",
            "pred_comp1_weeks"} <= set(back.columns)
    csv = scratch_path(spark, "csv")
    export_csv(h.select("obs_id", "pred_comp1_weeks"), csv)
    assert spark.read.option("header", True).csv(csv).count() == back.count()


def test_log_append_creates_then_appends(spark):
    pred = with_fixed_predictions(fixture_observations(spark, SF001))
    path = scratch_path(spark, "log")
    assert not os.path.exists(path)
    rows = log_rows(pred, "2024-01-20 10:30:00")
    append_log(rows.limit(10), path, fmt="csv")
    append_log(rows.limit(5), path, fmt="csv")
    back = read_log(spark, path, fmt="csv")
    assert back.count() == 15 and "critical_components" in back.columns
    u = union_log(back.drop("max_ttf_weeks"), rows.limit(3))
    assert u.count() == 18 and u.where(F.col("max_ttf_weeks").isNull()).count() == 15


def test_tune_picks_a_grid_point(trained_small, monkeypatch):
    import wearcast.plans.crossval as CV

    fits, real = [], CV.fit_preprocess
    monkeypatch.setattr(CV, "fit_preprocess", lambda train: (fits.append(1), real(train))[1])
    grid = param_grid(maxDepth=[2, 4])
    best, table = tune(trained_small.prepared, grid, k=2, profile="smoke")
    assert len(fits) == 2  # once a fold, not once a grid point and fold
    cv = CV.cross_validate(trained_small.prepared, k=2, params=ML.gbt_params("smoke", maxDepth=4))
    mean = cv.agg(F.avg("Test_RMSE")).first()[0]
    assert abs(mean - table.where("grid_point = 1").first()["mean_test_rmse"]) < 1e-9 and cv.count() == 8
    assert best in grid and table.count() == 2
    r = {row["params"]: row["mean_test_rmse"] for row in table.collect()}
    assert best == grid[0 if r[str(sorted(grid[0].items()))] <= r[str(sorted(grid[1].items()))] else 1]


def test_retrain_on_old_and_new(spark):
    obs = fixture_observations(spark, SF001)
    odd = F.substring_index("obs_id", "-", -1).cast("int") % 2 == 1
    old, new = obs.where(~odd), obs.where(odd)
    t = retrain(spark, old, new, profile="smoke")
    assert t.prepared.split.count() == obs.count()


def _csv(spark, tmp_path):
    from wearcast.sources.observations import read_observations

    (tmp_path / "o.csv").write_text("obs_id,model,volt,age,failure_within_48h\n1,m,bad,3,true\n2,m,1.5,7,false\n")
    return read_observations(spark, str(tmp_path / "o.csv"), "csv", unreadable="bad")


def test_a_csv_field_is_matched_once(spark, tmp_path):
    """Two numeric fields: two matches in the plan, however many values and reasons use them."""
    plan = _csv(spark, tmp_path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 2


def test_listing_unreadable_fields_reads_each_field_once(spark, tmp_path):
    """No filter on the list is inferred and pushed down to the reader with all fields in it."""
    from wearcast.sources.observations import unreadable_fields

    d = unreadable_fields(_csv(spark, tmp_path), "bad")
    assert d._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 2
    assert [tuple(r) for r in d.collect()] == [("1", "volt", "bad", "not a number")]


def test_wide_stages_stay_within_what_hotspot_compiles(spark):
    from wearcast.operators.features import coerce_numeric

    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(name, "65535")
    coerce_numeric(spark.createDataFrame([("1",)], "volt string"), ["volt"])
    assert int(spark.conf.get(name)) <= 8000
    spark.conf.set(name, "4000")
    coerce_numeric(spark.createDataFrame([("1",)], "volt string"), ["volt"])
    assert int(spark.conf.get(name)) == 4000  # a smaller limit of the session stays
    spark.conf.unset(name)


def test_a_response_floors_each_prediction_once(spark):
    from wearcast.operators.scoring import response

    d = spark.range(2).selectExpr("cast(id AS string) AS obs_id", *[f"id + 0.5D AS {S.pred_col(t)}" for t in S.TARGETS])
    plan = response(d.cache())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FLOOR(") == len(S.TARGETS)
    d.unpersist()
