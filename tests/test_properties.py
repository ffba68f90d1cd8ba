
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import wearcast.operators.sampling as SM
from wearcast.operators.preprocess import apply_preprocess, fit_preprocess
from wearcast.operators.strata import strata_labels
from wearcast.sources.observations import fixture_observations

from conftest import SF001


@pytest.fixture(scope="module")
def labelled(spark):
    return strata_labels(fixture_observations(spark, SF001)).cache()


@pytest.mark.parametrize("n", [1, 37, 1500, 5999])
def test_sample_size_exact_and_proportional(labelled, n):
    s = SM.stratified_sample(labelled, "stratum", n)
    assert s.count() == n
    alloc = {r["stratum"]: (r["n"], r["take"]) for r in
             SM.allocation(labelled, "stratum", SM.Draw("count", n)).collect()}
    tot = sum(a for a, _ in alloc.values())
    for size, take in alloc.values():
        assert abs(take - size * n / tot) < 1
    got = {r["stratum"]: r["count"] for r in s.groupBy("stratum").count().collect()}
    assert all(got.get(k, 0) == take for k, (_, take) in alloc.items())


def _window_sample(labelled, n):
    """The definition, written plainly: first ``take`` rows per stratum in
    ``md5('42-' || key), key`` order, by one window over every row."""
    from pyspark.sql import Window
    alloc = SM.allocation(labelled, "stratum", SM.Draw("count", n))
    d = labelled.join(alloc.select("stratum", "take"), "stratum")
    rn = F.row_number().over(Window.partitionBy("stratum").orderBy(
        F.md5(F.concat(F.lit("42-"), F.col("obs_id").cast("string"))), "obs_id"))
    return sorted(r[0] for r in d.withColumn("rn", rn).where(F.col("rn") <= F.col("take"))
                  .select("obs_id").collect())


@pytest.mark.parametrize("digits", [1, 3])
def test_sample_equals_window_ranking(labelled, monkeypatch, digits):
    monkeypatch.setattr(SM, "CELL_DIGITS", digits)
    got = sorted(r[0] for r in SM.stratified_sample(labelled, "stratum", 900).select("obs_id").collect())
    assert got == _window_sample(labelled, 900)


def test_sample_independent_of_partitioning(labelled):
    a = sorted(r[0] for r in SM.stratified_sample(labelled, "stratum", 777).select("obs_id").collect())
    b = sorted(r[0] for r in SM.stratified_sample(labelled.repartition(13), "stratum", 777)
               .select("obs_id").collect())
    assert a == b


def test_split_disjoint_complete_and_sized(labelled):
    sp = SM.stratified_split(labelled, "model")
    n = labelled.count()
    c = {r["split"]: r["count"] for r in sp.groupBy("split").count().collect()}
    assert c["train"] + c["test"] == n
    assert c["test"] == -(-n * 2 // 10)  # ceil(0.2 n)
    assert sp.select("obs_id").distinct().count() == labelled.select("obs_id").distinct().count()


def test_scaled_train_has_zero_mean_unit_std(spark, labelled):
    sp = SM.stratified_split(labelled.select("obs_id", "model", "volt", "pressure", "age"), "model")
    train = sp.where(F.col("split") == "train")
    prep = fit_preprocess(train)
    row = apply_preprocess(train, prep).agg(
        *[F.avg(c).alias(f"m{c}") for c in prep.features],
        *[F.stddev_pop(c).alias(f"s{c}") for c in prep.features]).first()
    for c in prep.features:
        assert abs(row[f"m{c}"]) < 1e-9 and abs(row[f"s{c}"] - 1) < 1e-9


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=8), st.integers(1, 200))
def test_allocation_sums_to_draws(spark, sizes, n):
    rows = [(k * 1000 + i, f"s{k}") for k, size in enumerate(sizes) for i in range(size)]
    df = spark.createDataFrame(rows, "obs_id long, stratum string")
    alloc = SM.allocation(df, "stratum", SM.Draw("count", n)).collect()
    tot = sum(sizes)
    assert sum(r["take"] for r in alloc) == min(n, tot)
    assert all(0 <= r["take"] <= r["n"] for r in alloc)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=5), st.integers(1, 150),
       st.integers(0, 2 ** 31))
def test_draw_on_skewed_strata_equals_window_ranking(spark, small, n, salt):
    """A hot stratum (at least a third of the rows) and a NULL stratum."""
    from pyspark.sql import Window
    hot = 2 * sum(small) + 1
    sizes = [("hot", hot)] + [(f"s{i}", k) for i, k in enumerate(small)] + [(None, 3)]
    rows, key = [], salt % 100_000
    for s, k in sizes:
        for _ in range(k):
            key += 1
            rows.append((key, s))
    df = spark.createDataFrame(rows, "obs_id long, stratum string")
    got = sorted(r[0] for r in SM.stratified_sample(df, "stratum", n).select("obs_id").collect())
    alloc = SM.allocation(df, "stratum", SM.Draw("count", n))
    d = df.join(alloc.select("stratum", "take"), df["stratum"].eqNullSafe(alloc["stratum"])).select(
        "obs_id", df["stratum"], "take")
    rn = F.row_number().over(Window.partitionBy("stratum").orderBy(
        F.md5(F.concat(F.lit("42-"), F.col("obs_id").cast("string"))), "obs_id"))
    want = sorted(r[0] for r in d.withColumn("rn", rn).where(F.col("rn") <= F.col("take"))
                  .select("obs_id").collect())
    assert got == want and len(got) == min(n, len(rows))


def test_the_drawn_rows_are_marked_without_a_join_by_key(spark):
    from pyspark.sql import functions as F

    from wearcast.operators.sampling import stratified_sample, with_drawn

    d = spark.range(2_000).selectExpr("cast(id AS string) AS obs_id", "if(id % 5 = 0, null, concat('m', id % 3)) AS model",
                                      "if(id % 4 = 0, 'test', 'train') AS split")
    among = F.col("split") == "train"
    marked = with_drawn(d, among, "model", 300)
    got = {r[0] for r in marked.where("drawn").select("obs_id").collect()}
    assert got == {r[0] for r in stratified_sample(d.where(among), "model", 300).select("obs_id").collect()} and len(got) == 300
    assert marked.count() == 2_000 and marked.where("drawn IS NULL").count() == 0
    assert "obs_id = " not in marked._jdf.queryExecution().optimizedPlan().toString()
