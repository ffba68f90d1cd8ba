"""Stream scoring equals batch scoring; a restart adds no duplicates."""

from wearcast import schema as S
from wearcast.operators.log import append_log, log_rows, read_log
from wearcast.operators.scoring import score
from wearcast.session import scratch_path
from wearcast.sources import committed
from wearcast.sources.observations import fixture_observations, fixture_requests
from wearcast.streaming.scoring import start_log, stream_score

from conftest import SF001

TS = "2024-01-20 10:30:00"


def test_stream_equals_batch_and_restart_is_idempotent(spark, trained_small):
    pkg = trained_small.package
    req = fixture_requests(fixture_observations(spark, SF001))
    src = scratch_path(spark, "req-src")
    req.write.parquet(src)
    out, ckpt = scratch_path(spark, "log"), scratch_path(spark, "ckpt")

    def run():
        stream = spark.readStream.schema(req.schema).parquet(src)
        start_log(stream_score(stream, pkg), out, ckpt, TS).awaitTermination()

    run()
    logged = read_log(spark, out)
    batch = score(req, pkg.prep, pkg.model).where("success")
    n = logged.count()
    assert n == batch.count() > 0
    for t in S.TARGETS:
        a = sorted(r[0] for r in batch.select(S.pred_col(t)).collect())
        b = sorted(r[0] for r in logged.select(S.exact_col(t)).collect())
        assert a == b
    run()  # restart from the checkpoint, no new input files
    assert read_log(spark, out).count() == n


def test_json_request_stream_matches_batch(spark, trained_small, tmp_path):
    import json

    from wearcast.sources.requests import read_request_stream, read_requests

    pkg = trained_small.package
    ex = pkg.example_request()
    rows = [dict(ex, request_id=1), dict(ex, request_id=2, volt="oops"),
            {k: v for k, v in dict(ex, request_id=3, pressure=None).items() if k != "rotate"},
            dict(ex, request_id=4, model="never-seen", age="NaN")]
    src = tmp_path / "in"
    src.mkdir()
    (src / "part-0.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    batch = {r["request_id"]: r for r in score(read_requests(spark, str(src)), pkg.prep, pkg.model)
             .collect()}
    scored = stream_score(read_request_stream(spark, str(src)), pkg)
    q = (scored.writeStream.format("memory").queryName("scored_requests")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["request_id"]: r for r in spark.table("scored_requests").collect()}
    assert got.keys() == batch.keys() == {"1", "2", "3", "4"}
    assert [got[i]["success"] for i in "1234"] == [True, False, False, True]
    p = S.pred_col(S.TARGETS[0])
    assert got["1"][p] == batch["1"][p] and got["4"][p] == batch["4"][p]


def test_batch_stream_and_new_checkpoint_share_one_log(spark, trained_small, monkeypatch):
    """Every record is read back once, whoever wrote it and whatever was run twice or cut off."""
    from wearcast.jobs import score_job, stream_job
    from wearcast.sources.observations import fixture_request_lines
    from wearcast.sources.package import save_package
    from wearcast.streaming.scoring import read_responses

    pkg_path, log, out = (scratch_path(spark, n) for n in ("pkg", "log", "out"))
    save_package(trained_small.package, pkg_path)
    lines = fixture_request_lines(fixture_observations(spark, SF001).limit(300)).repartition(6)
    src, late = scratch_path(spark, "in"), scratch_path(spark, "late")
    lines.write.text(src)
    lines.limit(40).coalesce(1).write.text(late)
    from wearcast.sources.requests import read_requests

    ok = score(read_requests(spark, src), trained_small.package.prep, trained_small.package.model).where("success").count()
    score_job(spark, pkg_path, src, scratch_path(spark, "r"), log, TS, run_id="monday")
    score_job(spark, pkg_path, src, scratch_path(spark, "r"), log, TS, run_id="monday")  # submitted again
    assert read_log(spark, log).count() == ok
    stream_job(spark, pkg_path, src, out, scratch_path(spark, "c1"), log, TS, files_per_batch=2)
    assert read_log(spark, log).count() == 2 * ok and read_responses(spark, out).count() == 300
    stream_job(spark, pkg_path, src, out, scratch_path(spark, "c2"), log, TS)  # a new checkpoint: batch 0 again
    back = read_log(spark, log)
    assert back.count() == 3 * ok and read_responses(spark, out).count() == 600
    assert "attempt" not in back.columns and committed.commits(spark, log).count() == 1 + 3 + 1

    # A micro-batch cut off between its two commits: the run after it writes only what is missing.
    ckpt, real = scratch_path(spark, "c3"), committed._commit
    def cut(session, path, *rest):
        if path == log:
            raise RuntimeError("executor lost")
        real(session, path, *rest)
    monkeypatch.setattr(committed, "_commit", cut)
    try:
        stream_job(spark, pkg_path, late, out, ckpt, log, TS)
    except Exception as e:
        assert "executor lost" in str(e)
    monkeypatch.setattr(committed, "_commit", real)
    assert read_log(spark, log).count() == 3 * ok and read_responses(spark, out).count() == 640
    stream_job(spark, pkg_path, late, out, ckpt, log, TS)
    more = read_log(spark, log).count() - 3 * ok
    assert 0 < more <= 40 and read_responses(spark, out).count() == 640
    stream_job(spark, pkg_path, late, out, ckpt, log, TS)
    assert read_log(spark, log).count() == 3 * ok + more


def test_committed_tables(spark):
    import pytest

    path = scratch_path(spark, "table")
    with pytest.raises(FileNotFoundError):
        committed.read(spark, path)
    a, b = spark.range(3).selectExpr("id AS x"), spark.range(5).selectExpr("id AS x", "'n' AS y")
    assert committed.append(a, path, "w", 0) and not committed.append(a, path, "w", 0)
    assert committed.append(b, path, "w", 1) and committed.append(b, path)
    a.write.parquet(f"{path}/records/attempt=a-cutoff")  # never committed
    got = committed.read(spark, path)
    assert sorted(got.columns) == ["x", "y"] and got.count() == 13 and got.where("y IS NULL").count() == 3
    # Two attempts of one batch that both came through: one counts.
    for name in ("attempt=a-one", "attempt=a-two"):
        a.write.parquet(f"{path}/records/{name}")
        committed._commit(spark, path, name, "v", 7)
    assert committed.read(spark, path).count() == 16
    rows = log_rows(spark.createDataFrame([(1.5, 2.5, 3.5, 4.5)], ", ".join(f"{S.pred_col(t)} double" for t in S.TARGETS)), TS)
    log = scratch_path(spark, "csv-log")
    assert append_log(rows, log, "csv") and append_log(rows, log, "csv")
    assert read_log(spark, log, "csv").count() == 2


def test_the_shared_log_is_written_by_as_many_tasks_as_read_it(spark, tmp_path, monkeypatch):
    """A stream's rows stay where they are read, and still arrive in two micro-batches."""
    from wearcast.streaming import queries as SQ

    spark.read.parquet(f"{SF001}/lineitem.parquet").repartition(12).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{SF001}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    made, real = [], SQ.scratch_path
    monkeypatch.setattr(SQ, "scratch_path", lambda s, n: made.append(real(s, n)) or made[-1])
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")  # a task a file
    try:
        n = SQ.shared_log(spark, str(tmp_path), "2024-01-20 10:30:00").count()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert n == spark.read.parquet(f"{SF001}/lineitem.parquet").count()
    for src in (p for p in made if "/scored-" in p):
        assert len(spark.read.parquet(src).inputFiles()) > 12
    log = next(p for p in made if "/prediction-log-" in p)
    assert spark.read.parquet(f"{log}/commits").count() == 1 + 2 * 2


def test_stream_score_keeps_on_disk_only_what_it_still_needs(spark, monkeypatch):
    """No scored training rows; the split and bin numbers go with the training, the first lot's (compressed) request
    files when the second lot is scored."""
    import os

    from pyspark.sql import functions as F

    from wearcast import session
    from wearcast.plans.queries import QUERIES
    from wearcast.streaming import queries as SQ

    made, real = [], session.scratch_path
    for module in (session, SQ):
        monkeypatch.setattr(module, "scratch_path", lambda s, n: made.append(real(s, n)) or made[-1])
    before = spark.conf.get(session.CLEANUP, None)
    obs = fixture_observations(spark, SF001)
    assert QUERIES["stream_score"](spark, SF001).count() == obs.count()
    assert spark.conf.get(session.CLEANUP, None) == before
    at = lambda name: [p.removeprefix("file:") for p in made if f"/{name}-" in p]
    assert not at("scored") and at("split") and at("binned")
    assert not any(os.path.exists(p) for p in at("split") + at("binned"))
    arriving = at("arriving")[0]
    files = [f for f in os.listdir(arriving) if f.startswith("part-")]
    assert files and all(f.endswith(".gz") for f in files)
    assert spark.read.text(arriving).count() == obs.where(F.crc32(S.KEY) % 2 == 1).count()


def test_shuffle_files_go_with_their_execution(spark, tmp_path):
    """Inside ``shuffles_dropped`` an execution leaves no shuffle files on the disks."""
    import glob
    import os
    import time

    from wearcast.session import shuffles_dropped

    def left(d, name):
        files = lambda: set(glob.glob("/".join([*local.split("/"), "**", "shuffle_*.data"]), recursive=True))
        was = files()
        d.write.parquet(str(tmp_path / name))
        return files() - was

    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    rows = spark.range(20_000).repartition(3, "id")
    assert left(rows, "kept")
    with shuffles_dropped(spark):
        new, wait = left(rows, "dropped"), time.time() + 20
        while any(map(os.path.exists, new)) and time.time() < wait:  # they go in the background
            time.sleep(0.2)
        assert not any(map(os.path.exists, new))
