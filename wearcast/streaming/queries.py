"""Stream scoring over the driver tables: ``lineitem`` arrives as a file
stream, is joined with the static ``part`` table and reported on; JSON requests
arrive in a folder and are scored with a saved package; log records of several
writers share one log."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..jobs import stream_job
from ..operators.log import append_log, log_rows, read_log
from ..operators.scoring import component_status
from ..plans.training import Trained
from ..session import scratch_path, shuffles_dropped
from ..sources.observations import fixture_observations, fixture_request_lines, with_fixed_predictions
from ..sources.package import save_package
from .scoring import read_responses, start_log


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A file stream of one driver table (a folder, or one file in ``sf_dir``)."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).format("parquet")
    if "://" not in path and os.path.isfile(path):
        return reader.option("pathGlobFilter", f"{name}.parquet").load(sf_dir)
    return reader.load(path)


def stream_status_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a file stream -> observations -> F2 predictions -> the status report, through a
    checkpointed parquet sink in the shared folder."""
    li = table_stream(spark, sf_dir, "lineitem")
    status = component_status(with_fixed_predictions(fixture_observations(spark, sf_dir, lineitem=li)))
    out, ckpt = scratch_path(spark, "stream-status"), scratch_path(spark, "stream-ckpt")
    q = (status.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.parquet(out)


#: Lines of a request file: a compressed file is read by one task.
LINES_A_FILE = 250_000


def stream_responses(spark: SparkSession, sf_dir: str, train: Callable[[], Trained]) -> DataFrame:
    """Responses of the ``stream`` job: the trained package is saved, JSON requests arrive in a folder in two lots, and
    the job runs once after each (a restart from its checkpoint), one micro-batch a run.

    The disk holds what is still needed: the split rows go with the training, shuffle files with the step that made
    them, request files (compressed) when the job has committed their lot and begins the next."""
    package, arriving, out, ckpt = (scratch_path(spark, n) for n in ("package", "arriving", "responses", "stream-ckpt"))
    with shuffles_dropped(spark):
        t = train()
        save_package(t.package, package)
        t.prepared.drop_split()
        obs = fixture_observations(spark, sf_dir)
        for lot in (0, 1):  # told apart by key: a lot makes only its own lines
            lines = fixture_request_lines(obs.where(F.crc32(S.KEY) % 2 == lot))
            lines.write.mode("append").options(compression="gzip", maxRecordsPerFile=LINES_A_FILE).text(arriving)
            stream_job(spark, package, arriving, out, ckpt, delete_read=True)
    return read_responses(spark, out)


def shared_log(spark: SparkSession, sf_dir: str, timestamp: str) -> DataFrame:
    """One log of a batch job, a stream, and a stream on a new checkpoint whose batch numbers start again; each writes
    a third of the F2 records."""
    rows = with_fixed_predictions(fixture_observations(spark, sf_dir))
    third, log = F.crc32(S.KEY) % 3, scratch_path(spark, "prediction-log")
    lot = F.floor(F.crc32(S.KEY) / 3) % 2
    append_log(log_rows(rows.where(third == 0), timestamp), log)
    for part in (1, 2):
        src = scratch_path(spark, "scored")
        # Each task writes its rows where they are, to a file a lot; half of the files make a micro-batch.
        rows.where(third == part).withColumn("lot", lot).write.partitionBy("lot").parquet(src)
        files = len(spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(src).inputFiles())
        stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).option(
            "maxFilesPerTrigger", max(1, files // 2)).parquet(src)
        start_log(stream, log, scratch_path(spark, "log-ckpt"), timestamp).awaitTermination()
    return read_log(spark, log)
