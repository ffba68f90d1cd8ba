"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wearcast")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Uses the folder the cluster names in ``spark.checkpoint.dir`` (or the one
    already set on the context). Only when neither is set, as in tests, a
    fresh local folder is created and registered; on a cluster that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="wearcast-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new unique folder under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex}"


#: HotSpot leaves methods of more bytecode than this to its interpreter.
JIT_LIMIT = 8_000


def jit_sized(spark: SparkSession) -> None:
    """Stages whose generated code is too long for HotSpot to compile run as their operators' own, shorter code
    (Spark's default takes up to 65,535 bytes a method, which are then interpreted for every row)."""
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > JIT_LIMIT:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_LIMIT))


def kept(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet to a new shared folder and read back, and that folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet to a new shared folder and read back: cuts lineage, survives lost executors."""
    return kept(df, name, **options)[0]


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``kept`` made and nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, each execution's shuffle files go when it ends; else they lie on the disks until the driver happens to
    collect its garbage. (Running one DataFrame a second time makes them again.)"""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
