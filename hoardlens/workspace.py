"""Shared storage for intermediate tables, and the sessions used by tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}  # of local sessions without the setting, by application


def local_session(cpus: int | str = 8, app: str = "hoardlens") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from the session.

    Only a local-mode session without the setting gets a temporary folder of its own.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        application = spark.sparkContext.applicationId
        if application not in _local_folders:
            _local_folders[application] = tempfile.mkdtemp(prefix="hoardlens-")
        base = _local_folders[application]
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{_work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _work_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/hoardlens/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; their DataFrames cannot be read any more."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    folder = spark._jvm.org.apache.hadoop.fs.Path(_work_folder(spark))
    folder.getFileSystem(conf).delete(folder, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, survives lost executors, computes the input once
    and gives the planner real sizes.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
