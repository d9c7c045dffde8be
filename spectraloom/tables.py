"""Sessions, and tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine for tests and benchmarks; on a cluster the session comes from outside."""
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cores}]").appName("spectraloom").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and everything runs in this process.

    RuntimeError without a named folder elsewhere: executors on other machines would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = f"file://{tempfile.mkdtemp(prefix='spectraloom-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the driver ends."""
    path = f"{shared_folder(spark)}/spectraloom-{uuid.uuid4().hex}/{tag}"
    if not _written:
        atexit.register(clean_up)
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage is cut and lost executors cost nothing.

    The shuffle files of the write, which nothing needs once the table is there, are removed at its end.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, tag), spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def chain(df: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Applies steps (tag, function), each result written and read again as the next one's input.

    Once a result is written, what its step wrote on the way and the step's input, if an earlier step made it, are deleted.
    """
    start = len(_written)
    for tag, step in steps:
        df = materialise(step(df), tag)
        _delete(_written[start:-1])
        del _written[start:-1]
    return df


def _delete(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean_up() -> None:
    """Deletes the tables that materialise() has written."""
    while _written:
        try:
            _delete([_written.pop()])
        except Exception:  # noqa: BLE001  the session has ended: the folder goes with the cluster's clean-up
            return
