"""Session helpers shared by every plan."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only in local mode, where that is unset, a temporary folder
    of this machine is used; elsewhere its tasks could not read it, and a missing setting is an error.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if shared:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(shared)
        return shared
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isEmpty():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    local = os.path.join(tempfile.gettempdir(), f"quern-checkpoints-{os.getpid()}")
    sc.setCheckpointDir(local)
    return local


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the shared folder, so that lost executors cost no recomputation."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table below the shared folder and read from there, where columns and filters are pruned.

    The table is removed when the process ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/quern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the table of ``stored``."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quern-" in path:
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended
        pass


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Scan partitions up to which a scan counts as small.
SMALL_SCAN = 16


def spread(scanned: DataFrame) -> DataFrame:
    """A small scan for work that is heavy per row, spread over the cores.

    Only a scan of at most SMALL_SCAN partitions is shuffled, so at most that many split sizes; any larger one is left as it is.
    """
    cores = scanned.sparkSession.sparkContext.defaultParallelism
    return scanned.repartition(cores) if scanned.rdd.getNumPartitions() < min(cores, SMALL_SCAN + 1) else scanned
