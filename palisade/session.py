"""Session helpers: shared working folders and sizes that follow the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder, seen by every executor, for tables an operator writes.

    The place is the session's ``spark.checkpoint.dir``; only where that is
    unset (single-machine sessions, as in tests) a temporary folder is taken
    and put into the setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="palisade-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once a session: functions of it are pickled by name, and workers start elsewhere."""
    context = spark.sparkContext
    if getattr(context, "_palisade_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="palisade-code-"), "palisade.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), os.path.dirname(root)))
    context.addPyFile(path)
    context._palisade_shipped = True


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes df into the shared folder and reads it again: lineage ends here and survives lost executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for work that takes long for each row; a scan that already has them is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
