"""Intermediate tables in the folder all executors share.

A table written here cuts the lineage: an executor that is lost later costs
the tasks it was running, not the stages before.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "semantide-shared")
    os.makedirs(own, exist_ok=True)
    return own


def own_dir(spark: SparkSession) -> str:
    """The folder of this application within the shared one."""
    return f"{shared_dir(spark)}/semantide/{spark.sparkContext.applicationId}"


_at_exit: set[str] = set()


#: Spark's setting under which the shuffle files of a query are deleted as soon as it ends, instead of when the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str, keep_shuffles: bool = True) -> DataFrame:
    """Write ``df`` as a table into the application's folder and read it again; it is deleted when the application ends."""
    spark = df.sparkSession
    folder = own_dir(spark)
    if folder not in _at_exit:
        _at_exit.add(folder)
        atexit.register(_drop_at_exit, spark, folder)
    path = f"{folder}/{uuid.uuid4().hex}-{name}"
    schema = df.schema
    before = spark.conf.get(_CLEAN, None)
    if not keep_shuffles:
        spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if not keep_shuffles:
            spark.conf.set(_CLEAN, before) if before else spark.conf.unset(_CLEAN)
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that no later step reads."""
    for df in tables:
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            if f"/{df.sparkSession.sparkContext.applicationId}/" in folder:
                _delete(df.sparkSession, folder)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; call it once the results are written."""
    _delete(spark, own_dir(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _drop_at_exit(spark: SparkSession, folder: str) -> None:
    try:
        _delete(spark, folder)
    except Exception:  # the context was stopped before; a local folder can still go
        if folder.startswith(tempfile.gettempdir()):
            shutil.rmtree(folder, ignore_errors=True)
