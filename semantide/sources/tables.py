"""The project's tables, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read table ``name`` of folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, *columns: str, spread: int | None = None) -> DataFrame:
    """Columns of a table for work that takes long on each row, in ``spread`` partitions.

    Without ``spread`` a table of fewer files than there are cores is spread over all cores, as a file of one row group
    is one task however it is split; a table of more files keeps the splits of its scan and nothing is moved.
    """
    df = table(spark, sf_dir, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    if spread is None and len(df.inputFiles()) < cores:
        spread = cores
    return df.repartition(spread) if spread else df
