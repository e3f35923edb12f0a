"""Ranks and row numbers of groups that may hold a large part of all rows.

Rows are range-partitioned by key and order, written with the number of their partition, and numbered within it; what stands before
a partition is added from a table of one row for each key and partition. So no task sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semantide.sources.shared import materialise


def _parted(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return materialise(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()), "ranges")


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    test = a["_part"] == b["_part"]
    for k in keys:
        test = test & a[k].eqNullSafe(b[k])
    return test


def row_numbers(df: DataFrame, keys: list[str], order: list[str], name: str = "number") -> DataFrame:
    """``df`` with ``name``: the row number within ``keys`` by ``order``, nulls first; equal rows in any order."""
    rows = _parted(df, keys, list(order))
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("_before", before).drop("_size")
    numbered = rows.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    joined = numbered.join(offsets, _same(numbered, offsets, keys))
    return joined.select(*[numbered[c] for c in df.columns], (F.col("_local") + F.col("_before")).alias(name))


def positions(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``keys``, ``column``, ``_from``, ``_to``, ``_n``: for each value of a group the positions it takes in order, from 0, and the size of the group.

    Values are counted first, so only different ones are sorted. Nulls are left out.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_k"))
    rows = _parted(counts, keys, [F.col(column)])
    sizes = rows.groupBy(*keys, "_part").agg(F.sum("_k").alias("_size"))
    every = Window.partitionBy(*keys)
    offsets = sizes.withColumn("_before", F.sum("_size").over(every.orderBy("_part")) - F.col("_size")).withColumn("_n", F.sum("_size").over(every)).drop("_size")
    local = F.sum("_k").over(Window.partitionBy(*keys, "_part").orderBy(column))
    numbered = rows.withColumn("_upto", local)
    joined = numbered.join(offsets, _same(numbered, offsets, keys))
    to = F.col("_upto") + F.col("_before")
    return joined.select(*[numbered[c] for c in (*keys, column)], (to - F.col("_k")).alias("_from"), to.alias("_to"), "_n")
