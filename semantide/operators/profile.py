"""Corpus profiles: histograms, percentiles, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semantide.functions.text import LOC_BOUNDS, LOC_LABELS, loc_bin
from semantide.operators.ranges import positions


def bin_table(spark) -> DataFrame:
    """The size classes in order: ``ordinal``, ``bin``, ``upper``."""
    return spark.createDataFrame([(i, label, LOC_BOUNDS[i] if i < len(LOC_BOUNDS) else None) for i, label in enumerate(LOC_LABELS)], "ordinal int, bin string, upper int")


def histogram(df: DataFrame, column: str) -> DataFrame:
    """``ordinal``, ``bin``, ``n``, ``pct`` for every size class, also empty ones; null values are left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(loc_bin(F.col(column)).alias("bin")).agg(F.count("*").alias("n"))
    rows = bin_table(df.sparkSession).select("ordinal", "bin").join(counts, "bin", "left").select("ordinal", "bin", F.coalesce("n", F.lit(0)).alias("n"))
    # One row a class: the window holds seven rows.
    total = F.sum("n").over(Window.partitionBy())
    return rows.withColumn("pct", F.coalesce(F.try_divide(F.col("n") * 100.0, total), F.lit(0.0)))


def _linear(p: float, column: str) -> Column:
    """Value at ``(n - 1) p`` in order, between neighbours by proportion, as an aggregate over ``positions``."""
    at = (F.col("_n") - 1) * F.lit(p)
    low = F.max(F.when((F.col("_from") <= F.floor(at)) & (F.floor(at) < F.col("_to")), F.col(column)))
    high = F.max(F.when((F.col("_from") <= F.ceil(at)) & (F.ceil(at) < F.col("_to")), F.col(column)))
    part = F.max(at - F.floor(at))
    return low + (high - low) * part


def _with_all_groups(df: DataFrame, keys: list[str], found: DataFrame) -> DataFrame:
    """``found`` with a row of nulls for the groups of ``df`` that have no value."""
    groups = df.select(*keys).distinct()
    if not keys:
        return found
    test = None
    for k in keys:
        same = groups[k].eqNullSafe(found[k])
        test = same if test is None else test & same
    return groups.join(found, test, "left").select(*[groups[k] for k in keys], *[found[c] for c in found.columns if c not in keys])


def percentiles_linear(df: DataFrame, keys: list[str], column: str, points: dict[str, float]) -> DataFrame:
    """Percentiles with linear interpolation, exact; null for groups without a value.

    Positions come from value counts in ranges (``ranges.positions``), so no task holds the values of a group.
    """
    rows = df.select(*keys, F.col(column).cast("double").alias(column))
    found = positions(rows, keys, column).groupBy(*keys).agg(*[_linear(p, column).alias(name) for name, p in points.items()])
    return _with_all_groups(df, keys, found)


def percentiles_nearest(df: DataFrame, keys: list[str], column: str, points: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank: the value at half-even ``round((n - 1) p)`` in order.

    Ranks come from value counts in ranges, so a group is never gathered in one task.
    """

    def at(p: float):
        rank = F.bround((F.col("_n") - 1) * F.lit(p), 0)
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col(column)))

    return positions(df, keys, column).groupBy(*keys).agg(*[at(p).alias(name) for name, p in points.items()])


def describe(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Count, mean, both standard deviations, extremes and exact quartiles of a column."""
    x = F.col(column).cast("double")
    base = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.stddev_pop(x).alias("std_pop"), F.min(x).alias("min"), F.max(x).alias("max")
    )
    rows = df.select(*keys, x.alias(column))
    found = positions(rows, keys, column).groupBy(*keys).agg(*[_linear(p, column).alias(q) for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    test = F.lit(True)
    for k in keys:
        test = test & base[k].eqNullSafe(found[k])
    both = base.join(found, test, "left")
    return both.select(*[base[k] for k in keys], "n", "mean", "std", "std_pop", "min", "q1", "median", "q3", "max")


def rounded_summary(df: DataFrame, column: str) -> DataFrame:
    """Average, least and greatest value, half-even to integers; 0 for no rows."""
    x = F.col(column)
    return df.agg(*[F.coalesce(F.bround(f(x).cast("double"), 0).cast("bigint"), F.lit(0).cast("bigint")).alias(n) for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows by value, null included."""
    return df.groupBy(column).agg(F.count("*").alias("n"))
