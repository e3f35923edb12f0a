"""Definitions and uses in statement order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_definition(events: DataFrame, keys: list[str], position: str, defines: str, value: str) -> DataFrame:
    """``events`` with ``latest``: the value of the last row before it that defines; null where there is none.

    ``defines`` is a boolean column. Positions are unique within ``keys``; a row doesn't see itself.
    """
    before = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("latest", F.last(F.when(F.col(defines), F.col(value)), ignorenulls=True).over(before))


def live_before(steps: DataFrame, keys: list[str], position: str = "pos", variable: str = "var") -> DataFrame:
    """``keys``, ``pos``, ``var``: variables live before each position.

    ``steps`` has a row for each position and variable that is defined or used there, with ``is_def`` and
    ``is_use``. A variable is live before i if it is used at some j from i on with no definition from i to before j. For
    every variable the stretches are found from its own rows: before a row that uses it, back to the
    last row that defines it.
    """
    w = Window.partitionBy(*keys, variable).orderBy(position)
    rows = steps.groupBy(*keys, position, variable).agg(F.max("is_def").alias("is_def"), F.max("is_use").alias("is_use"))
    # Positions of the whole graph come from a window, so the steps are read once.
    rows = rows.withColumn("_places", F.array_sort(F.collect_set(position).over(Window.partitionBy(*keys))))
    last_def = F.last(F.when(F.col("is_def"), F.col(position)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    last_use = F.last(F.when(F.col("is_use"), F.col(position)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    stretches = rows.select(*keys, variable, "is_use", "_places", F.col(position).alias("_to"), last_def.alias("_def"), last_use.alias("_use")).where("is_use")
    spans = stretches.select(*keys, variable, "_places", (F.greatest(F.coalesce("_def", F.lit(-1)), F.coalesce("_use", F.lit(-1))) + 1).alias("_from"), "_to")
    grid = spans.select(*keys, variable, F.explode(F.filter("_places", lambda p: (p >= F.col("_from")) & (p <= F.col("_to")))).alias(position))
    return grid.distinct().select(*keys, position, variable)


def live_out(variables: DataFrame, returned: DataFrame, keys: list[str], variable: str = "var") -> DataFrame:
    """``keys``, ``var``, ``liveout``: whether a return uses the variable."""
    used = returned.select(*keys, variable).distinct().withColumn("liveout", F.lit(True))
    return variables.select(*keys, variable).distinct().join(used, [*keys, variable], "left").withColumn("liveout", F.coalesce("liveout", F.lit(False)))


def live_out_rows(records: DataFrame, key: str = "program") -> DataFrame:
    """``key``, ``function``, ``var``, ``liveout`` from records with ``steps`` and ``liveness``: all within the row of a program."""
    returned = F.flatten(F.transform(F.filter("steps", lambda s: s["returns"]), lambda s: F.transform(s["uses"], lambda u: F.concat(s["function"], F.lit("\0"), u))))
    rows = records.select(key, F.array_distinct(returned).alias("_back"), F.explode("liveness").alias("f"))
    back = F.array_contains("_back", F.concat("f.function", F.lit("\0"), "f.var"))
    return rows.select(key, "f.function", "f.var", back.alias("liveout"))


def c_live_out(entry_live: DataFrame, returned: DataFrame, decayed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``vars``: names live at the exit of the entry block or returned, less those that stand for functions."""
    names = entry_live.select(*keys, "var").union(returned.select(*keys, "var")).distinct()
    return names.join(decayed.select(*keys, "var"), [*keys, "var"], "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_set("var")).alias("vars"))


def direct_def_use(steps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``var``, ``def_line``, ``use_line``: for each use the last definition before it, each pair once."""
    before = Window.partitionBy(*keys, "var").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    found = steps.withColumn("def_line", F.last(F.when(F.col("is_def"), F.col("line")), ignorenulls=True).over(before))
    return found.where("is_use AND def_line IS NOT NULL").select(*keys, "var", "def_line", F.col("line").alias("use_line")).distinct()


def smallest_missing(universe: DataFrame, present: DataFrame, keys: list[str], element: str) -> DataFrame:
    """``keys``, ``element``: the least element of each group's universe that isn't present (negative sample)."""
    absent = universe.select(*keys, element).join(present.select(*keys, element), [*keys, element], "left_anti")
    return absent.groupBy(*keys).agg(F.min(element).alias(element))
