"""Accuracy of recorded answers, by model and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semantide.functions.verdict import CATEGORIES, category_name


def latest_rows(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the last by ``order``. Rows that were delivered twice collapse."""
    payload = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in log.columns if c not in order])
    orderable = [c for c in order]
    best = log.groupBy(key).agg(F.max_by(payload, F.struct(*orderable)).alias("row"))
    return best.select(*[F.col(f"row.{c}").alias(c) for c in log.columns])


def accuracy(log: DataFrame, keys: list[str], outcome: str = "first_response_correct") -> DataFrame:
    """``keys``, ``n``, ``n_correct``, ``n_null``, ``n_programs``, ``accuracy``.

    Rows without verdict and error rows stay in the denominator.
    """
    right = F.col(outcome).eqNullSafe(True)
    return log.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(right).alias("n_correct"),
        F.count_if(F.col(outcome).isNull()).alias("n_null"),
        F.countDistinct("program").alias("n_programs"),
        (F.count_if(right) / F.count("*")).alias("accuracy"),
    )


def geo_mean(values: Column) -> Column:
    """Aggregate: geometric mean of the values present; null for none, 0 if one is 0."""
    logs = F.exp(F.avg(F.when(values > 0, F.ln(values))))
    return F.when(F.count(values) == 0, F.lit(None).cast("double")).when(F.min(values) <= 0, F.lit(0.0)).otherwise(logs)


def accuracy_matrix(log: DataFrame, categories: tuple[str, ...] = CATEGORIES, outcome: str = "first_response_correct") -> DataFrame:
    """A row for each model: accuracy by category and their geometric mean; null where a model has no rows."""
    named = log.withColumn("category", category_name(F.col("category")))
    cells = accuracy(named, ["model", "category"], outcome)
    wide = cells.groupBy("model").agg(
        *[F.max(F.when(F.col("category") == c, F.col("accuracy"))).alias(c) for c in categories],
        geo_mean(F.when(F.col("category").isin(*categories), F.col("accuracy"))).alias("geo_mean"),
        F.sum("n").alias("n"),
    )
    return wide


def complete_programs(log: DataFrame, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """``program``: programs with rows in every category (division)."""
    named = log.select("program", category_name(F.col("category")).alias("category")).where(F.col("category").isin(*categories))
    return named.distinct().groupBy("program").agg(F.count("*").alias("k")).where(F.col("k") == len(categories)).select("program")


def token_usage(log: DataFrame, keys: list[str], usage: str = "_usage_list") -> DataFrame:
    """Sums of tokens; fresh input is clamped at zero within each row before it is summed."""
    def total(name: str) -> Column:
        return F.aggregate(F.coalesce(F.col(usage), F.array()), F.lit(0).cast("bigint"), lambda a, u: a + F.coalesce(u[name], F.lit(0).cast("bigint")))

    fresh = F.greatest(total("input") - total("cached_input"), F.lit(0).cast("bigint"))
    return log.groupBy(*keys).agg(
        F.sum(fresh).alias("fresh_input"), F.sum(total("cached_input")).alias("cached_input"), F.sum(total("output")).alias("output"), F.sum(total("reasoning")).alias("reasoning"), F.count("*").alias("calls")
    )


def with_default(rows: DataFrame, lookup: DataFrame, key: str, default: object, order: str | None = None) -> DataFrame:
    """Left lookup; rows without a match take the row of key ``default``.

    ``lookup`` has one row a key; where it has more, the last by ``order`` (a column of it, not taken over) counts.
    """
    if order is not None:
        rest = [c for c in lookup.columns if c not in (key, order)]
        last = lookup.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_last"))
        lookup = last.select(key, *[F.col(f"_last.{c}").alias(c) for c in rest])
    known = lookup.select(F.col(key).alias("_known"))
    matched = rows.join(known, F.col(key) == F.col("_known"), "left").withColumn("_use", F.coalesce("_known", F.lit(default))).drop("_known")
    return matched.join(lookup.withColumnRenamed(key, "_of"), F.col("_use") == F.col("_of"), "left").drop("_use", "_of")


def required_join(left: DataFrame, right: DataFrame, keys: list[str], required: list[str]) -> DataFrame:
    """Left join that raises where a row of ``left`` finds nothing, or a null, in a ``required`` column of ``right``."""
    joined = left.join(right, keys, "left")
    key = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    # The test is part of every column of the left side, too, so that a plan that leaves the required ones out still makes it.
    checked = {}
    for c in [*left.columns, *required]:
        value = F.col(c)
        for r in required:
            value = F.when(F.col(r).isNull(), F.raise_error(F.concat(F.lit(f"no {r} for "), key))).otherwise(value)
        checked[c] = value
    return joined.withColumns(checked)


def in_order(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``df`` with ``ordinal``, for the names of a list and in its order; raises for a name that ``df`` lacks. Meant for lists of a row a model."""
    order = df.sparkSession.createDataFrame(list(enumerate(names)), f"ordinal int, {key} {dict(df.dtypes)[key]}")
    return required_join(order, df.withColumn("_there", F.lit(True)), [key], ["_there"]).drop("_there").orderBy("ordinal")


def through_names(results: DataFrame, names: DataFrame, final: DataFrame, x: str, y: str) -> DataFrame:
    """``model``, ``final_model``, ``x``, ``y``: results beside a final table whose models have other names; pairs with a null are left out.

    ``names`` has ``model`` and ``final_model``, one row a model.
    """
    both = results.select("model", F.col(x).alias("x")).join(names, "model").join(final.select(F.col("model").alias("final_model"), F.col(y).alias("y")), "final_model")
    return both.where("x IS NOT NULL AND y IS NOT NULL").select("model", "final_model", "x", "y")
