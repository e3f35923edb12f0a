"""Rank and linear statistics as aggregates, with p-values."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(column: str, keys: list[str]) -> Column:
    """Rank with ties at their average, within ``keys``."""
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(column))
    return rank + (F.count("*").over(Window.partitionBy(*keys, column)) - 1) / F.lit(2.0)


def complete_pairs(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``keys``, ``x``, ``y`` of the rows that have both as finite numbers."""
    pairs = df.select(*keys, F.col(x).try_cast("double").alias("x"), F.col(y).try_cast("double").alias("y"))
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("x", "y")]
    return pairs.where(finite[0] & finite[1])


def pearson(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``keys``, ``n``, ``r``, ``p``; null below three pairs and for a constant side."""
    return _with_p(complete_pairs(df, keys, x, y).groupBy(*keys).agg(F.count("*").alias("n"), _corr().alias("r")))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Like ``pearson`` on average ranks. Every group's ranks come from one sort of the group."""
    pairs = complete_pairs(df, keys, x, y)
    ranked = pairs.select(*keys, average_rank("x", keys).alias("x"), average_rank("y", keys).alias("y"))
    return _with_p(ranked.groupBy(*keys).agg(F.count("*").alias("n"), _corr().alias("r")))


def correlation(x: str = "x", y: str = "y") -> Column:
    """Aggregate: Pearson's r; null for a constant side (where the built-in raises)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def slope(x: str = "x", y: str = "y") -> Column:
    """Aggregate: slope of y on x; null for a constant x."""
    return F.try_divide(F.covar_pop(x, y), F.var_pop(x))


def _corr() -> Column:
    r = correlation()
    return F.when((F.count("*") >= 3) & r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _with_p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", correlation_p(F.col("r"), F.col("n")))


def kendall(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``keys``, ``n``, ``tau`` (tau-b), ``p`` (normal approximation with ties; exact up to 33 rows without ties).

    The pairs of a group are compared with each other, as the statistic is defined over them; it is meant for
    tables of a row a model. Null below three pairs.
    """
    if not keys:
        return kendall(df.withColumn("_all", F.lit(1)), ["_all"], x, y).drop("_all")
    pairs = complete_pairs(df, keys, x, y)
    numbered = pairs.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("x", "y")))
    a = numbered.select(*keys, F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("i").alias("ia"))
    b = numbered.select(*keys, F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("i").alias("ib"))
    joined = a.join(b, keys).where("ia < ib")
    sign = F.signum(F.col("xa") - F.col("xb")) * F.signum(F.col("ya") - F.col("yb"))
    scored = joined.groupBy(*keys).agg(
        F.sum(sign).alias("s"), F.count_if(F.col("xa") == F.col("xb")).alias("tx"), F.count_if(F.col("ya") == F.col("yb")).alias("ty"), F.count("*").alias("m")
    )
    sizes = pairs.groupBy(*keys).agg(F.count("*").alias("n"))
    base = sizes.join(scored, keys, "left")
    tau = F.try_divide("s", F.sqrt((F.col("m") - F.col("tx")).cast("double") * (F.col("m") - F.col("ty"))))

    def ties(c: str, name: str) -> DataFrame:
        t = F.col("t")
        return pairs.groupBy(*keys, c).agg(F.count("*").alias("t")).groupBy(*keys).agg(
            F.sum(t * (t - 1)).alias(f"{name}2"), F.sum(t * (t - 1) * (t - 2)).alias(f"{name}3"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{name}v")
        )

    tx, ty = ties("x", "x"), ties("y", "y")
    full = base.join(tx, keys).join(ty, keys)
    p = kendall_p("n", "s", "x2", "x3", "xv", "y2", "y3", "yv")
    enough = F.col("n") >= 3
    return full.select(*keys, "n", F.when(enough, tau).alias("tau"), F.when(enough & tau.isNotNull(), p).alias("p"))


def linear_fit(df: DataFrame, keys: list[str], x: str, y: str, log_x: bool = False) -> DataFrame:
    """``keys``, ``n``, ``slope``, ``intercept``, ``r``, ``p`` of y on x (or on ln x, positive x only).

    Null below two pairs (three on ln x) and for a constant x.
    """
    pairs = complete_pairs(df, keys, x, y)
    least = 3 if log_x else 2
    if log_x:
        pairs = pairs.where("x > 0").withColumn("x", F.ln("x"))
    fits = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.when(F.count("*") >= least, slope()).alias("slope"),
        F.when(F.count("*") >= least, F.avg("y") - slope() * F.avg("x")).alias("intercept"),
        _corr().alias("r"),
    )
    return _with_p(fits)


def stars(p: Column) -> Column:
    """Marks of significance at 0.05, 0.01 and 0.001; empty above and for null."""
    return F.when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").otherwise("")


# --- p-values: scalar mathematics that Spark has no function for; one value a statistic ------------


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + term * d or tiny)
        c = 1.0 + term / c or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front * (f - 1.0)


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def kendall_exact(n: int, discordant: int) -> float:
    """Two-sided exact p-value for ``discordant`` of all pairs of ``n`` rows without ties."""
    most = n * (n - 1) // 2
    c = min(discordant, most - discordant)
    counts = [1]
    for k in range(2, n + 1):
        grown = [0] * min(c + 1, len(counts) + k - 1)
        for i, v in enumerate(counts):
            for j in range(k):
                if i + j < len(grown):
                    grown[i + j] += v
        counts = grown
    return min(1.0, 2.0 * sum(counts[: c + 1]) / math.factorial(n))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs; null below three pairs or without r."""

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        def one(x: float, k: float) -> float | None:
            if x is None or math.isnan(x) or k < 3:
                return None
            if abs(x) >= 1.0:
                return 0.0
            return t_two_sided(x * math.sqrt((k - 2) / (1 - x * x)), k - 2)

        return pd.Series([one(x, k) for x, k in zip(r, n)], dtype="float64")

    return p(r, n)


def kendall_p(*columns: str) -> Column:
    """P-value of Kendall's statistic from its tie terms."""

    @F.pandas_udf("double")
    def p(n: pd.Series, s: pd.Series, x2: pd.Series, x3: pd.Series, xv: pd.Series, y2: pd.Series, y3: pd.Series, yv: pd.Series) -> pd.Series:
        def one(n, s, x2, x3, xv, y2, y3, yv):
            if s is None or math.isnan(s) or n < 3:
                return None
            n, s = int(n), float(s)
            if not x2 and not y2 and n <= 33:
                return kendall_exact(n, round((n * (n - 1) / 2 - s) / 2))
            v0 = n * (n - 1) * (2 * n + 5)
            var = (v0 - xv - yv) / 18 + x2 * y2 / (2 * n * (n - 1)) + (x3 * y3 / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0)
            return math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2)) if var > 0 else None

        return pd.Series([one(*row) for row in zip(n, s, x2, x3, xv, y2, y3, yv)], dtype="float64")

    return p(*[F.col(c) for c in columns])
