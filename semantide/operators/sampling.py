"""Quotas, stratified and balanced samples, diverse selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semantide.operators.ranges import row_numbers
from semantide.sources.shared import materialise

#: Rows of a stratum that one task compares in a round; the number of rounds depends on it, the choice doesn't.
CANDIDATES = 500


def hash_order(seed: int, *columns: str) -> Column:
    """A reproducible random order: SHA-256 of the seed and the columns."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]), 256)


def largest_remainder(counts: DataFrame, seats: int, label: str = "bin", n: str = "n", ties: str = "order") -> DataFrame:
    """``counts`` with ``quota``: seats shared out in proportion, remainders to the largest fractions.

    ``ties``: "order" gives equal fractions to the smaller label first, "last" to the larger. No rows, or only
    zeros, get no seats. One row a bin is expected.
    """
    total = F.sum(n).over(Window.partitionBy())
    exact = F.coalesce(F.try_divide(F.col(n) * F.lit(float(seats)), total), F.lit(0.0))
    base = counts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    tie = F.col(label).asc() if ties == "order" else F.col(label).desc()
    place = F.row_number().over(Window.partitionBy().orderBy((F.col("_exact") - F.col("_floor")).desc(), tie))
    left = F.lit(seats) - F.sum("_floor").over(Window.partitionBy())
    any_left = F.coalesce(total, F.lit(0)) > 0
    return base.withColumn("quota", F.when(any_left, F.col("_floor") + (place <= left).cast("int")).otherwise(0).cast("bigint")).drop("_exact", "_floor")


def stratified_sample(df: DataFrame, bin_column: str, quotas: DataFrame, id_column: str, seed: int = 42) -> DataFrame:
    """The first rows of each bin in hash order, as many as ``quotas`` (``bin_column``, ``quota``) say.

    The rank limit is pushed below the exchange as a group limit, so a task sends no more of a bin than the
    largest quota.
    """
    # One row a bin; the greatest quota bounds every rank.
    most = quotas.agg(F.max("quota")).first()[0] or 0
    ranked = df.join(quotas.select(bin_column, "quota"), bin_column).withColumn("_h", hash_order(seed, id_column))
    place = F.row_number().over(Window.partitionBy(bin_column).orderBy("_h", id_column))
    return ranked.withColumn("_place", place).where(F.col("_place") <= most).where(F.col("_place") <= F.col("quota")).drop("_h", "_place", "quota")


def balanced_cap(df: DataFrame, keys: list[str], label: str, cap: int, order: list[str], seed: int = 42) -> DataFrame:
    """At most ``cap`` rows for each key and label, in hash order."""
    w = Window.partitionBy(*keys, label).orderBy(hash_order(seed, *order), *order)
    return df.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= cap).drop("_place")


def dedupe_names(df: DataFrame, name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """Names made unique: the first keeps its own, the next get ``_2``, ``_3`` and so on before the extension.

    A made name that equals a given one is told apart by a further number.
    """
    w = Window.partitionBy(name).orderBy(*order)
    numbered = df.withColumn("_k", F.row_number().over(w))
    base, ext = F.regexp_replace(F.col(name), r"(?<=.)\.[^.]*$", ""), F.regexp_extract(F.col(name), r"(?<=.)(\.[^.]*)$", 1)
    first = numbered.withColumn("_made", F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat(base, F.lit("_"), F.col("_k").cast("string"), ext)))
    again = F.row_number().over(Window.partitionBy("_made").orderBy("_k", *order))
    stem, tail = F.regexp_replace(F.col("_made"), r"(?<=.)\.[^.]*$", ""), F.regexp_extract(F.col("_made"), r"(?<=.)(\.[^.]*)$", 1)
    return first.withColumn("_again", again).withColumn(out, F.when(F.col("_again") == 1, F.col("_made")).otherwise(F.concat(stem, F.lit("__"), F.col("_again").cast("string"), tail))).drop("_k", "_made", "_again")


def redistribute(ideal: dict[str, float], capacity: dict[str, int], seats: int) -> dict[str, int]:
    """Seats for a handful of bins: floors within capacity, then one by one to the bin that misses most."""
    quota = {b: min(int(ideal[b]), capacity.get(b, 0)) for b in ideal}
    while sum(quota.values()) < seats:
        open_bins = [b for b in quota if quota[b] < capacity.get(b, 0)]
        if not open_bins:
            break
        best = max(open_bins, key=lambda b: (ideal[b] - quota[b], capacity[b]))
        quota[best] += 1
    return quota


def shortage(targets: DataFrame, available: DataFrame, bin_column: str = "bin") -> DataFrame:
    """``bin``, ``need``, ``available``, ``missing`` for every target."""
    have = available.groupBy(bin_column).agg(F.count("*").alias("available"))
    rows = targets.join(have, bin_column, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return rows.withColumn("missing", F.greatest(F.col("need") - F.col("available"), F.lit(0)))


def min_max(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 within ``keys``; a constant column is 0."""
    bounds = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    joined = df.join(bounds, keys)
    scaled = [F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")), F.lit(0.0)).alias(c) for c in columns]
    return joined.select(*[c for c in df.columns if c not in columns], *scaled)


def _score(x: np.ndarray, weight: np.ndarray, groups: np.ndarray, chosen: list[dict]) -> np.ndarray:
    """Distance to the nearest chosen row, with a bonus for a new group and for complexity; complexity alone before the first choice."""
    if not chosen:
        return weight
    near = np.full(len(x), np.inf)
    for c in chosen:
        near = np.minimum(near, np.sqrt(((x - np.array(c["x"])) ** 2).sum(axis=1)))
    return near + 0.12 * ~np.isin(groups, [c["grp"] for c in chosen]) + 0.03 * weight


def _best_of_batch(bounds: dict[object, dict], chosen: dict[object, list[dict]], seats: int):
    """Of each batch and open stratum the ``CANDIDATES`` + 1 best rows, and those that tie with the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strata = batch.column(1).dictionary_encode(null_encoding="encode")
            codes = strata.indices.to_numpy(zero_copy_only=False)
            groups = np.array(batch.column(2).to_pylist(), dtype=object).astype(str)
            weight = batch.column(3).to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4, batch.num_columns)])
            for code, stratum in enumerate(strata.dictionary.to_pylist()):
                done, bound = chosen.get(stratum, []), bounds[stratum]
                if len(done) >= seats:
                    continue
                open_rows = pc.invert(pc.is_in(batch.column(0), value_set=pa.array([c["id"] for c in done], batch.column(0).type))).to_numpy(zero_copy_only=False)
                at = np.flatnonzero((codes == code) & open_rows)
                if not len(at):
                    continue
                span = bound["hi"] - bound["lo"]
                scaled = np.where(span > 0, (x[at] - bound["lo"]) / np.where(span > 0, span, 1), 0.0)
                share = weight[at] / bound["top"] if bound["top"] > 0 else weight[at]
                score = _score(scaled, share, groups[at], done)
                if len(at) > CANDIDATES + 1:
                    keep = score >= np.partition(score, -(CANDIDATES + 1))[-(CANDIDATES + 1)]
                    at, scaled, share, score = at[keep], scaled[keep], share[keep], score[keep]
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(groups[at].tolist(), pa.string()), pa.array(share), pa.array(scaled.tolist(), pa.list_(pa.float64())), pa.array(score)],
                    ["id", "stratum", "grp", "weight", "x", "score"],
                )

    return run


def _choose(chosen: dict[object, list[dict]], seats: int):
    """The next rows of a stratum, as far as no row outside the candidates can come first."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        stratum = None if pd.isna(key[0]) else key[0]
        done, before = list(chosen.get(stratum, [])), len(chosen.get(stratum, []))
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        # Scores never rise from one choice to the next, so rows left out stay at or below this one.
        limit = pdf["score"].iloc[-1] if len(pdf) > CANDIDATES else -np.inf
        pool = pdf.head(CANDIDATES).sort_values("id").reset_index(drop=True)
        x, weight, groups = np.array(pool["x"].tolist()), pool["weight"].to_numpy(), pool["grp"].to_numpy().astype(str)
        picks: list[int] = []
        while len(done) < seats and len(picks) < len(pool):
            score = _score(x, weight, groups, done)
            score[picks] = -np.inf
            best = int(score.argmax())
            if picks and score[best] <= limit:
                break
            picks.append(best)
            done.append({"x": x[best], "grp": groups[best]})
            if len(done) == 1:  # from here on scores are of another kind
                break
        return pool.iloc[picks][["id", "stratum", "grp", "x"]].assign(step=range(before + 1, before + len(picks) + 1))

    return run


def diverse_sample(df: DataFrame, stratum: str, features: list[str], id_column: str, group: str, complexity: str, seats: int) -> DataFrame:
    """``id_column``, ``stratum``, ``step``: up to ``seats`` diverse rows of each stratum, chosen one by one from all its rows.

    First the most complex row, then the one farthest from what is chosen (features scaled to 0..1 within the
    stratum), with a bonus for a new ``group`` and for complexity. Ties go to the smaller id; ids are unique. Nulls count as 0.

    A round scores all rows of a written table against the chosen ones and hands the ``CANDIDATES`` best of each
    stratum to one task, which goes on choosing while its best is above the best row left out. As scores never rise,
    the choice is that of one step a round. The driver keeps the chosen rows: ``seats`` for each stratum.
    """
    spark, types = df.sparkSession, dict(df.dtypes)
    schema = f"{id_column} {types[id_column]}, {stratum} {types[stratum]}, step long"
    if seats <= 0:
        return spark.createDataFrame([], schema)
    filled = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    xs = [f"x{k}" for k in range(len(features))]
    rows = materialise(
        df.select(F.col(id_column).alias("id"), F.col(stratum).alias("stratum"), F.col(group).cast("string").alias("grp"), filled(complexity).alias("c"), *[filled(f).alias(x) for f, x in zip(features, xs)]),
        "diverse",
    )
    found = rows.groupBy("stratum").agg(F.count("*").alias("n"), F.max("c").alias("top"), F.array(*[F.min(x) for x in xs]).alias("lo"), F.array(*[F.max(x) for x in xs]).alias("hi")).collect()
    bounds = {r["stratum"]: {"top": r["top"], "lo": np.array(r["lo"]), "hi": np.array(r["hi"])} for r in found}
    size = {r["stratum"]: r["n"] for r in found}
    chosen: dict[object, list[dict]] = {s: [] for s in size}
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(F.col("score").desc(), "id"))
    kept = f"id {types[id_column]}, stratum {types[stratum]}, grp string"
    while any(len(chosen[s]) < min(seats, n) for s, n in size.items()):
        best = rows.mapInArrow(_best_of_batch(bounds, chosen, seats), f"{kept}, weight double, x array<double>, score double")
        best = best.withColumn("place", place).where(F.col("place") <= CANDIDATES + 1).drop("place")
        picks = best.groupBy("stratum").applyInPandas(_choose(chosen, seats), f"{kept}, x array<double>, step long").collect()
        if not picks:
            break
        for r in sorted(picks, key=lambda r: r["step"]):
            chosen[r["stratum"]].append(r.asDict())
    return spark.createDataFrame([(c["id"], s, c["step"]) for s, picked in chosen.items() for c in picked], schema)


def priority_select(df: DataFrame, group: str, order: list[Column], seats: int) -> DataFrame:
    """Rows by priority, the best of each ``group`` before any second one, up to ``seats``; no group can give more than that, so a task keeps no more."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("round", rank).where(F.col("round") <= seats).orderBy("round", *order).limit(seats)


def shard(df: DataFrame, key: str, shards: int) -> DataFrame:
    """``df`` with ``shard``: a number from 0 to ``shards`` - 1 from the MD5 of the key, so that other engines can tell it, too."""
    number = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("shard", F.pmod(number, F.lit(shards)).cast("int"))


def micro_batches(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """``df`` with ``batch``: successive slices of ``size`` rows within ``keys``; rows are numbered in ranges, whatever the size of a group."""
    return row_numbers(df, keys, order, "_number").withColumn("batch", F.floor((F.col("_number") - 1) / size).cast("int")).drop("_number")


def keep_long_then_fill(df: DataFrame, stratum: str, long: Column, shares: dict[str, float], features: list[str], id_column: str, group: str, complexity: str, seats: int) -> DataFrame:
    """``id_column``, ``stratum``: all long rows, the rest of the seats shared out among the other strata and filled diversely.

    Where the long rows alone exceed the seats, they are chosen diversely. A stratum that can't fill its quota passes its
    seats on. ``shares`` names a handful of strata.
    """
    marked = df.withColumn("_long", F.coalesce(long, F.lit(False)))
    counts = {(r["_long"], r[stratum]): r["n"] for r in marked.where(F.col("_long") | F.col(stratum).isin(*shares)).groupBy("_long", stratum).agg(F.count("*").alias("n")).collect()}
    n_long = sum(n for (is_long, _), n in counts.items() if is_long)
    if n_long >= seats:
        pool = marked.where("_long").withColumn("_all", F.lit("long"))
        chosen = diverse_sample(pool, "_all", features, id_column, group, complexity, seats).select(id_column)
        return marked.join(chosen, id_column, "left_semi").select(id_column, stratum)
    left, weight = seats - n_long, sum(shares.values())
    ideal = {s: w / weight * left for s, w in shares.items()}
    quotas = redistribute(ideal, {s: counts.get((False, s), 0) for s in shares}, left)
    out = marked.where("_long").select(id_column, stratum)
    rest = marked.where("NOT _long")
    for s, quota in quotas.items():
        if quota:
            out = out.unionByName(diverse_sample(rest.where(F.col(stratum) == s), stratum, features, id_column, group, complexity, quota).select(id_column, stratum))
    return out


def greedy_select(df: DataFrame, problem: str, keys: list[str], name: str, seats: int, used: DataFrame | None = None) -> DataFrame:
    """The rows that a greedy choice takes: each time the one with the greatest (problem not used so far, ``keys``, ``name``).

    A problem counts as used once a row of it is taken, or if ``used`` (a column ``problem``) has it. As that
    comes before all other keys, the choice is: the best row of every new problem in the order of the keys, then all others
    in their order. So it takes one aggregate and a top-k, and no window over a problem. Null problems are one problem,
    null keys are least; ``name`` is unique. ``place`` tells the order.
    """
    group = F.coalesce(F.col(problem).cast("string"), F.lit(""))
    best = df.groupBy(group.alias("_problem")).agg(F.max(F.struct(*keys, name)).alias("_best"))
    if used is not None:
        best = best.join(used.select(F.coalesce(F.col("problem").cast("string"), F.lit("")).alias("_problem")).distinct(), "_problem", "left_anti")
    fresh = best.select(F.col(f"_best.{name}").alias(name), F.lit(1).alias("_new"))
    order = [F.coalesce("_new", F.lit(0)).desc(), *[F.col(k).desc_nulls_last() for k in keys], F.col(name).desc()]
    taken = df.join(fresh, name, "left").orderBy(*order).limit(seats)
    # At most ``seats`` rows are numbered.
    return taken.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*order))).drop("_new")


def staged_select(df: DataFrame, problem: str, keys: list[str], name: str, reliable: str, bucket: str, targets: dict[str, int], seats: int) -> DataFrame:
    """``df`` with ``stage``: reliable rows first, then each bucket up to its target, then whatever is left, by ``greedy_select``.

    Problems used in a stage stay used in the next. ``targets`` names a handful of buckets. Raises if there are fewer than ``seats`` rows.
    """
    chosen: DataFrame | None = None

    def take(pool: DataFrame, n: int, stage: str) -> None:
        nonlocal chosen
        if n <= 0:
            return
        rest = pool if chosen is None else pool.join(chosen.select(name), name, "left_anti")
        used = None if chosen is None else chosen.select(F.col(problem).alias("problem"))
        got = greedy_select(rest, problem, keys, name, n, used).drop("place").withColumn("stage", F.lit(stage))
        chosen = materialise(got if chosen is None else chosen.unionByName(got), "stage")

    sure, other = df.where(F.col(reliable)), df.where(~F.coalesce(F.col(reliable), F.lit(False)))
    take(sure, seats, "reliable")
    for b, target in targets.items():
        counts = chosen.agg(F.count("*"), F.count_if(F.col(bucket) == b)).first() if chosen is not None else (0, 0)
        take(other.where(F.col(bucket) == b), min(target - counts[1], seats - counts[0]), b)
    take(other, seats - (chosen.count() if chosen is not None else 0), "rest")
    n = 0 if chosen is None else chosen.count()
    if n < seats:
        raise ValueError(f"only {n} rows for {seats} seats")
    return chosen
