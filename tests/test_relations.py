import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from semantide.operators import dataflow, profile, sampling, scoring, stats


def test_histogram_keeps_empty_classes(spark):
    df = spark.createDataFrame([(1,), (50,), (51,), (5000,), (None,)], "loc int")
    rows = {r["bin"]: (r["n"], r["pct"]) for r in profile.histogram(df, "loc").collect()}
    assert len(rows) == 7 and rows["<=50"] == (2, 50.0) and rows["51-100"] == (1, 25.0) and rows["201-500"] == (0, 0.0) and rows[">2000"] == (1, 25.0)
    assert {r["n"] for r in profile.histogram(df.where("loc < 0"), "loc").collect()} == {0}


def test_percentiles(spark):
    rng = random.Random(2)
    groups = {g: [rng.randint(0, 9) for _ in range(rng.randint(1, 30))] for g in "abc"}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("d", None)], "g string, v int")
    near = {r["g"]: r["p"] for r in profile.percentiles_nearest(df, ["g"], "v", {"p": 0.35}).collect()}
    assert near == {g: sorted(vs)[round((len(vs) - 1) * 0.35)] for g, vs in groups.items()}
    linear = {r["g"]: r["p"] for r in profile.percentiles_linear(df, ["g"], "v", {"p": 0.35}).collect()}
    assert linear["d"] is None
    for g, vs in groups.items():
        assert abs(linear[g] - pd.Series(vs).quantile(0.35)) < 1e-9


def test_summary_rounds_half_even(spark):
    r = profile.rounded_summary(spark.createDataFrame([(1,), (4,)], "x int"), "x").first()
    assert tuple(r) == (2, 1, 4)
    assert tuple(profile.rounded_summary(spark.createDataFrame([], "x int"), "x").first()) == (0, 0, 0)


@pytest.mark.parametrize("ties", ["order", "last"])
def test_largest_remainder_adds_up(spark, ties):
    rng = random.Random(6)
    for seats in (0, 7, 100):
        counts = [(f"b{k}", rng.choice([0, 1, 1, 2, 5, 9])) for k in range(9)]
        out = {r["bin"]: r["quota"] for r in sampling.largest_remainder(spark.createDataFrame(counts, "bin string, n long"), seats, ties=ties).collect()}
        total = sum(n for _, n in counts)
        exact = {b: seats * n / total for b, n in counts}
        order = sorted(exact, key=lambda b: (-(exact[b] - math.floor(exact[b])), b if ties == "order" else tuple(-ord(c) for c in b)))
        left = seats - sum(math.floor(x) for x in exact.values())
        assert out == {b: math.floor(exact[b]) + (b in order[:left]) for b in exact}
    assert sampling.largest_remainder(spark.createDataFrame([], "bin string, n long"), 5).count() == 0


def test_samples_caps_and_names(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2], k % 3 == 0) for k in range(40)], "id int, bin string, label boolean")
    quotas = spark.createDataFrame([("a", 3), ("b", 0), ("z", 9)], "bin string, quota int")
    got = sampling.stratified_sample(df, "bin", quotas, "id").collect()
    assert len(got) == 3 and {r["bin"] for r in got} == {"a"}
    again = sampling.stratified_sample(df.repartition(7), "bin", quotas, "id").collect()
    assert {r["id"] for r in got} == {r["id"] for r in again}
    capped = sampling.balanced_cap(df, ["bin"], "label", 2, ["id"]).groupBy("bin", "label").count().collect()
    assert {r["count"] for r in capped} == {2}
    names = spark.createDataFrame([(1, "x.c"), (2, "x.c"), (3, "x.c"), (4, "x_2.c"), (5, "y")], "id int, name string")
    made = {r["id"]: r["unique_name"] for r in sampling.dedupe_names(names, "name", ["id"]).collect()}
    assert made[1] == "x.c" and made[3] == "x_3.c" and made[5] == "y" and len(set(made.values())) == 5


def test_quotas_are_redistributed():
    assert sampling.redistribute({"a": 5.0, "b": 3.0, "c": 2.0}, {"a": 2, "b": 9, "c": 9}, 10) == {"a": 2, "b": 5, "c": 3}
    assert sampling.redistribute({"a": 5.0}, {"a": 2}, 5) == {"a": 2}


def test_diverse_selection_spreads_out(spark):
    rows = [("s", f"p{k:02}", f"g{k % 5}", float(k % 10), float(k // 10)) for k in range(60)]
    df = spark.createDataFrame(rows, "bin string, id string, grp string, x double, y double")
    got = sampling.diverse_sample(df, "bin", ["x", "y"], "id", "grp", "x", 6).orderBy("step").collect()
    assert [r["step"] for r in got] == [1, 2, 3, 4, 5, 6] and len({r["id"] for r in got}) == 6
    assert sampling.diverse_sample(df.where("x < 0"), "bin", ["x", "y"], "id", "grp", "x", 6).count() == 0


def plain_diverse(rows, seats):
    """The greedy choice by its definition, over all rows (id, group, complexity, x, y) of one stratum."""
    rows = sorted(rows)
    lo, hi = [min(r[k] for r in rows) for k in (3, 4)], [max(r[k] for r in rows) for k in (3, 4)]
    at = {r[0]: [(r[3 + k] - lo[k]) / (hi[k] - lo[k]) for k in (0, 1)] for r in rows}
    top = max(r[2] for r in rows)
    chosen = [max(rows, key=lambda r: r[2])]
    while len(chosen) < min(seats, len(rows)):
        used, ids = {r[1] for r in chosen}, {r[0] for r in chosen}
        near = lambda r: min(sum((a - b) ** 2 for a, b in zip(at[r[0]], at[c[0]])) ** 0.5 for c in chosen)
        chosen.append(max((r for r in rows if r[0] not in ids), key=lambda r: near(r) + 0.12 * (r[1] not in used) + 0.03 * (r[2] / top)))
    return [r[0] for r in chosen]


def test_diverse_selection_looks_at_every_row_of_a_large_stratum(spark):
    rng = random.Random(3)
    rows = {s: [(f"{s}{k:04}", f"g{rng.randrange(9)}", rng.random(), rng.random(), rng.random()) for k in range(n)] for s, n in (("a", 2600), ("b", 700), ("c", 9))}
    far = [("a9000", "g1", 2.0, 0.5, 0.5), ("a9001", "g1", 0.1, 7.0, 0.5), ("a9002", "g1", 0.1, 0.5, 7.0), ("a9003", "g1", 0.1, -7.0, -7.0)]
    rows["a"] += far
    df = spark.createDataFrame([(s, *r) for s, part in rows.items() for r in part], "bin string, id string, grp string, c double, x double, y double")
    got = {}
    for r in sampling.diverse_sample(df.repartition(5), "bin", ["x", "y"], "id", "grp", "c", 15).orderBy("step").collect():
        got.setdefault(r["bin"], []).append(r["id"])
    assert got["a"][0] == "a9000" and {r[0] for r in far} <= set(got["a"])
    assert got == {s: plain_diverse(part, 15) for s, part in rows.items()}


def test_priority_takes_the_best_of_each_group_first(spark):
    df = spark.createDataFrame([("a", 9), ("a", 8), ("a", 7), ("b", 1), (None, 3)], "g string, v int")
    got = [(r["g"], r["v"]) for r in sampling.priority_select(df, "g", [F.col("v").desc()], 4).collect()]
    assert set(got[:3]) == {("a", 9), ("b", 1), (None, 3)} and got[3] == ("a", 8)


def test_scale_and_batches(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("b", 3, 1)], "g string, x int, y int")
    assert {tuple(r) for r in sampling.min_max(df, ["g"], ["x", "y"]).collect()} == {("a", 0.0, 0.0), ("a", 1.0, 0.0), ("b", 0.0, 0.0)}
    assert [r["batch"] for r in sampling.micro_batches(spark.range(5).withColumn("g", F.lit(1)), ["g"], ["id"], 2).orderBy("id").collect()] == [0, 0, 1, 1, 2]
    assert sampling.shard(spark.range(100), "id", 4).where("shard NOT BETWEEN 0 AND 3").count() == 0


def test_accuracy_keeps_unread_rows(spark):
    rows = [("m", "p", "deadcode", True), ("m", "p", "dead_code", None), ("m", "q", "liveness", False), ("n", "p", "liveness", True)]
    log = spark.createDataFrame(rows, "model string, program string, category string, first_response_correct boolean")
    wide = {r["model"]: r for r in scoring.accuracy_matrix(log).collect()}
    assert wide["m"]["dead_code"] == 0.5 and wide["m"]["liveness"] == 0.0 and wide["m"]["geo_mean"] == 0.0 and wide["m"]["dominators"] is None
    assert wide["n"]["geo_mean"] == 1.0
    assert scoring.accuracy_matrix(log.where("model = 'x'")).count() == 0


def test_latest_rows_and_defaults(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 2, "c"), (2, None, "d")], "k int, t int, v string")
    assert {tuple(r) for r in scoring.latest_rows(df, "k", ["t", "v"]).collect()} == {(1, 3, "b"), (2, None, "d")}
    lookup = spark.createDataFrame([("x", 1.0), ("other", 9.0)], "g string, w double")
    rows = spark.createDataFrame([("x",), ("y",), (None,)], "g string")
    assert {(r["g"], r["w"]) for r in scoring.with_default(rows, lookup, "g", "other").collect()} == {("x", 1.0), ("y", 9.0), (None, 9.0)}


def test_correlations_against_plain_formulas(spark):
    rng = random.Random(8)
    rows = [(g, float(rng.randint(0, 6)), float(rng.randint(0, 6))) for g in ("a", "b") for _ in range(20)] + [("c", 1.0, 2.0), ("c", 2.0, 1.0), ("d", 1.0, None), ("e", 1.0, 1.0), ("e", 1.0, 2.0), ("e", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    frame = pd.DataFrame(rows, columns=["g", "x", "y"]).dropna()
    sp = {r["g"]: r for r in stats.spearman(df, ["g"], "x", "y").collect()}
    pe = {r["g"]: r for r in stats.pearson(df, ["g"], "x", "y").collect()}
    ke = {r["g"]: r for r in stats.kendall(df, ["g"], "x", "y").collect()}
    for g in "ab":
        part = frame[frame.g == g]
        assert abs(sp[g]["r"] - part.x.rank().corr(part.y.rank())) < 1e-9
        assert abs(pe[g]["r"] - part.x.corr(part.y)) < 1e-9
        xs, ys = part.x.tolist(), part.y.tolist()
        s = tx = ty = m = 0
        for i in range(len(xs)):
            for j in range(i):
                a, b = (xs[i] > xs[j]) - (xs[i] < xs[j]), (ys[i] > ys[j]) - (ys[i] < ys[j])
                s, tx, ty, m = s + a * b, tx + (a == 0), ty + (b == 0), m + 1
        assert abs(ke[g]["tau"] - s / math.sqrt((m - tx) * (m - ty))) < 1e-9
        assert 0 <= ke[g]["p"] <= 1
    assert sp["c"]["r"] is None and ke["c"]["tau"] is None and "d" not in sp and pe["e"]["r"] is None
    assert stats.kendall(df.where("g = 'a'"), [], "x", "y").first()["tau"] == ke["a"]["tau"]


def test_p_values_against_tables():
    # Student's t, two-sided: 2.571 with 5, 2.228 with 10, 1.960 with very many degrees of freedom give 0.05.
    assert abs(stats.t_two_sided(2.5706, 5) - 0.05) < 1e-4
    assert abs(stats.t_two_sided(2.2281, 10) - 0.05) < 1e-4
    assert abs(stats.t_two_sided(1.96, 1e6) - 0.05) < 1e-4
    assert abs(stats.t_two_sided(0.0, 7) - 1.0) < 1e-12
    # Kendall, exact: of the 24 orders of four rows one has no discordant pair.
    assert abs(stats.kendall_exact(4, 0) - 2 / 24) < 1e-12
    assert abs(stats.kendall_exact(4, 1) - 8 / 24) < 1e-12
    assert stats.kendall_exact(5, 5) == 1.0


def test_fits(spark):
    df = spark.createDataFrame([(float(x), 3.0 * x + 2) for x in range(1, 6)] + [(None, 1.0), (float("nan"), 2.0)], "x double, y double")
    r = stats.linear_fit(df, [], "x", "y").first()
    assert abs(r["slope"] - 3) < 1e-9 and abs(r["intercept"] - 2) < 1e-9 and r["p"] == 0.0 and r["n"] == 5
    logs = spark.createDataFrame([(math.e**k, 2.0 * k) for k in range(4)] + [(-1.0, 5.0)], "x double, y double")
    assert abs(stats.linear_fit(logs, [], "x", "y", log_x=True).first()["slope"] - 2) < 1e-9
    assert [r[0] for r in spark.createDataFrame([(0.0005,), (0.005,), (0.04,), (0.2,), (None,)], "p double").select(stats.stars(F.col("p"))).collect()] == ["***", "**", "*", "", ""]


def test_latest_definition_and_live_before(spark):
    rng = random.Random(4)
    rows = [(u, k, rng.choice("xyz"), rng.random() < 0.4, rng.random() < 0.5) for u in range(4) for k in range(25)]
    df = spark.createDataFrame(rows, "u int, pos int, var string, is_def boolean, is_use boolean")
    want = set()
    for u in range(4):
        mine = [r for r in rows if r[0] == u]
        for i in range(25):
            for v in "xyz":
                for _, j, w, d, use in mine[i:]:
                    if w == v and use:
                        want.add((u, i, v))
                        break
                    if w == v and d:
                        break
    assert {tuple(r) for r in dataflow.live_before(df, ["u"]).collect()} == want
    latest = {(r["u"], r["pos"]): r["latest"] for r in dataflow.latest_definition(df, ["u"], "pos", "is_def", "var").collect()}
    for u, k, *_ in rows:
        before = [r[2] for r in rows if r[0] == u and r[1] < k and r[3]]
        assert latest[(u, k)] == (before[-1] if before else None)


def test_smallest_missing_and_c_live_out(spark):
    universe = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "a")], "fn string, var string")
    present = spark.createDataFrame([("f", "a"), ("g", "a")], "fn string, var string")
    assert [tuple(r) for r in dataflow.smallest_missing(universe, present, ["fn"], "var").collect()] == [("f", "b")]
    assert [tuple(r) for r in dataflow.c_live_out(universe, present, present.where("fn = 'g'"), ["fn"]).collect()] == [("f", ["a", "b"])]
