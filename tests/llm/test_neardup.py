import os
import random
from collections import Counter

import numpy as np

from semantide.llm import neardup
from semantide.llm.plans import p3_groups
from semantide.llm.neardup import NearDuplicates


def brute(rows, t, n):
    import re

    sets = {}
    for i, x in rows:
        w = re.findall("[A-Za-z0-9_]+", x or "")
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        if s:
            sets[i] = s
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["if", "for", "x", "y"] * 20
    rows = []
    for f in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                k = rng.randrange(len(copy))
                if rng.random() < 0.5:
                    copy[k] = rng.choice(words)
                else:
                    copy.insert(k, rng.choice(words))
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_pairs_agree_with_brute_force(spark):
    for threshold, n in ((0.6, 3), (0.8, 5)):
        rows = corpus(n) + [(1000, None), (1001, ""), (1002, "a b"), (1003, "a b c"), (1004, "a, b! c")]
        df = spark.createDataFrame(rows, "k long, t string")
        assert {tuple(r) for r in NearDuplicates(df, "k", "t", threshold, n).pairs().collect()} == brute(rows, threshold, n)


def test_a_crowded_group_is_split_without_losing_pairs(spark):
    base = [f"v{k}" for k in range(60)]
    rows = [(i, " ".join(base[:i] + [f"new{i}"] + base[i:])) for i in range(50)] + [(100 + i, " ".join(base)) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, t string")
    assert {tuple(r) for r in NearDuplicates(df, "k", "t", 0.6, 3).pairs().collect()} == brute(rows, 0.6, 3)


def test_groups_have_one_row_a_record(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e g"), (9, "z y x w v")]
    df = spark.createDataFrame(rows, "k long, t string")
    found = {r["id"]: r["group_id"] for r in NearDuplicates(df, "k", "t", 0.6, 3).groups().collect()}
    assert found == {1: 1, 2: 1, 3: 1}


def test_links_of_a_group_count_every_partner(spark, tmp_path):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e g"), (4, "a b c d e g"), (5, "a b c d e g"), (9, "z y x w v"), (10, None)]
    rows += [(20, "m n o p q r s"), (21, "m n o p q r t")]
    near = NearDuplicates(spark.createDataFrame(rows, "k long, t string"), "k", "t", 0.6, 3)
    want = Counter(i for pair in near.pairs().collect() for i in pair)
    assert want[1] == 4 and {r["id"]: r["n_links"] for r in near.groups().collect()} == want
    spark.createDataFrame(rows, "unique_id long, code string").write.parquet(f"{tmp_path}/code.parquet")
    out = {r["unique_id"]: (r["group_id"], r["n_links"]) for r in p3_groups(spark, str(tmp_path)).collect()}
    assert out == {i: (1, 4) for i in range(1, 6)} | {9: (9, 0), 10: (10, 0), 20: (20, 1), 21: (20, 1)}


def test_probes_restrict_the_pairs(spark):
    rows = corpus(8)
    df = spark.createDataFrame(rows, "k long, t string")
    probes = spark.createDataFrame([(i,) for i in range(0, len(rows), 7)], "id long")
    chosen = set(range(0, len(rows), 7))
    near = NearDuplicates(df, "k", "t", 0.6, 3, probes=probes)
    want = {(a, b) for x, y in brute(rows, 0.6, 3) for a, b in ((x, y), (y, x)) if b in chosen}
    assert {(r["id"], r["other"]) for r in near.partners().collect()} == want


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", 2, 3), (2, "a b c d", 2, 3)], "k long, t string, id long, text long")
    assert NearDuplicates(df, "k", "t", 0.6, 3).pairs().count() == 1
    assert NearDuplicates(df.where("k < 0"), "k", "t", 0.6, 3).pairs().count() == 0


def test_hot_runs_meet_in_blocks_without_losing_pairs(spark, monkeypatch):
    # Records that are mostly the same words, so that common runs are among their rarest.
    rng = random.Random(11)
    rows = []
    for k in range(80):
        words = ["a", "b", "c", "d", "e"] * 4
        words[rng.randrange(20)] = f"x{k}"
        rows.append((k, " ".join(words[: rng.choice([8, 12, 20])])))
    df = spark.createDataFrame(rows, "k long, t string")
    monkeypatch.setattr(neardup, "HOT_RUN", 7)
    monkeypatch.setattr(neardup, "GROUP_SIZE", 2)
    for threshold, n in ((0.6, 3), (0.8, 2)):
        near = NearDuplicates(df, "k", "t", threshold, n)
        assert len(near.hot) > 3 and max(b for _, b in near.hot) > 3
        assert {tuple(r) for r in near.pairs().collect()} == brute(rows, threshold, n)
    probes = NearDuplicates(df, "k", "t", 0.6, 3, probes=spark.createDataFrame([(1,), (7,)], "id long"))
    want = {(a, b) for x, y in brute(rows, 0.6, 3) for a, b in ((x, y), (y, x)) if b in (1, 7)}
    assert {(r["id"], r["other"]) for r in probes.partners().collect()} == want


def test_signatures_never_overstate_a_difference():
    rng = np.random.default_rng(3)
    for size in (1, 5, 40, 300, 3000):
        x = rng.integers(0, 1 << 63, size, np.uint64)
        for other in (size, size * 2, max(1, size * 2 // 3)):
            y = np.r_[x[: min(size, other) * 3 // 4], rng.integers(0, 1 << 63, other - min(size, other) * 3 // 4, np.uint64)]
            least, most = neardup._differing(neardup.signature(x), neardup.signature(y)), len(np.setxor1d(x, y))
            assert 0 <= least <= most and least % 2 == most % 2
    x, y = (rng.integers(0, 1 << 63, 300, np.uint64) for _ in range(2))
    assert neardup._differing(neardup.signature(x), neardup.signature(y)) > 0.25 * 600


def test_sets_travel_only_for_near_pairs_and_tables_go(spark, monkeypatch):
    # All records share some runs but are mostly unlike, and bring all runs to the matrix, so that every pair is a candidate by its runs.
    rng = random.Random(5)
    rows = [(k, " ".join([f"q{i}" for i in range(15)] + [f"w{rng.randrange(3000)}" for _ in range(200)])) for k in range(60)]
    rows += [(100 + k, t + " z") for k, t in rows[:5]]
    monkeypatch.setattr(neardup, "_spare", lambda n: n)
    compared, discarded = [], []
    compare, discard = NearDuplicates._compare, neardup.discard
    monkeypatch.setattr(NearDuplicates, "_compare", lambda self, pairs: compared.append(pairs.count()) or compare(self, pairs))
    monkeypatch.setattr(neardup, "discard", lambda *tables: discarded.extend(x.inputFiles()[0] for x in tables) or discard(*tables))
    near = NearDuplicates(spark.createDataFrame(rows, "k long, t string"), "k", "t", 0.6, 3)
    monkeypatch.setattr(near, "hot", [])
    assert {tuple(r) for r in near.pairs().collect()} == brute(rows, 0.6, 3) == {(k, 100 + k) for k in range(5)}
    assert compared == [5] and len(discarded) == 7
    assert not any(os.path.exists(x.removeprefix("file://").removeprefix("file:")) for x in discarded)


def test_a_larger_table_has_a_larger_sample(spark, monkeypatch):
    monkeypatch.setattr(neardup, "ORDER_SAMPLE", 10)
    rows = [(k, f"a b c d{k % 150} e{k % 150} f{k % 150}") for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, t string")
    near = NearDuplicates(df, "k", "t", 0.6, 3)
    common, weight = near._order()
    # A run of 20 records shows: one of 25 records is read, not ten in all.
    assert len(common) > 20 and weight.max() > 60
