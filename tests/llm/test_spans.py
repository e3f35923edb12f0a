import random

import pytest
from pyspark.sql import functions as F

from semantide.llm import spans
from semantide.llm.spans import SharedSpans


def brute(rows, n):
    windows = {}
    for i, t in rows:
        for k in range(len(t or "") - n + 1):
            windows.setdefault(t[k : k + n], set()).add(i)
    pairs = {(a, b) for ids in windows.values() for a in ids for b in ids if a < b}
    covered = {}
    for i, t in rows:
        hit = [False] * len(t or "")
        for k in range(len(t or "") - n + 1):
            if len(windows[t[k : k + n]]) > 1:
                hit[k : k + n] = [True] * n
        if any(hit):
            covered[i] = sum(hit)
    return pairs, covered


def longest(rows, n):
    """The longest stretch of each text that another record has, by trying all lengths."""
    out = {}
    for i, t in rows:
        others = [u for j, u in rows if j != i and u]
        best = 0
        for k in range(len(t or "")):
            while k + best < len(t) and any(t[k : k + best + 1] in u for u in others):
                best += 1
        if best >= n:
            out[i] = best
    return out


def check(spark, rows, n, schema="doc long, text string"):
    found = SharedSpans(spark.createDataFrame(rows, schema), "doc", "text", n)
    pairs, covered = brute(rows, n)
    assert {tuple(r) for r in found.pairs().collect()} == pairs
    parts = found.coverage().collect()
    assert {r["id"]: r["shared_chars"] for r in parts} == covered
    assert {r["id"]: r["longest_span"] for r in parts} == longest(rows, n)


def test_random_texts_agree_with_brute_force(spark):
    rng = random.Random(5)
    parts = ["".join(rng.choice("abc é漢😀") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) + "x" * rng.randint(0, 3)) for i in range(60)]
    check(spark, rows + [(100, None), (101, ""), (102, "a" * 300), (103, "a" * 50)], 20)


def test_a_stretch_of_exactly_the_length_counts_and_one_less_does_not(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(90)) for _ in range(8)]
    s = "".join(rng.choice("klmnop") for _ in range(200))
    rows = [(1, words[0] + s + words[1]), (2, words[2] + s + words[3]), (3, words[4] + s[:199] + words[5]), (4, words[6] + s[1:] + words[7])]
    check(spark, rows, 200)


def test_many_surroundings_take_the_way_by_shift(spark, monkeypatch):
    monkeypatch.setattr(spans, "PAIRWISE_CLASSES", 3)
    rng = random.Random(2)
    head = "".join(rng.choice("abcdefgh") for _ in range(30))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 25))) + head + "".join(rng.choice("xy") for _ in range(25))) for i in range(40)]
    check(spark, rows, 40)


def test_long_texts_are_cut_into_overlapping_pieces(spark, monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", 64)
    rng = random.Random(3)
    s = "".join(rng.choice("abcdefghij") for _ in range(90))
    rows = [(1, "".join(rng.choice("kl") + rng.choice("mnop") for _ in range(700)) + s), (2, s + "".join(rng.choice("qrst") for _ in range(900))), (3, s[:30])]
    check(spark, rows, 40)


def test_empty_table_extra_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "q" * 60, 5, "t"), (1, "q" * 60, 6, "u"), (2, "q" * 60, 7, "v")], "doc long, body string, id long, text string")
    assert [tuple(r) for r in SharedSpans(df, "doc", "body", 40).pairs().collect()] == [(1, 2)]
    assert SharedSpans(df.where("doc < 0"), "doc", "body", 40).pairs().count() == 0
    assert SharedSpans(df.where("doc < 0"), "doc", "body", 40).coverage().count() == 0


def test_stretches_of_two_partners_that_touch_are_two_spans(spark):
    rng = random.Random(4)
    x, y = ("".join(rng.choice("abcdefgh") for _ in range(300)) for _ in range(2))
    rows = [(1, x + y), (2, "." + x + ","), (3, ";" + y)]
    got = {r["id"]: tuple(r)[1:] for r in SharedSpans(spark.createDataFrame(rows, "d long, t string"), "d", "t", 200).coverage().collect()}
    assert got == {1: (2, 600, 300), 2: (1, 300, 300), 3: (1, 300, 300)}


def test_long_near_copies_write_a_pair_where_it_begins_only(spark):
    rng = random.Random(6)
    body = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    rows = [(i, body[: 300 * i] + "#" * i + body[300 * i :]) for i in range(1, 31)] + [(100 + i, body) for i in range(20)]
    found = SharedSpans(spark.createDataFrame(rows, "d long, t string"), "d", "t", 200)
    assert found.pairs().count() == 50 * 49 // 2
    # One of the equal texts stands for all; the rows before the last step are at most twice the pairs.
    assert found.links().count() == 31 * 30 // 2
    copies = {r["id"]: r["rep"] for r in found.classes_of_texts().collect()}
    assert copies == {100 + i: 100 for i in range(20)}


def test_odd_lengths_are_refused(spark):
    with pytest.raises(ValueError):
        SharedSpans(spark.range(1).select("id", F.lit("a").alias("t")), "id", "t", 41)
