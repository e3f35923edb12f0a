import random

import pytest

from semantide.llm import mixing
from semantide.llm.mixing import Mix
from semantide.llm.plans import TOKENIZERS

VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    rows = []
    for source, n in (("big", 900), ("mid", 300), ("small", 20)):
        rows += [(len(rows) + k, f"{source} {k} " + " ".join(f"word{rng.randint(0, 99)}" for _ in range(rng.randint(5, 40))), source) for k in range(n)]
    rows += [(10_000, rows[0][1], "BIG "), (10_001, None, "big"), (10_002, "", "big"), (10_003, "no source", None), (10_004, "elsewhere", "other")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").cache()


def mix(spark, corpus, **more):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)], "source string, target_share double, max_repeats int")
    return Mix(corpus, targets, spark.createDataFrame([("en", "the")], "lang string, word string"), VOCABULARY, **more)


def test_shares_are_reached_within_the_caps(spark, corpus):
    m = mix(spark, corpus)
    shares = {r["source"]: r for r in m.shares().collect()}
    for source, target in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(shares[source]["actual_share"] - target) < 0.02
    chosen = m.chosen().collect()
    assert len({r["id"] for r in chosen}) == len(chosen)
    assert 10_000 not in {r["id"] for r in chosen}, "a copy is the same text"
    caps = {"big": 1, "mid": 2, "small": 4}
    assert all(1 <= r["repeats"] <= caps[r["source"]] for r in chosen)
    small = [r["repeats"] for r in chosen if r["source"] == "small"]
    assert max(small) - min(small) <= 1, "complete epochs come first"


def test_a_total_is_kept_and_buckets_do_not_matter(spark, corpus, monkeypatch):
    a = {(r["id"], r["repeats"]) for r in mix(spark, corpus, total=3000).chosen().collect()}
    monkeypatch.setattr(mixing, "BUCKETS", 3)
    m = mix(spark, corpus, total=3000)
    assert {(r["id"], r["repeats"]) for r in m.chosen().collect()} == a
    total = sum(r["tokens"] for r in m.shares().collect())
    assert 2800 < total <= 3000


def test_empty_corpus(spark, corpus):
    m = mix(spark, corpus.where("doc_id < 0"))
    assert m.chosen().count() == 0
    assert {r["actual_share"] for r in m.shares().collect()} == {0.0}


def test_too_many_common_words_are_refused(spark, corpus):
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    words = spark.range(100_001).selectExpr("'en' AS lang", "concat('w', id) AS word")
    with pytest.raises(ValueError):
        Mix(corpus, targets, words, VOCABULARY)
