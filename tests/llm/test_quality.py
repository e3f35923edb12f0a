import random

from semantide.llm.quality import quality

PROSE = (
    "The loop in this function reads the list and then it stops. That is why the test was not run twice, and we have to look at it again. "
    "If you change the order of the two calls, the result will be the same, but the time is not. There is more to say about this in the notes."
)


def run(spark, rows):
    words = [("en", w) for w in "the of and to in is that it was for not with as on be at by this have are but if you we will there more in then again has do or an".split()] + [("de", w) for w in "der die das und ist nicht ein".split()]
    df = spark.createDataFrame(rows, "k long, text string, id string")
    return {r["id"]: r for r in quality(df, "k", "text", spark.createDataFrame(words, "lang string, word string")).collect()}


def test_prose_and_the_rest(spark):
    rng = random.Random(1)
    table = "\n".join(f"| row{k} | {rng.randint(1, 99)} | yes | {rng.random():.2f} |" for k in range(20))
    csv = "name,size,ok\n" + "\n".join(f"f{k},{k * 7},no" for k in range(20))
    cols = "\n".join(f"{'item%d' % k:<20}{k * 13:<10}{k % 3}" for k in range(15))
    bullets = "Contents\n" + "\n".join(f"- part {k}" for k in range(20))
    nested = "\n".join(f"{chr(97 + k)}) branch\n   i) left_{k}" for k in range(10))
    junk = "".join(rng.choice("#%&{}[]<>|~^") for _ in range(300))
    code = "```\n" + "\n".join(f"    x{k} = f({k})" for k in range(6)) + "\n```"
    rows = [(1, PROSE), (2, table), (3, csv), (4, cols), (5, bullets), (6, nested), (7, junk), (8, PROSE + "\n\n" + code + "\n\n" + PROSE), (9, PROSE + "\n- one\n- two\n- three\n" + PROSE), (10, "# Heading\n\n" + PROSE), (11, PROSE[:60] + "\n" + csv), (12, None), (13, ""), (14, "word " * 3000), (15, (PROSE + "\n") * 2000)]
    out = run(spark, [(k, t, "c") for k, t in rows])
    assert {k for k, r in out.items() if r["prose"]} == {1, 8, 9, 10, 15}
    assert out[2]["layout"] == out[3]["layout"] == out[4]["layout"] == "table"
    assert out[5]["layout"] == out[6]["layout"] == "list"
    assert out[12]["n_words"] is None and out[13]["n_words"] == 0 and out[13]["mean_word_length"] is None


def test_statistics(spark):
    r = run(spark, [(1, "The cat_1 sat.\nAnd it!", "x")])[1]
    assert (r["n_words"], r["closed_line_share"], r["common_share"]) == (5, 1.0, 0.6)
    assert abs(r["mean_word_length"] - (3 + 5 + 3 + 3 + 2) / 5) < 1e-9
    assert abs(r["symbol_ratio"] - 3 / 18) < 1e-9


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_line_lengths_that_come_back_are_a_list_by_themselves():
    from semantide.llm import quality as q

    judge = q.Judge({"en": {"the", "of", "in", "and", "to", "a"}})
    records = "\n".join(f"the house of {x} in the {y}\nto {z}" for x, y, z in zip("stone wood glass brick straw clay marble".split(), "north south east west hills fields woods".split(), "ann bob cid dan eve fay gus".split()))
    assert judge(records)[9] is False and judge(records)[7] == "list"
    assert judge(records)[6] > q.ECHO
    # The same words without the rhythm, and with sentences that end, are prose.
    words = records.split()
    uneven, at = [], 0
    for n in (7, 2, 5, 3, 7, 6, 1, 4, 7, 5, 2, 6, 4, 3):
        uneven.append(" ".join(words[at : at + n]))
        at += n
    assert judge("\n".join(uneven))[6] < q.ECHO and judge("\n".join(uneven))[9] is True
    assert judge(records.replace("\n", ".\n"))[9] is True
