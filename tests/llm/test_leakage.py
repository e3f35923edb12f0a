import random

from semantide.llm import leakage
from semantide.llm.leakage import leaks, quick_words, words_of

ITEM = " ".join(f"word{k}" for k in range(60))


def run(spark, docs, items=((7, ITEM, "yes"),)):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(list(items), "item_id long, text string, answer string")
    return {(r["doc"], r["item"]): r for r in leaks(d, "doc_id", "text", i, "item_id", "text", "answer").collect()}


def part(a, b):
    return " ".join(ITEM.split()[a:b])


def test_parts_changes_and_asides(spark):
    rng = random.Random(4)
    swapped = ITEM.split()
    for k in range(5, 60, 11):
        swapped[k] = "other"
    aside = " ".join([*ITEM.split()[:9], "(which,", "by", "the", "way,", "nobody", "has", "read)", *ITEM.split()[9:20]])
    docs = [
        (1, f"Before. {part(10, 25)} and after."),
        (2, f"Before. {part(10, 24)} and after."),
        (3, " ".join(swapped)),
        (4, aside),
        (5, ITEM.upper().replace(" ", ",\n> ")),
        (6, "<b>" + ITEM.replace(" ", " <i>&nbsp;</i> ") + "</b>"),
        (7, " ".join(rng.sample(ITEM.split(), 60))),
        (8, None),
        (9, ""),
        (10, " ".join(w if k % 4 else "x" for k, w in enumerate(ITEM.split()))),
        (11, "filler " * 50_000 + part(30, 50)),
    ]
    assert {d for d, _ in run(spark, docs)} == {1, 3, 4, 5, 6, 11}


def test_replaced_words_count_over_the_whole_passage(spark):
    def swapped(a, b, *at):
        return " ".join("other" if k in at else w for k, w in enumerate(ITEM.split()[a:b], 0))

    docs = [
        (1, swapped(0, 20, 7, 13)),  # two in twenty
        (2, swapped(0, 19, 5, 13)),  # two in nineteen
        (3, swapped(0, 30, 7, 14, 22)),  # three in thirty
        (4, swapped(0, 29, 7, 14, 21)),  # three in twenty-nine; words 8 to 29 have two
        (5, swapped(0, 21, 5, 10, 15)),  # three in twenty-one
        (6, "some words (" + swapped(0, 20, 4, 15).replace("word9", "word9 by the way") + ") after"),  # and an aside
    ]
    got = {d: r["words"] for (d, _), r in run(spark, docs).items()}
    assert got == {1: 20, 3: 30, 4: 21, 6: 20}


def test_offsets_point_into_the_original(spark):
    text = f"Ça va? <p>{part(0, 30)}</p> end"
    row = run(spark, [(1, text)])[(1, 7)]
    assert text[row["start"] : row["stop"]] == part(0, 30)
    assert row["words"] == 30


def test_short_items_match_as_a_whole_and_empty_sides_give_nothing(spark):
    items = [(1, "alpha beta gamma delta", "no"), (2, None, None), (3, "", "")]
    assert set(run(spark, [(5, "see alpha beta gamma delta no more"), (6, "alpha beta gamma")], items)) == {(5, 1)}
    assert run(spark, [], items) == {}
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string, answer string")
    assert leaks(d, "doc_id", "text", none, "item_id", "text", "answer").count() == 0


def test_the_short_way_to_words_is_the_long_one(spark):
    rng = random.Random(9)
    for _ in range(500):
        t = "".join(rng.choice("abZ9_' .,-\n<&\\é") for _ in range(30))
        assert quick_words(t) == words_of(t)[0], t
    assert quick_words("It's load_value, _so_ OK") == words_of("It's load_value, _so_ OK")[0]


def test_asides_of_any_length(spark):
    docs = [(n, f"{part(0, 8)} {' '.join('filler' for _ in range(n))} {part(8, 16)}") for n in (30, 40, 41, 60, 5000)]
    docs += [(9, f"{part(0, 8)} {'filler ' * 300} {part(8, 10)} nothing"), (10, f"{part(0, 14)} {'filler ' * 300} {part(14, 15)}"), (11, f"{part(8, 16)} {'filler ' * 300} {part(0, 8)}")]
    docs += [(12, f"{part(0, 4)} {'filler ' * 90} {part(4, 8)} {'filler ' * 90} {part(8, 20)}")]
    assert {d: r["words"] for (d, _), r in run(spark, docs).items()} == {30: 16, 40: 16, 41: 16, 60: 16, 5000: 16, 12: 16}


def test_a_short_question_without_its_answer(spark):
    question, answer = " ".join(f"q{k}" for k in range(13)), "a b c d e"
    docs = [(1, f"Asked: {question}?"), (2, f"{question} {answer}"), (3, question[:-4]), (4, answer), (5, question.replace("q5", "other")), (6, "q5 and " + question[3:])]
    assert {d for d, _ in run(spark, docs, [(1, question, answer)])} == {1, 2, 5}


def test_items_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 20)
    items = [(k, " ".join(f"w{k}x{i}" for i in range(20)), "yes") for k in range(12)]
    docs = [(k, "see " + t) for k, t, _ in items] + [(100, "nothing")]
    assert set(run(spark, docs, items)) == {(k, k) for k in range(12)}
