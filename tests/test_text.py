import random

from pyspark.sql import functions as F

from semantide.functions import text as X
from semantide.functions.verdict import verdict

TEXTS = ["", "\n", "a", "a\n", "a\r\nb\r\n", "a\x0cb\x85c\u2028d", " \n\t\n x \n# c\n  # d\n", None, "x" * 100_000, "\n" * 5000]


def one(spark, rows, expression, name="t"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, {name} string").orderBy("i").select(expression).collect()]


def test_lines_are_those_of_splitlines(spark):
    got = one(spark, TEXTS, X.lines(F.col("t")))
    assert got == [None if t is None else t.splitlines() for t in TEXTS]


def test_counts(spark):
    assert one(spark, TEXTS, X.line_count(F.col("t"))) == [None if t is None else len(t.splitlines()) for t in TEXTS]
    assert one(spark, TEXTS, X.non_blank_count(F.col("t"))) == [None if t is None else sum(bool(x.strip()) for x in t.splitlines()) for t in TEXTS]
    assert one(spark, TEXTS, X.python_comment_count(F.col("t"))) == [None if t is None else sum(x.strip().startswith("#") for x in t.splitlines()) for t in TEXTS]


def strip_slowly(code):
    """Character by character."""
    out, state, k = [], "", 0
    while k < len(code):
        two, c = code[k : k + 2], code[k]
        if not state:
            if two in ("//", "/*"):
                state, k = two, k + 2
                continue
            if c in "\"'":
                state = c
            out.append(c)
        elif state == "//":
            if c == "\n":
                state = ""
                out.append(c)
        elif state == "/*":
            if two == "*/":
                state, k = "", k + 2
                continue
            if c == "\n":
                out.append(c)
        else:
            out.append(c)
            if c == "\\" and k + 1 < len(code):
                out.append(code[k + 1])
                k += 2
                continue
            if c == state:
                state = ""
        k += 1
    return "".join(out)


def test_comment_stripper_agrees_with_a_state_machine(spark):
    rng = random.Random(11)
    samples = ["".join(rng.choice(["/", "*", '"', "'", "\\", "\n", "a", " ", "//", "/*", "*/"]) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    samples += ['printf("/* no */"); /* yes */ x // z\n', "/* open", "a /* b\nc */ d", "", "x" * 50_000 + "/*" + "y" * 50_000 + "*/"]
    assert one(spark, samples, X.strip_c_comments(F.col("t"))) == [strip_slowly(s) for s in samples]


def test_bins_numbers_and_names(spark):
    values = [0, 50, 51, 200, 201, 2000, 2001, None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, n int").orderBy("i").select(X.loc_bin(F.col("n"))).collect()]
    assert got == ["<=50", "<=50", "51-100", "101-200", "201-500", "1001-2000", ">2000", None]
    assert one(spark, ["3", "4.9", "x", "", None, "1e3"], X.lenient_int(F.col("t"))) == [3, 4, 0, 0, 0, 1000]
    assert one(spark, ["YES", " 1 ", "no", None], X.truthy(F.col("t"))) == [True, True, False, False]
    names = ["a/b/c.tar.gz", "x.py", ".hidden", "none", None]
    assert one(spark, names, X.stem(F.col("t"))) == ["c.tar", "x", ".hidden", "none", None]
    assert one(spark, names, X.extension(F.col("t"))) == [".gz", ".py", "", "", None]
    assert one(spark, ["/r/a/b", "/q/a", None], X.relative_path(F.col("t"), "/r")) == ["a/b", "/q/a", None]
    assert one(spark, ["static int foo(int a) {", "x", None], X.header_function(F.col("t"))) == ["foo", "", None]
    assert one(spark, ["a\n\n b \nc\nd\ne\nf\ng"], X.error_digest(F.col("t"))) == ["a | b | c | d | e | f"]
    assert one(spark, ["a\nb"], X.numbered(F.col("t"))) == ["1: a\n2: b"]


def test_verdicts(spark):
    cases = [
        ("[Final answer: yes]", True), ("text\nAnswer: NO", False), ("Answer: yes\nAnswer: no", False), ("Final answer: yes [Final answer: yes] [Final answer: yes]", None), ("answer: yes or no", None),
        ("answer: not sure", False), ("maybe", None), ("", None), (None, None), ("Answer : **yes**.", True), ("Answer: yes\r\nthanks", True), ("answer:\u00a0yes", True), ("answer: yes answer: no", None), ("Answer: Yes, answer: NO", None),
        ("x\n" * 20_000 + "answer: yes", True),
    ]
    assert one(spark, [c for c, _ in cases], verdict(F.col("t"))) == [v for _, v in cases]
