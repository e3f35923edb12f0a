import random

import pytest
from pyspark.sql import functions as F

from semantide.functions import ctext
from semantide.operators import analysis, dataflow, labels, ranges, sampling, scoring
from semantide.sources import readers, writers


def greedily(rows, seats, used=()):
    """The choice as it is defined: one row at a time."""
    used, left, out = {u or "" for u in used}, list(rows), []
    while left and len(out) < seats:
        best = max(left, key=lambda r: ((r[1] or "") not in used, r[2] is not None, r[2] or 0, r[0]))
        left.remove(best)
        used.add(best[1] or "")
        out.append(best[0])
    return out


def test_greedy_choice_is_that_of_one_step_at_a_time(spark):
    rng = random.Random(1)
    rows = [(f"n{k}", rng.choice(["a", "b", "c", None, ""]), rng.choice([None, 1, 2, 3])) for k in range(25)]
    df = spark.createDataFrame(rows, "name string, problem string, score int")
    for seats in (0, 3, 10, 40):
        for used in ((), ("a", None)):
            given = spark.createDataFrame([(u,) for u in used], "problem string") if used else None
            got = sampling.greedy_select(df, "problem", ["score"], "name", seats, given)
            assert [r["name"] for r in got.orderBy("place").collect()] == greedily(rows, seats, used)
    assert sampling.greedy_select(df.where("score > 9"), "problem", ["score"], "name", 5).count() == 0


def test_stages_fill_in_order_and_say_when_they_can_not(spark):
    rows = [(f"r{k}", f"p{k % 3}", k, True, "small") for k in range(4)] + [(f"s{k}", f"p{k}", k, False, "small") for k in range(6)] + [(f"l{k}", f"q{k}", k, None, "large") for k in range(6)]
    df = spark.createDataFrame(rows, "name string, problem string, score int, reliable boolean, bucket string")
    out = sampling.staged_select(df, "problem", ["score"], "name", "reliable", "bucket", {"small": 6, "large": 3}, 12).collect()
    stages = {s: {r["name"] for r in out if r["stage"] == s} for s in ("reliable", "small", "large", "rest")}
    assert stages["reliable"] == {"r0", "r1", "r2", "r3"} and stages["small"] == {"s5", "s4"} and stages["large"] == {"l5", "l4", "l3"} and len(stages["rest"]) == 3
    with pytest.raises(ValueError):
        sampling.staged_select(df, "problem", ["score"], "name", "reliable", "bucket", {"small": 1}, 50)


def test_joins_that_must_find_a_partner(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert scoring.required_join(left.where("k = 1"), right, ["k"], ["v"]).collect()[0]["v"] == "a"
    for bad in (left, left.withColumn("k", F.col("k") + 5)):
        with pytest.raises(Exception, match="no v for"):
            scoring.required_join(bad, right, ["k"], ["v"]).collect()
    assert [r["k"] for r in scoring.in_order(right, "k", [2, 1]).collect()] == [2, 1]
    with pytest.raises(Exception, match="no _there for 3"):
        scoring.in_order(right, "k", [1, 3]).collect()
    names = spark.createDataFrame([("x", "X"), ("y", "Y"), ("z", "Z")], "model string, final_model string")
    results = spark.createDataFrame([("x", 1.0), ("y", None), ("w", 2.0)], "model string, acc double")
    final = spark.createDataFrame([("X", 5.0), ("Y", 6.0), ("Z", 7.0)], "model string, score double")
    assert [tuple(r) for r in scoring.through_names(results, names, final, "acc", "score").collect()] == [("x", "X", 1.0, 5.0)]


def test_numbers_and_positions_of_hot_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), rng.choice([None, *range(40)]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {r["i"]: r["number"] for r in ranges.row_numbers(df, ["g"], ["v", "i"]).collect()}
    for g in ("hot", "a", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
    at = ranges.positions(df, ["g"], "v").collect()
    for g in ("hot", "a", None):
        values = sorted(r[1] for r in rows if r[0] == g and r[1] is not None)
        assert sorted((r["v"], r["_from"], r["_to"], r["_n"]) for r in at if r["g"] == g) == sorted((v, values.index(v), values.index(v) + values.count(v), len(values)) for v in set(values))
    assert ranges.row_numbers(df.where("i < 0"), ["g"], ["v"]).count() == 0


def test_what_a_record_has(spark):
    full = "def f(a):\n    b = a + 1\n    while True:\n        b = b - 1\n        if b < 0:\n            break\n    return b\n    c = 3\n\ndef g(x):\n    return f(x)\n"
    df = spark.createDataFrame([("full", full), ("bare", "x = 1\n"), ("broken", "x = (")], "program string, code string")
    out = {r["program"]: r for r in analysis.presence(analysis.analyse(df)).collect()}
    assert out["full"]["all_six"] and not out["bare"]["all_six"] and not out["broken"]["all_six"]
    assert out["full"]["score"] > out["bare"]["score"] > out["broken"]["score"] == 0


C = """#include <stdio.h>
/* x = 9; */
static int twice(int a) { int r = a * 2; return r; }
int main(void) {
  int n = 1, m[3];
  for (int i = 0; i < n; i++) {
    n += twice(i);   // n = 7
  }
  m[0] = n;
  while (1) { printf("%d = %d", n, m[0]); break; }
  p->len = n;
  return n;
}
static int idle(void) { while (0) { } return 0; }
"""


def test_definitions_and_uses_of_c(spark):
    df = spark.createDataFrame([("p", C), ("none", None), ("empty", "")], "program string, code string")
    steps = ctext.c_steps(df)
    found = {(r["function"], r["var"], r["line"]): (r["is_def"], r["is_use"]) for r in steps.collect()}
    assert found["twice", "r", 3] == (True, False) or found["twice", "r", 3] == (False, True)
    assert found["main", "n", 7] == (True, True) and found["main", "m", 9][0] and found["main", "n", 9] == (False, True)
    assert ("main", "x", 2) not in found and ("main", "len", 11) not in found and not any(v == "printf" for _, v, _ in found)
    pairs = {(r["function"], r["var"], r["def_line"], r["use_line"]) for r in dataflow.direct_def_use(steps, ["program", "function"]).collect()}
    assert {("main", "n", 7, 9), ("main", "n", 7, 11), ("main", "n", 7, 12)} <= pairs
    assert ctext.c_steps(df.where("program = 'x'")).count() == 0


def test_questions_about_c(spark):
    df = spark.createDataFrame([("p", C)], "program string, code string")
    loops = df.select("program", F.inline(ctext.c_loops(F.col("code")))).withColumn("certainty", F.when(F.col("cond") == "1", "always_runs").when(F.col("cond") == "0", "never_runs"))
    use = dataflow.direct_def_use(ctext.c_steps(df), ["program", "function"])
    out = labels.c_questions(ctext.c_functions(df), loops, use, cap=3).collect()
    by = {c: [(r["question"], r["label"]) for r in out if r["category"] == c] for c in {r["category"] for r in out}}
    assert {q.count("main") for q, t in by["function_reachability"] if t} == {1} and len([1 for _, t in by["function_reachability"] if t]) == 1
    assert sorted(t for _, t in by["loop_reachability"]) == [False, False, True, True]
    assert any("idle" in q and t for q, t in by["dead_code"]) and not any("main" in q and t and "dead" in q for q, t in by["dead_code"])
    assert {t for _, t in by["data_dependency"]} == {True, False}


def test_files_that_scans_leave_out_and_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.py", b"x = 1\n"), ("b.py", b""), ("sub/c.py", b"\xff\xfeok"), ("d.c", b"")):
        (tmp_path / name).write_bytes(data)
    read = lambda **more: {r["file_name"]: r["code"] for r in readers.programs(spark, str(tmp_path), "*.py", **more).collect()}
    assert read() == {"a.py": "x = 1\n", "b.py": "", "c.py": "��ok"}
    assert read(errors="ignore") == {"a.py": "x = 1\n", "b.py": "", "c.py": "ok"}
    assert read(errors="strict") == {"a.py": "x = 1\n", "b.py": "", "c.py": None}
    assert set(read(recursive=False)) == {"a.py", "b.py"}
    n = writers.write_files(spark.createDataFrame([("x/y.txt", "é\n"), ("z.txt", ""), (None, "a"), ("w", None)], "name string, body string"), str(tmp_path / "out"), "name", "body")
    assert n == 2 and (tmp_path / "out/x/y.txt").read_text() == "é\n"


def test_malformed_lines_tell_where_they_are(spark, tmp_path):
    folder = tmp_path / "model-a"
    folder.mkdir()
    (folder / "r.jsonl").write_text('{"category": "x"}\n\n{"category": \n')
    with pytest.raises(Exception, match=r"r\.jsonl:3"):
        readers.json_lines(spark, str(tmp_path), "category string", numbered=True).collect()
    (folder / "r.jsonl").write_text('{"category": "x"}\n\n')
    assert [r["model"] for r in readers.json_lines(spark, str(tmp_path), "category string").collect()] == ["model-a"]


def test_lists_statuses_and_report_lines(spark):
    df = spark.createDataFrame([("a",), ("a.c",), (" b ",), ("",), (None,)], "program string")
    assert {r[0] for r in readers.program_list(df).collect()} == {"a.c", "b.c"}
    out = readers.dump_status(spark.createDataFrame([(1, "x\n"), (2, " \n"), (3, None), (4, "a.c: fatal error: no\n"), (5, "no error: none")], "k int, t string"), "k", "t")
    assert {r["k"]: r["status"] for r in out.collect()} == {1: "OK", 2: "EMPTY", 3: "EMPTY", 4: "STAT_ERROR", 5: "OK"}
    assert writers.report_line("n", 12345) == "n: 12,345" and writers.report_line("m", 1 / 3, 4) == "m: 0.3333"
