from pyspark.sql import functions as F

from semantide.functions import ctext
from semantide.operators import answering, sampling

C = "int f(int a) {\n  for (i = 0; i < 3; i++) { g(i); }\n  while (a) { h(); f(a); }\n  do { k(); } while (b);\n  return sizeof(x);\n}\nstatic char *g(void)\n{ }\n"


def test_c_by_patterns(spark):
    df = spark.createDataFrame([("p", C), ("q", None), ("r", ""), ("s", "int f() { open")], "program string, code string")
    got = {(r["program"], r["name"]): r["calls"] for r in ctext.c_functions(df).collect()}
    assert got == {("p", "f"): ["g", "h", "k"], ("p", "g"): [], ("s", "f"): []}
    loops = [tuple(r) for r in df.where("program = 'p'").select(F.inline(ctext.c_loops(F.col("code")))).collect()]
    assert loops == [(0, "for", "i < 3"), (1, "while", "a"), (2, "while", "b"), (3, "do", "do-while")]
    texts = spark.createDataFrame([("Loop #1: Backedge taken count is 5\nLoop #2: x Backedge count is unknown\nLoop #1: Backedge count is 7", "Node 3 dominates: 4, 5\nNode 4 dominates: 5")], "a string, b string")
    row = texts.select(ctext.trip_counts(F.col("a")).alias("t"), ctext.dominated(F.col("b")).alias("d")).first()
    assert row["t"] == {1: 7, 2: None} and row["d"] == {3: [4, 5], 4: [5]}


def test_asking_and_replaying(spark):
    def responder(model, prompt):
        if prompt == "boom":
            raise RuntimeError("down")
        return f"Answer: {prompt}", '{"prompt_tokens": 3, "completion_tokens_details": {"reasoning_tokens": 2}}'

    tasks = spark.createDataFrame([(1, "yes", True), (2, "no", True), (3, "boom", True), (4, None, False), (5, "hm", False)], "id int, prompt string, ground_truth boolean")
    rows = {r["id"]: r for r in answering.ask(tasks, "m", responder).collect()}
    assert rows[1]["correct"] and rows[1]["usage"]["input"] == 3 and rows[1]["usage"]["reasoning"] == 2 and rows[1]["usage"]["output"] == 0
    assert rows[2]["first_response_correct"] is False and rows[5]["first_response_correct"] is None and rows[5]["correct"] is False and rows[5]["final_answer"] == "no"
    assert rows[3]["error"] == "RuntimeError: down" and rows[3]["correct"] is None and rows[4]["error"] == "ValueError: no prompt"
    recorded = spark.createDataFrame([("yes", "answer: yes")], "prompt string, answer string")
    again = {r["id"]: r for r in answering.replay(tasks, recorded, ["prompt"]).collect()}
    assert again[1]["correct"] and again[2]["error"] == "no recorded answer"


def test_long_rows_are_kept_and_the_rest_filled(spark):
    rows = [(f"p{k:02}", "big" if k < 4 else "ab"[k % 2], f"g{k % 3}", float(k), k < 4) for k in range(30)]
    df = spark.createDataFrame(rows, "id string, bin string, grp string, x double, is_long boolean")
    got = sampling.keep_long_then_fill(df, "bin", F.col("is_long"), {"a": 0.5, "b": 0.5}, ["x"], "id", "grp", "x", 10).collect()
    assert len(got) == 10 and sum(r["bin"] == "big" for r in got) == 4 and sum(r["bin"] == "a" for r in got) == 3
    assert sampling.keep_long_then_fill(df, "bin", F.col("is_long"), {"a": 1.0}, ["x"], "id", "grp", "x", 3).count() == 3
