import json

import pytest
from pyspark.sql import functions as F

from semantide.sources import readers, writers
from semantide.streaming import scoring


def test_programs_and_stems(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.py").write_bytes(b"one\n")
    (tmp_path / "x.py").write_bytes("zwei é\n".encode("latin-1"))
    (tmp_path / "noext").write_text("x")
    rows = readers.programs(spark, str(tmp_path))
    assert {r["file_name"] for r in rows.collect()} == {"x.py", "noext"} and rows.count() == 3
    assert readers.programs(spark, str(tmp_path), "*.py").where(F.col("code").contains("�")).count() == 1
    assert readers.programs(spark, str(tmp_path), errors="strict").where("code IS NULL").count() == 1
    assert readers.first_by_stem(rows).count() == 2
    assert readers.suffix_or_none(rows, ".py").count() == 3 and readers.suffix_or_none(rows, ".c").count() == 1


def test_json_lines_by_model_directory(spark, tmp_path):
    d = tmp_path / "m1"
    d.mkdir()
    (d / "r.jsonl").write_text(json.dumps({"log_id": 1, "program": "p", "category": "liveness"}) + "\n\n  \n" + json.dumps({"category": "x", "error": "e"}) + "\n")
    rows = readers.json_lines(spark, str(tmp_path)).orderBy("log_id").collect()
    assert [(r["model"], r["category"], r["error"]) for r in rows] == [("m1", "x", "e"), ("m1", "liveness", None)]
    (d / "bad.jsonl").write_text("{not json}\n")
    with pytest.raises(Exception, match="malformed line"):
        readers.json_lines(spark, str(tmp_path)).collect()


def test_json_documents_and_csv(spark, tmp_path):
    (tmp_path / "p.json").write_text('{\n "a": 1\n}')
    assert [tuple(r) for r in readers.json_documents(spark, str(tmp_path / "*.json"), "a int").collect()] == [(1, "p")]
    (tmp_path / "t.csv").write_text('id,code\n1,"a\n""b"""\n2,\n')
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path / "t.csv"), "id int, code string").collect()] == [(1, 'a\n"b"'), (2, None)]


def test_logs_dumps_and_summaries(spark):
    log = spark.createDataFrame([(1, "parsed: a/x.py"), (2, "incomplete: x.py: boom"), (3, "noise"), (4, None)], "line_no int, value string")
    assert [tuple(r) for r in readers.status_log(log).collect()] == [("x.py", "incomplete", "boom")]
    dump = "int f(int a) {\n\n [B2 (ENTRY)]\n   Succs (1): B1\n\n [B1]\n   1: x\n   Preds (1): B2\n   Succs (1): B0\nvoid g()\n [B1 (ENTRY)]\n   Succs (1): B0\n"
    sections = readers.dump_sections(spark.createDataFrame([("p", dump), ("q", None), ("r", "")], "program string, text string"), "program", "text")
    assert {(r["section"], r["header"], r["function"]) for r in sections.collect()} == {(1, "int f(int a) {", "f"), (2, "void g()", "g")}
    blocks = {(r["function"], r["block"]): (r["kind"], r["preds"], r["succs"]) for r in readers.cfg_blocks(sections, "program").collect()}
    assert blocks[("f", 2)] == ("ENTRY", [], [1]) and blocks[("f", 1)][1:] == ([2], [0]) and blocks[("g", 1)][2] == [0]
    df = spark.createDataFrame([("x\nsummary: 100 1 2 30 4 5 6 7 8\n",), ("none",), (None,)], "t string")
    got = df.select(*readers.cache_summary(F.col("t"))).collect()
    assert got[0]["instruction_count"] == 100 and got[0]["DLmw"] == 8 and got[1]["Dr"] is None and got[2]["Dr"] is None


def test_ir(spark):
    ir = "define i32 @f(i32 %x) {\n  br i1 %c, label %a, label %b, !dbg !7\na:\n  br label %b, !dbg !8\nb:\n  ret i32 0, !dbg !8\n}\n!7 = !DILocation(line: 3)\n!8 = !DILocation(line: 4)\n"
    df = spark.createDataFrame([("p", ir), ("q", None)], "program string, ir string")
    assert {(r["function"], r["src"], r["dst"]) for r in readers.ir_edges(df, "program", "ir").collect()} == {("f", "entry", "a"), ("f", "entry", "b"), ("f", "a", "b")}
    assert {(r["line"], r["block"]) for r in readers.ir_line_blocks(df, "program", "ir").collect()} == {(4, "a")}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "parsed"), (2, None, "incomplete")], "z int, b string, status string")
    writers.write_json(df, str(tmp_path / "j"), ["status"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert writers.ordered_columns(df, ["status"]).columns == ["status", "b", "z"]
    writers.write_csv(df, str(tmp_path / "c"), ["z"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["z", "b", "status"]
    writers.write_routed(df, str(tmp_path / "r"))
    assert (tmp_path / "r/status=incomplete").exists()
    f = "file_name string, code string"
    here, there = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], f), spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], f)
    wanted = spark.createDataFrame([(x,) for x in "abcde"], "file_name string")
    assert {tuple(r) for r in writers.move_plan(wanted, here, there).collect()} == {("a", "move"), ("b", "deduplicate"), ("c", "conflict"), ("d", "already"), ("e", "missing")}
    assert r"a\_b & 1,234 \\" in writers.latex_table([("a_b", 1234)], ("x", "n"), "t")


def test_streamed_scores_are_those_of_a_batch(spark, tmp_path):
    rows = [(k, "m", "p", "deadcode", k % 2 == 0, f"2025-01-0{1 + k % 3} 10:00:00", "answer: yes" if k % 3 else "no idea") for k in range(30)] + [(3, "m", "p", "deadcode", False, "2025-01-01 10:00:00", "answer: no")] * 0
    df = spark.createDataFrame(rows, "log_id long, model string, program string, category string, ground_truth boolean, logged_at string, a string").selectExpr(
        "log_id", "model", "program", "category", "ground_truth", "cast(logged_at as timestamp) logged_at", "array(named_struct('role', 'assistant', 'response', named_struct('generated_texts', array(a)), 'parsed_decisions', cast(null as boolean))) conversation"
    )
    df.repartition(3).write.json(str(tmp_path / "in"))
    out = []
    stream = scoring.score(scoring.result_stream(spark, str(tmp_path / "in")))
    scoring.run(stream, str(tmp_path / "check"), lambda batch, n: out.extend(batch.select("log_id", "category", "verdict", "scored").collect()))
    batch = {(r["log_id"], r["category"], r["verdict"], r["scored"]) for r in scoring.score(df).collect()}
    assert {tuple(r) for r in out} == batch and len(out) == 30
    windowed = scoring.windowed_accuracy(scoring.result_stream(spark, str(tmp_path / "in")))
    query = windowed.writeStream.format("memory").queryName("acc").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("acc").columns == ["window", "model", "category", "n", "n_correct", "n_null"]
