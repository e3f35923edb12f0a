import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semantide.plans import connectors
from semantide.sources import readers


def test_reading_files_takes_no_task_for_every_few_of_them(spark, tmp_path):
    for k in range(600):
        (tmp_path / f"d{k % 300}").mkdir(exist_ok=True)
        (tmp_path / f"d{k % 300}/{k}.py").write_text(f"x = {k}\n" if k % 7 else "")
    rows = readers.programs(spark, str(tmp_path), "*.py")
    assert {r["file_name"]: r["code"] for r in rows.collect()} == {f"{k}.py": f"x = {k}\n" if k % 7 else "" for k in range(600)}
    assert rows.rdd.getNumPartitions() == 8


def test_a_task_holds_few_files_at_a_time(tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "READ_BYTES", 300)
    for k in range(10):
        (tmp_path / f"{k}").write_bytes(b"x" * 100 * k)
    wanted = pa.RecordBatch.from_pydict({"path": [os.fsencode(tmp_path / f"{k}") for k in range(10)]})
    got = [b.to_pydict() for b in readers._read_files(iter([wanted, wanted]))]
    assert [c for b in got for c in b["content"]] == [b"x" * 100 * k for k in range(10)] * 2 and len(got) > 10
    assert [p for b in got for p in b["path"]] == [f"file:{tmp_path}/{k}" for k in range(10)] * 2


def test_files_in_folders_of_any_depth_and_of_any_name(spark, tmp_path):
    deep = tmp_path / "a/b b/é%20/_d"
    deep.mkdir(parents=True)
    for at in (tmp_path, deep):
        for name in ("__init__.py", ".x.py", "x.pyc", "y z.py", "ü.py"):
            (at / name).write_text(name * 9)
    (tmp_path / "folder.py").mkdir()
    (tmp_path / "none.py").symlink_to("nowhere")
    names = {"__init__.py", ".x.py", "y z.py", "ü.py"}
    rows = readers.programs(spark, str(tmp_path), "*.py").collect()
    assert {r["path"] for r in rows} == {f"file:{at}/{name}" for at in (tmp_path, deep) for name in names} and len(rows) == 8
    assert all(r["code"] == r["file_name"] * 9 for r in rows)
    assert {r["path"] for r in readers.programs(spark, f"file://{tmp_path}", "*.py", recursive=False).collect()} == {f"file:{tmp_path}/{name}" for name in names}
    assert [r["file_name"] for r in readers.programs(spark, str(tmp_path / "a/*/*/_d/[y]*"), "*.{c,py}").collect()] == ["y z.py"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.programs(spark, os.path.join(tmp_path, "missing"))


def test_a_tree_of_programs_has_no_folder_for_each(spark, tmp_path):
    rows = [(k, f"p{k}", f"p{k}.c", "C" if k % 2 else None, f"int a{k};") for k in range(700)]
    spark.createDataFrame(rows, "unique_id long, program string, file_name string, language string, code string").write.parquet(f"{tmp_path}/code.parquet")
    tree = connectors._tree(spark, str(tmp_path))
    assert sum(len(files) for _, _, files in os.walk(tree)) == 700 and sum(len(folders) for _, folders, _ in os.walk(tree)) <= 256
    assert {tuple(r)[:3] for r in connectors.suffix_scan(spark, str(tmp_path)).collect()} == {(k, f"p{k}", len(f"int a{k};")) for k in range(0, 700, 2)}


def test_trees_of_programs_with_negative_ids_and_without_names(spark, tmp_path):
    rows = [(-7, "p", "p.c", "C", "int a;"), (8, "q", "q.c", "C", ""), (9, "-1-r", "-1-r.c", "c", "é"), (10, "s", None, "C", "x"), (11, None, "t.c", None, "x"), (12, "u.c", "u.c", None, "\r\n"), (13, "v", "", "C", "v"), (14, "w", "w.c", "C", None)]
    spark.createDataFrame(rows, "unique_id long, program string, file_name string, language string, code string").write.parquet(f"{tmp_path}/code.parquet")
    views = duckdb.connect()
    views.execute(f"CREATE VIEW code AS SELECT * FROM read_parquet('{tmp_path}/code.parquet/*.parquet')")
    for name in ("tree_of_c_files", "suffix_scan"):
        query = f"SELECT unique_id, file_name, n_chars, digest FROM ({connectors.REGISTRY.sql[name]})"
        assert {tuple(r) for r in connectors.REGISTRY.queries[name](spark, str(tmp_path)).collect()} == set(views.execute(query).fetchall())


def test_one_folder_holds_programs_that_share_a_name_or_none_at_all(spark, tmp_path):
    rows = [(1, "a", "a.py", "x"), (2, "a", "a.py", "y"), (3, "__init__", "__init__.py", ""), (4, "b", "b.c", "z"), (5, "c", None, "c"), (6, "d", "d.py", None)]
    df = spark.createDataFrame(rows, "unique_id long, program string, file_name string, code string").withColumn("language", F.lit("python"))
    for sf, part, n in ((f"{tmp_path}/some", df, 3), (f"{tmp_path}/none", df.limit(0), 0)):
        part.write.parquet(f"{sf}/code.parquet")
        views = duckdb.connect()
        views.execute(f"CREATE VIEW code AS SELECT * FROM read_parquet('{sf}/code.parquet/*.parquet')")
        got = [tuple(r) for r in connectors.flat_python_files(spark, sf).collect()]
        assert sorted(got) == sorted(views.execute(connectors.REGISTRY.sql["flat_python_files"]).fetchall()) and len(got) == n
        assert n or not connectors.tree_of_c_files(spark, sf).collect()
