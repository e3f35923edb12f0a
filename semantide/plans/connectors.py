"""Queries that write tables with each sink and read them again with each source."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semantide.functions import text as X
from semantide.plans import Registry
from semantide.sources import readers, writers
from semantide.sources.shared import own_dir
from semantide.sources.tables import table

REGISTRY = Registry()

#: Folders of a tree of files.
FOLDERS = 256


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{uuid.uuid4().hex}-{name}"


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """The programs as files in folders, the id before each name; a file of a program whose language is unknown has no suffix.

    A folder takes a block of the disk, more than most programs, so there are ``FOLDERS`` and not one a program.
    """
    code = table(spark, sf_dir, "code")
    name = F.concat(F.pmod("unique_id", F.lit(FOLDERS)).cast("string"), F.lit("/"), _marked(F.when(F.col("language").isNull(), F.col("program")).otherwise(F.col("file_name"))))
    path = _scratch(spark, "tree")
    writers.write_files(code.select(name.alias("name"), "code"), path, "name", "code")
    return path


def _marked(name: Column) -> Column:
    """A file's name with the id before it, null without name."""
    return F.concat(F.col("unique_id").cast("string"), F.lit("-"), name)


def _ids(df: DataFrame) -> DataFrame:
    """Files read back: the id before their name, their name, and what is in them."""
    marked = r"^(-?\d+)-"
    return df.select(
        F.regexp_extract("file_name", marked, 1).cast("bigint").alias("unique_id"), F.regexp_replace("file_name", marked, "").alias("file_name"), F.length("code").cast("bigint").alias("n_chars"), F.md5("code").alias("digest")
    )


_FILES = "(SELECT unique_id, CASE WHEN language IS NULL THEN program ELSE file_name END AS file_name, length(code) AS n_chars, md5(code) AS digest FROM code WHERE code IS NOT NULL)"


@REGISTRY.query("tree_of_c_files", f"SELECT * FROM {_FILES} WHERE file_name LIKE '%.c'")
def tree_of_c_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C files below a folder, found recursively and read whole."""
    return _ids(readers.programs(spark, _tree(spark, sf_dir), "*.c"))


@REGISTRY.query("suffix_scan", f"SELECT * FROM {_FILES} WHERE file_name LIKE '%.py' OR file_name NOT LIKE '%.%'")
def suffix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a suffix or without any."""
    return _ids(readers.suffix_or_none(readers.programs(spark, _tree(spark, sf_dir)), ".py"))


@REGISTRY.query("flat_python_files", "SELECT file_name, program, length(code) AS n_chars, md5(code) AS digest FROM code WHERE code IS NOT NULL AND file_name LIKE '%.py'")
def flat_python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python files of one folder; empty ones are among them, and programs that share a name."""
    path = _scratch(spark, "flat")
    writers.write_files(table(spark, sf_dir, "code").select(_marked(F.col("file_name")).alias("name"), "code"), path, "name", "code")
    found = _ids(readers.programs(spark, path, "*.py", recursive=False))
    return found.select("file_name", X.stem(F.col("file_name")).alias("program"), "n_chars", "digest")


@REGISTRY.query("first_by_stem", r"SELECT regexp_replace(regexp_extract(file, '[^/]*$'), '\.[^.]*$', '') AS program, min(file) AS path FROM parsed_code WHERE file IS NOT NULL GROUP BY 1")
def first_by_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each stem the first path in order."""
    files = table(spark, sf_dir, "parsed_code").where("file IS NOT NULL").select(X.stem(F.regexp_replace("file", "^.*/", "")).alias("program"), F.col("file").alias("path"))
    return readers.first_by_stem(files).select("program", "path").distinct()


@REGISTRY.query(
    "json_documents",
    "SELECT program, coalesce(len(map_keys(queries)), 0)::BIGINT AS categories, coalesce(list_sum(list_transform(map_values(queries), lambda x: coalesce(len(x), 0))), 0)::BIGINT AS questions FROM question_labels",
)
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document a program, written and read again."""
    path = _scratch(spark, "json")
    labels = table(spark, sf_dir, "question_labels")
    writers.write_files(labels.select(F.concat("program", F.lit(".json")).alias("name"), F.to_json(F.struct("queries", "ground_truth")).alias("doc")), path, "name", "doc")
    found = readers.json_documents(spark, path, "queries map<string, array<string>>, ground_truth map<string, array<boolean>>")
    n = F.aggregate(F.map_values("queries"), F.lit(0), lambda a, x: a + F.coalesce(F.when(x.isNotNull(), F.size(x)), F.lit(0)))
    return found.select("program", F.coalesce(F.when(F.col("queries").isNotNull(), F.size("queries")), F.lit(0)).cast("bigint").alias("categories"), F.coalesce(n, F.lit(0)).cast("bigint").alias("questions"))


@REGISTRY.query("json_lines_by_model", "SELECT log_id, model, program, category, correct, error, ground_truth, len(conversation) AS turns, len(prompt) AS prompt_chars FROM result_log")
def json_lines_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as JSON lines in a folder for each model, read again with the model from the folder."""
    path = _scratch(spark, "lines")
    log = table(spark, sf_dir, "result_log").drop("logged_at", "received_at")
    writers.write_json(log, path, ["model"])
    found = readers.json_lines(spark, path, readers.RESULT_FIELDS, required=())
    turns = F.when(F.col("conversation").isNotNull(), F.size("conversation")).cast("bigint")
    return found.select("log_id", "model", "program", "category", "correct", "error", "ground_truth", turns.alias("turns"), F.length("prompt").cast("bigint").alias("prompt_chars"))


@REGISTRY.query("csv_round_trip", "SELECT unique_id, file_name, repo_name, path, language, md5(code) AS digest FROM code")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The programs as CSV, preferred columns first, with line breaks, quotes and blanks kept."""
    path = _scratch(spark, "csv")
    code = table(spark, sf_dir, "code").select("code", "language", "path", "repo_name", "file_name", "unique_id")
    writers.write_csv(code, path, ["unique_id", "file_name"])
    back = readers.csv_table(spark, path, "unique_id bigint, file_name string, code string, language string, path string, repo_name string")
    return back.select("unique_id", "file_name", "repo_name", "path", "language", F.md5("code").alias("digest"))


@REGISTRY.query("tsv_errors", "SELECT log_id, model, program, error FROM result_log WHERE error IS NOT NULL")
def tsv_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures alone, sorted, separated by tabs."""
    path = _scratch(spark, "tsv")
    failed = table(spark, sf_dir, "result_log").where("error IS NOT NULL").select("log_id", "model", "program", "error").orderBy("log_id", "model", "program")
    writers.write_csv(failed, path, sep="\t")
    return spark.read.schema("log_id bigint, model string, program string, error string").csv(path, header=True, sep="\t", escape='"', multiLine=True)


@REGISTRY.query("routed_records", "SELECT CASE WHEN unsupported THEN 'incomplete' ELSE 'parsed' END AS status, program, len(functions) AS n_functions FROM parsed_code")
def routed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in folders by status."""
    path = _scratch(spark, "routed")
    records = table(spark, sf_dir, "parsed_code").withColumn("status", F.when(F.col("unsupported"), "incomplete").otherwise("parsed"))
    writers.write_routed(records.select("program", "functions", "status"), path)
    back = spark.read.schema("program string, functions array<struct<name string>>, status string").json(path)
    return back.select("status", "program", F.when(F.col("functions").isNotNull(), F.size("functions")).cast("bigint").alias("n_functions"))


@REGISTRY.query(
    "status_log",
    """SELECT program || '.py' AS file_name, max_by(CASE WHEN unsupported THEN 'incomplete' ELSE 'parsed' END, struct_pack(a := analysed_at, f := file)) AS status,
max_by(coalesce(len(functions), 0)::VARCHAR || ' functions', struct_pack(a := analysed_at, f := file)) AS message FROM parsed_code GROUP BY 1""",
)
def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of a log for each file."""
    p = table(spark, sf_dir, "parsed_code")
    n = F.coalesce(F.when(F.col("functions").isNotNull(), F.size("functions")), F.lit(0)).cast("string")
    line = F.concat(F.when(F.col("unsupported"), "incomplete").otherwise("parsed"), F.lit(": out/"), "program", F.lit(".py: "), n, F.lit(" functions"))
    return readers.status_log(p.select(line.alias("value"), F.struct("analysed_at", "file").alias("line_no")))


_FUNCTIONS = """parsed AS (SELECT program, max_by(functions, struct_pack(a := analysed_at, f := file)) AS functions FROM parsed_code GROUP BY program),
fns AS (SELECT program, row_number() OVER (PARTITION BY program) AS section, f FROM (SELECT program, unnest(functions) AS f FROM parsed))"""


def _dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts like an analyzer's: a section for each function, a block for each call."""
    from semantide.plans.programs import parsed_functions

    none = F.array().cast("array<string>")
    blocks = lambda f: F.transform(F.coalesce(f["calls"], none), lambda c, i: F.concat(F.lit(" [B"), (i + 1).cast("string"), F.lit("]\n   1: "), c, F.lit("()\n   Succs (1): B0\n")))
    section = lambda f: F.concat(F.lit("int "), f["name"], F.lit("(int a)\n [B9 (ENTRY)]\n   Succs (1): B0\n"), F.array_join(blocks(f), ""))
    text = F.concat(F.lit("warning: none\n"), F.array_join(F.transform("functions", section), "\n"))
    return parsed_functions(spark, sf_dir).select("program", F.when(F.size("functions") > 0, text).alias("text"))


@REGISTRY.query("dump_sections", f"WITH {_FUNCTIONS} SELECT program, f.name AS function, (2 + 3 * coalesce(len(f.calls), 0))::BIGINT AS n_lines FROM fns")
def dump_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a dump with the function they belong to."""
    found = readers.dump_sections(_dumps(spark, sf_dir).where("text IS NOT NULL"), "program", "text")
    n = F.count_if((F.trim("line") != "") & ~F.col("line").startswith("int "))
    return found.groupBy("program", "section", "function").agg(n.alias("n_lines")).drop("section")


@REGISTRY.query("dump_status", f"WITH {_FUNCTIONS} SELECT program, CASE WHEN coalesce(len(functions), 0) = 0 THEN 'EMPTY' ELSE 'OK' END AS status FROM parsed")
def dump_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a tool had anything to say, or failed."""
    return readers.dump_status(_dumps(spark, sf_dir), "program", "text")


@REGISTRY.query("cache_summaries", "SELECT unique_id, instruction_count, I1mr, ILmr, Dr, D1mr, DLmr, Dw, D1mw, DLmw FROM exec_profile WHERE instruction_count IS NOT NULL")
def cache_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of a cache simulator's summary line, by place."""
    rows = table(spark, sf_dir, "exec_profile").where("instruction_count IS NOT NULL")
    numbers = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in readers.CACHE_EVENTS])
    text = rows.select("unique_id", F.concat(F.lit("events: Ir I1mr\nsummary: "), F.array_join(numbers, " "), F.lit("\n")).alias("text"))
    return text.select("unique_id", *readers.cache_summary(F.col("text")))


@REGISTRY.query(
    "ir_edges",
    rf"""WITH {_FUNCTIONS} SELECT DISTINCT program, f.name AS function, 'entry' AS src, 'call.' || c AS dst FROM (SELECT program, f, unnest(f.calls) AS c FROM fns) WHERE regexp_full_match(c, '[\w.$]+') AND regexp_full_match(f.name, '[\w.$]+')""",
)
def ir_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successors of basic blocks, read from intermediate code made of the calls."""
    from semantide.plans.programs import parsed_functions

    plain = r"^[\w.$]+$"
    calls = lambda f: F.filter(F.coalesce(f["calls"], F.array().cast("array<string>")), lambda c: c.rlike(plain))
    cases = lambda f: F.array_join(F.transform(calls(f), lambda c, i: F.concat(F.lit("    i32 "), i.cast("string"), F.lit(", label %call."), c, F.lit("\n"))), "")
    blocks = lambda f: F.array_join(F.transform(calls(f), lambda c: F.concat(F.lit("call."), c, F.lit(":\n  ret i32 0\n"))), "")
    body = lambda f: F.concat(F.lit("define i32 @"), f["name"], F.lit("(i32 %0) {\n  switch i32 %0, label %none [\n"), cases(f), F.lit("  ]\n"), blocks(f), F.lit("none:\n  ret i32 1\n}\n"))
    fine = F.filter("functions", lambda f: f["name"].rlike(plain))
    text = parsed_functions(spark, sf_dir).select("program", F.array_join(F.transform(fine, body), "\n").alias("text"))
    return readers.ir_edges(text, "program", "text").where("dst <> 'none'").distinct()


@REGISTRY.query("program_list", "SELECT DISTINCT CASE WHEN trim(program) LIKE '%.c' THEN trim(program) ELSE trim(program) || '.c' END AS file_name FROM result_log WHERE trim(program) <> ''")
def program_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of the programs that a table names."""
    return readers.program_list(table(spark, sf_dir, "result_log"))


@REGISTRY.query(
    "header_lines",
    rf"""WITH {_FUNCTIONS}, c AS (SELECT program, regexp_split_to_array(code, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM code WHERE code IS NOT NULL AND code <> '')
SELECT program, f.name AS function, f.lineno::BIGINT AS lineno, trim(c.ls[f.lineno], ' ') AS line FROM fns JOIN c USING (program) WHERE f.lineno BETWEEN 1 AND len(ls)""",
)
def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source line at which each function is said to start; records may be of another state of the file."""
    from semantide.plans.programs import parsed_functions

    each = parsed_functions(spark, sf_dir).select("program", F.explode("functions").alias("f")).select("program", F.col("f.name").alias("function"), F.col("f.lineno").alias("lineno"))
    code = table(spark, sf_dir, "code").where("code IS NOT NULL AND code <> ''").select("program", "code")
    return each.join(code, "program").select("program", "function", F.col("lineno").cast("bigint").alias("lineno"), X.source_line(F.col("code"), F.col("lineno")).alias("line")).where("line IS NOT NULL AND lineno >= 1")


@REGISTRY.query(
    "move_plan",
    """WITH wanted AS (SELECT file_name FROM code UNION SELECT program || '.py' FROM toy_programs), here AS (SELECT file_name, sha256(code) AS a FROM code WHERE code IS NOT NULL AND loaded_at IS NOT NULL),
there AS (SELECT file_name, sha256(code) AS b FROM code WHERE code IS NOT NULL AND repo_name IS NOT NULL)
SELECT file_name, CASE WHEN a IS NULL AND b IS NULL THEN 'missing' WHEN a IS NULL THEN 'already' WHEN b IS NULL THEN 'move' WHEN a = b THEN 'deduplicate' ELSE 'conflict' END AS action
FROM wanted LEFT JOIN here USING (file_name) LEFT JOIN there USING (file_name)""",
)
def move_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moving files from one place to another would do."""
    code = table(spark, sf_dir, "code")
    wanted = code.select("file_name").union(table(spark, sf_dir, "toy_programs").select(F.concat("program", F.lit(".py"))))
    return writers.move_plan(wanted, code.where("code IS NOT NULL AND loaded_at IS NOT NULL"), code.where("code IS NOT NULL AND repo_name IS NOT NULL"))


@REGISTRY.query(
    "size_report",
    """SELECT 'Programs: ' || format('{:,}', count(*)) || chr(10) || 'Characters: ' || format('{:,}', sum(length(code))::BIGINT) || chr(10) || 'Mean: ' || format('{:.2f}', avg(length(code))) AS report FROM code WHERE code IS NOT NULL""",
)
def size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed report of three lines."""
    n, total, mean = table(spark, sf_dir, "code").where("code IS NOT NULL").agg(F.count("*"), F.coalesce(F.sum(F.length("code")), F.lit(0)), F.coalesce(F.avg(F.length("code")), F.lit(0.0))).first()
    report = "\n".join([writers.report_line("Programs", n), writers.report_line("Characters", total), writers.report_line("Mean", mean, 2)])
    return spark.createDataFrame([(report,)], "report string")
