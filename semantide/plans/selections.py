"""Queries for ordered selections, joins that must find a partner, and C programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semantide.functions import ctext
from semantide.functions import text as X
from semantide.operators import analysis, answering, dataflow, labels, sampling, scoring
from semantide.plans import Registry
from semantide.plans.programs import parsed_functions
from semantide.sources.tables import table, text_table

REGISTRY = Registry()


@REGISTRY.query("required_join", "SELECT o_orderkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def required_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer; an order without one raises."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    return scoring.required_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customers, ["o_custkey"], ["c_name"]).select("o_orderkey", "c_name", "c_nationkey")


@REGISTRY.query("canonical_order", "SELECT (row_number() OVER (ORDER BY family NULLS FIRST, model) - 1)::INT AS ordinal, model, family, All_geo_p1 FROM model_scores")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in the order of a given list of models; a missing one raises."""
    scores = table(spark, sf_dir, "model_scores")
    # A fixed table of a few models.
    names = [r["model"] for r in scores.select("model", "family").orderBy(F.col("family").asc_nulls_first(), "model").collect()]
    return scoring.in_order(scores.select("model", "family", "All_geo_p1"), "model", names)


@REGISTRY.query(
    "scores_through_names",
    """WITH r AS (SELECT model, round(avg(correct::INT), 9) AS x FROM result_log WHERE model IS NOT NULL GROUP BY model)
SELECT r.model, s.model AS final_model, r.x, s.All_geo_p1 AS y FROM r JOIN model_scores s ON s.model = lower(replace(trim(r.model), ' ', '-')) WHERE r.x IS NOT NULL AND s.All_geo_p1 IS NOT NULL""",
)
def scores_through_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy in the log beside the final table, through a map of names."""
    log = table(spark, sf_dir, "result_log").where("model IS NOT NULL")
    results = log.groupBy("model").agg(F.round(F.avg(F.col("correct").cast("int")), 9).alias("accuracy"))
    names = results.select("model", F.lower(F.replace(F.trim("model"), F.lit(" "), F.lit("-"))).alias("final_model"))
    return scoring.through_names(results, names, table(spark, sf_dir, "model_scores"), "accuracy", "All_geo_p1")


@REGISTRY.query(
    "rows_of_both_trees",
    "SELECT model, program, correct, NULL AS error FROM result_log WHERE error IS NULL UNION ALL SELECT model, program, NULL, error FROM result_log WHERE error IS NOT NULL",
)
def rows_of_both_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two trees with different columns as one table; a model may be in either or both."""
    log = table(spark, sf_dir, "result_log")
    scored, failed = log.where("error IS NULL").select("model", "program", "correct"), log.where("error IS NOT NULL").select("model", "program", "error")
    return scored.unionByName(failed, allowMissingColumns=True)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs with a problem (the stem up to its first underscore), counts and a size class."""
    p = table(spark, sf_dir, "parsed_code").groupBy("program").agg(F.max_by(F.struct("functions", "loops"), F.struct("analysed_at", "file")).alias("r"))
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0))
    sure = F.coalesce(F.exists("r.loops", lambda x: x["certainty"].isin("always_runs", "never_runs", "always", "never")), F.lit(False))
    return p.select("program", F.regexp_extract("program", "^[^_]*", 0).alias("problem"), n("r.functions").cast("bigint").alias("functions"), n("r.loops").cast("bigint").alias("loops"), sure.alias("reliable"))


_ITEMS = """items AS (SELECT program, regexp_extract(program, '^[^_]*') AS problem, coalesce(len(r.functions), 0)::BIGINT AS functions, coalesce(len(r.loops), 0)::BIGINT AS loops
FROM (SELECT program, max_by(struct_pack(functions := functions, loops := loops), struct_pack(a := analysed_at, f := file)) AS r FROM parsed_code GROUP BY program))"""


@REGISTRY.query(
    "greedy_select",
    f"""WITH {_ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY functions DESC, loops DESC, program DESC) = 1 AS first FROM items),
o AS (SELECT program, problem, functions, loops, row_number() OVER (ORDER BY first DESC, functions DESC, loops DESC, program DESC) AS place FROM n) SELECT program, problem, functions, loops, place::INT AS place FROM o WHERE place <= 200""",
)
def greedy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred programs, new problems first, then by functions, loops and name."""
    return sampling.greedy_select(_items(spark, sf_dir).drop("reliable"), "problem", ["functions", "loops"], "program", 200).select("program", "problem", "functions", "loops", "place")


_SIZED = """s AS (SELECT program, n_lines, CASE WHEN n_lines <= 50 THEN '<=50' WHEN n_lines <= 100 THEN '51-100' WHEN n_lines <= 200 THEN '101-200' WHEN n_lines <= 500 THEN '201-500' WHEN n_lines <= 1000 THEN '501-1000'
WHEN n_lines <= 2000 THEN '1001-2000' WHEN n_lines > 2000 THEN '>2000' END AS bin FROM (SELECT program, length(code) - length(replace(code, chr(10), '')) AS n_lines FROM code))"""
_BIN_LIST = "['<=50', '51-100', '101-200', '201-500', '501-1000', '1001-2000', '>2000']"


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.length("code") - F.length(F.replace("code", F.lit("\n"), F.lit("")))).cast("bigint")
    return table(spark, sf_dir, "code").select("program", n.alias("n_lines")).withColumn("bin", F.when(F.col("n_lines").isNotNull(), X.loc_bin(F.col("n_lines"))))


@REGISTRY.query("bin_order", f"WITH {_SIZED} SELECT program, bin, n_lines FROM s ORDER BY coalesce(list_position({_BIN_LIST}, bin), 99) DESC, n_lines DESC, program LIMIT 100")
def bin_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred last programs by size class, unknown ones last, then size and name."""
    ordinal = F.coalesce(F.array_position(F.array(*map(F.lit, X.LOC_LABELS)), F.col("bin")), F.lit(99))
    return _sized(spark, sf_dir).orderBy(ordinal.desc(), F.col("n_lines").desc_nulls_first(), "program").limit(100)


@REGISTRY.query("scale_text_order", f"WITH {_SIZED} SELECT program, bin, n_lines FROM s WHERE bin IS NOT NULL ORDER BY bin, n_lines, program LIMIT 100")
def scale_text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred first programs by the text of the size class, which isn't the order of sizes."""
    return _sized(spark, sf_dir).where("bin IS NOT NULL").orderBy("bin", "n_lines", "program").limit(100)


@REGISTRY.query("staged_select")
def staged_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred programs: those with a sure loop, then small and middling ones up to their targets, then any."""
    items = _items(spark, sf_dir).withColumn("bucket", F.when(F.col("functions") <= 3, "small").otherwise("large"))
    seats = min(100, items.count())
    return sampling.staged_select(items, "problem", ["functions", "loops"], "program", "reliable", "bucket", {"small": 30, "large": 40}, seats)


@REGISTRY.query("semantic_presence")
def semantic_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the six kinds of facts each Python program has, and how many facts."""
    code = text_table(spark, sf_dir, "code", "program", "file_name", "code").where(F.lower("file_name").endswith(".py"))
    return analysis.presence(analysis.analyse(code, "program", "code"))


@REGISTRY.query(
    "located_files",
    """SELECT c.file_name, CASE WHEN p.file IS NOT NULL THEN 'root/' || c.program WHEN q.program IS NOT NULL THEN 'others/' || c.program END AS place FROM code c
LEFT JOIN (SELECT program, min(file) AS file FROM parsed_code GROUP BY 1) p USING (program) LEFT JOIN (SELECT DISTINCT program FROM question_labels) q USING (program)""",
)
def located_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each file's record lies: in the first folder that has it; null where none does."""
    root = table(spark, sf_dir, "parsed_code").groupBy("program").agg(F.min("file").alias("file"))
    others = table(spark, sf_dir, "question_labels").select("program").distinct().withColumn("other", F.lit(True))
    rows = table(spark, sf_dir, "code").select("file_name", "program").join(root, "program", "left").join(others, "program", "left")
    place = F.when(F.col("file").isNotNull(), F.concat(F.lit("root/"), "program")).when(F.col("other"), F.concat(F.lit("others/"), "program"))
    return rows.select("file_name", place.alias("place"))


_EACH = """parsed AS (SELECT program, max_by(functions, struct_pack(a := analysed_at, f := file)) AS functions FROM parsed_code GROUP BY program), fns AS (SELECT program, unnest(functions) AS f FROM parsed)"""


@REGISTRY.query(
    "c_live_out",
    f"""WITH {_EACH}, v AS (SELECT program, f.name AS function, unnest(f.variables) AS var FROM fns UNION SELECT program, f.name, unnest(f.calls) FROM fns), d AS (SELECT DISTINCT program, f.name AS var FROM fns)
SELECT program, function, array_to_string(list_sort(list(DISTINCT var)), ',') AS vars FROM v ANTI JOIN d USING (program, var) WHERE var IS NOT NULL GROUP BY 1, 2""",
)
def c_live_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names at the exit of a function that don't stand for functions."""
    each = parsed_functions(spark, sf_dir).select("program", F.explode("functions").alias("f")).select("program", F.col("f.name").alias("function"), "f.variables", "f.calls")
    live, back = (each.select("program", "function", F.explode(c).alias("var")) for c in ("variables", "calls"))
    names = each.select("program", F.col("function").alias("var")).distinct()
    decayed = each.select("program", "function").distinct().join(names, "program")
    return dataflow.c_live_out(live, back, decayed, ["program", "function"]).withColumn("vars", F.array_join("vars", ","))


@REGISTRY.query("trip_counts", f"WITH {_EACH} SELECT program, k::INT AS loop, CASE WHEN f.lineno % 3 > 0 THEN f.lineno::BIGINT END AS trips FROM (SELECT program, f, row_number() OVER (PARTITION BY program ORDER BY f.lineno, f.name) AS k FROM fns)")
def trip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest trip counts, read from the text of a loop analysis."""
    ordered = F.array_sort(F.transform("functions", lambda f: F.struct(f["lineno"].alias("line"), f["name"].alias("name"))))
    line = lambda x, i: F.concat(F.lit("Loop #"), (i + 1).cast("string"), F.lit(": Backedge-taken count is "), F.when(x["line"] % 3 > 0, x["line"].cast("string")).otherwise("unknown"), F.lit("\n"))
    text = parsed_functions(spark, sf_dir).select("program", F.array_join(F.transform(ordered, line), "").alias("text"))
    return text.select("program", F.explode(ctext.trip_counts(F.col("text"))).alias("loop", "trips"))


@REGISTRY.query("c_def_use")
def c_def_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of C variables with the definition before them, from program text."""
    return dataflow.direct_def_use(ctext.c_steps(_c_programs(spark, sf_dir)), ["program", "function"])


def _c_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "code", "program", "file_name", "code").where(F.lower("file_name").endswith(".c"))


@REGISTRY.query("c_questions")
def c_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced questions with labels for every C program."""
    code = _c_programs(spark, sf_dir)
    loops = code.select("program", F.inline(ctext.c_loops(F.col("code"))))
    cond = F.regexp_replace("cond", r"\s", "")
    sure = loops.withColumn("certainty", F.when(cond.isin("1", "true"), "always_runs").when(cond.isin("0", "false"), "never_runs").otherwise("unknown"))
    return labels.c_questions(ctext.c_functions(code), sure, c_def_use(spark, sf_dir))


@REGISTRY.query(
    "asked_answers",
    """SELECT log_id, prompt, CASE WHEN prompt IS NULL THEN NULL WHEN length(prompt) % 2 = 0 THEN 'Yes' ELSE 'No' END AS answer, CASE WHEN prompt IS NULL THEN 'ValueError: no prompt' END AS error FROM result_log""",
)
def asked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that tells even from odd, asked every prompt of the log; failures are rows."""

    def responder(model: str, prompt: str) -> tuple[str, str | None]:
        return ("Yes" if len(prompt) % 2 == 0 else "No"), None

    tasks = table(spark, sf_dir, "result_log").select("log_id", "prompt", "ground_truth")
    return answering.ask(tasks, "parity", responder).select("log_id", "prompt", "answer", "error")


@REGISTRY.query(
    "code_maps",
    r"""SELECT program, list_aggregate(list_transform(CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END, lambda x, i: i::VARCHAR || ': ' || x), 'string_agg', chr(10)) || chr(10) || 'end: ' || program AS numbered
FROM (SELECT program, string_split(code, chr(10)) AS ls FROM toy_programs)""",
)
def code_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs as JSON maps of their lines, in no order, and numbered code made of them."""
    rows = table(spark, sf_dir, "toy_programs").select("program", X.lines(F.col("code")).alias("ls"))
    numbered = F.transform("ls", lambda x, i: F.struct((i + 1).cast("string").alias("key"), x.alias("value")))
    entries = F.reverse(F.concat(numbered, F.array(F.struct(F.lit("end").alias("key"), F.col("program").alias("value")))))
    return rows.select("program", X.from_code_map(F.to_json(F.map_from_entries(entries))).alias("numbered"))
