"""Queries over questions, labels and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semantide.functions.text import collapse, line_count
from semantide.functions.verdict import category_name
from semantide.operators import analysis, answering, dataflow, labels, sampling
from semantide.plans import Registry
from semantide.sources.shared import materialise
from semantide.sources.tables import table, text_table

REGISTRY = Registry()

_CAT = "CASE WHEN lower(trim(category)) = 'deadcode' THEN 'dead_code' ELSE lower(trim(category)) END"
_ZIP = """zipped AS (SELECT q.program, q.category, q.pos, q.question, t.label FROM
 (SELECT program, category, unnest(range(len(items))) AS pos, unnest(items) AS question FROM (SELECT program, e.key AS category, e.value AS items FROM (SELECT program, unnest(map_entries(queries)) AS e FROM question_labels))) q
 JOIN (SELECT program, category, unnest(range(len(items))) AS pos, unnest(items) AS label FROM (SELECT program, e.key AS category, e.value AS items FROM (SELECT program, unnest(map_entries(ground_truth)) AS e FROM question_labels))) t
 USING (program, category, pos))"""


@REGISTRY.query("query_truth_zip", f"WITH {_ZIP} SELECT program, category, CAST(pos AS BIGINT) AS pos, question, label FROM zipped")
def query_truth_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions joined with their labels by position; what the other list lacks is cut."""
    return labels.zipped(table(spark, sf_dir, "question_labels")).withColumn("pos", F.col("pos").cast("bigint"))


@REGISTRY.query(
    "category_totals",
    """SELECT CASE WHEN e.key = 'deadcode' THEN 'dead_code' ELSE e.key END AS category, CAST(sum(coalesce(len(e.value), 0)) AS BIGINT) AS n
FROM (SELECT unnest(map_entries(queries)) AS e FROM question_labels) GROUP BY 1""",
)
def category_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by category."""
    each = table(spark, sf_dir, "question_labels").select(F.explode("queries").alias("category", "items"))
    size = F.when(F.col("items").isNull(), 0).otherwise(F.size("items"))
    return each.groupBy(category_name(F.col("category")).alias("category")).agg(F.sum(size).cast("bigint").alias("n"))


@REGISTRY.query(
    "task_flattening",
    f"""WITH {_ZIP} SELECT z.program, {_CAT} AS category, CAST(z.pos AS BIGINT) AS pos, z.question, z.label, c.program IS NOT NULL AS has_source
FROM zipped z LEFT JOIN (SELECT DISTINCT program FROM code WHERE code IS NOT NULL) c ON z.program = c.program WHERE {_CAT} <> 'dead_code'""",
)
def task_flattening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks for one kind of evaluation, with whether their source exists."""
    tasks = labels.zipped(table(spark, sf_dir, "question_labels")).withColumn("category", category_name(F.col("category"))).where("category <> 'dead_code'")
    sources = table(spark, sf_dir, "code").where("code IS NOT NULL").select("program").distinct().withColumn("has", F.lit(True))
    return tasks.join(sources, "program", "left").select("program", "category", F.col("pos").cast("bigint").alias("pos"), "question", "label", F.coalesce("has", F.lit(False)).alias("has_source"))


@REGISTRY.query(
    "balanced_cap",
    f"""WITH {_ZIP} SELECT program, category, question, label FROM (SELECT *, row_number() OVER (PARTITION BY program, category, label
ORDER BY sha256('42:' || program || ':' || question || ':' || pos), program, question, pos) AS k FROM zipped WHERE label IS NOT NULL AND question IS NOT NULL) WHERE k <= 1""",
)
def balanced_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question of each label for each program and category."""
    rows = labels.zipped(table(spark, sf_dir, "question_labels")).where("label IS NOT NULL AND question IS NOT NULL")
    return sampling.balanced_cap(rows, ["program", "category"], "label", 1, ["program", "question", "pos"]).select("program", "category", "question", "label")


_REFS = r"""refs AS (SELECT program, question, CAST(unnest(regexp_extract_all(question, 'line (\d+)', 1)) AS BIGINT) AS line FROM zipped)"""


@REGISTRY.query(
    "line_ref_validation",
    rf"""WITH {_ZIP}, {_REFS}, n AS (SELECT program, code, CASE WHEN ls[-1] = '' THEN len(ls) - 1 ELSE len(ls) END AS n FROM
(SELECT program, code, regexp_split_to_array(code, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM code WHERE code IS NOT NULL))
SELECT DISTINCT r.program, r.question, r.line FROM refs r LEFT JOIN n ON r.program = n.program WHERE n.program IS NULL OR r.line > n.n OR r.line < 1""",
)
def line_ref_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that name a line the program doesn't have."""
    zipped = labels.zipped(table(spark, sf_dir, "question_labels"))
    refs = zipped.select("program", "question", F.explode(F.regexp_extract_all("question", F.lit(r"line (\d+)"), 1)).alias("line")).withColumn("line", F.col("line").try_cast("bigint"))
    sizes = table(spark, sf_dir, "code").where("code IS NOT NULL").select("program", line_count(F.col("code")).alias("n"))
    return refs.join(sizes, "program", "left").where("n IS NULL OR line > n OR line < 1").select("program", "question", "line").distinct()


@REGISTRY.query(
    "contradictory_questions",
    f"""WITH {_ZIP} SELECT program, category, question, count(*) AS n, min(label) <> max(label) AS contradictory FROM zipped GROUP BY 1, 2, 3 HAVING count(*) > 1""",
)
def contradictory_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked more than once of a program, and whether their labels differ."""
    return labels.duplicate_questions(labels.zipped(table(spark, sf_dir, "question_labels")))


@REGISTRY.query(
    "negative_sample",
    """WITH parsed AS (SELECT program, max_by(functions, struct_pack(a := analysed_at, f := file)) AS functions FROM parsed_code GROUP BY program),
f AS (SELECT program, unnest(functions) AS f FROM parsed), u AS (SELECT DISTINCT a.program, a.f.name AS function, b.var FROM f a JOIN (SELECT program, unnest(f.variables) AS var FROM f) b ON a.program = b.program),
p AS (SELECT program, f.name AS function, unnest(f.variables) AS var FROM f)
SELECT u.program, u.function, min(u.var) AS var FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.program = u.program AND p.function = u.function AND p.var = u.var) GROUP BY 1, 2""",
)
def negative_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each function the first variable of its program that it doesn't have."""
    from semantide.plans.programs import parsed_functions

    each = parsed_functions(spark, sf_dir).select("program", F.explode("functions").alias("f"))
    present = each.select("program", F.col("f.name").alias("function"), F.explode("f.variables").alias("var"))
    universe = each.select("program", F.col("f.name").alias("function")).distinct().join(present.select("program", "var").distinct(), "program")
    return dataflow.smallest_missing(universe, present, ["program", "function"], "var")


def _python_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "code", "program", "file_name", "code").where(F.lower("file_name").endswith(".py"))


@REGISTRY.query("label_generation")
def label_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced questions with labels for every Python program, from its facts."""
    return labels.generate(_python_programs(spark, sf_dir))


@REGISTRY.query("label_maps")
def label_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as aligned lists by category; programs without facts have empty lists."""
    programs = _python_programs(spark, sf_dir)
    return labels.question_maps(programs.where("code IS NOT NULL").select("program"), labels.generate(programs))


@REGISTRY.query(
    "label_violations",
    rf"""WITH cats AS (SELECT program, e.key AS category, e.value AS questions, map_extract(ground_truth, e.key)[1] AS truth FROM (SELECT program, ground_truth, unnest(map_entries(queries)) AS e FROM question_labels)),
lists AS (SELECT program, category, unnest([CASE WHEN truth IS NULL THEN 'missing ground truth' END, CASE WHEN truth IS NOT NULL AND len(questions) <> len(truth) THEN 'length mismatch' END,
 CASE WHEN len(questions) > 4 THEN 'too many questions' END, CASE WHEN greatest(len(list_filter(truth, lambda x: x)), len(list_filter(truth, lambda x: NOT x))) > 2 THEN 'too many of one label' END]) AS problem, '' AS detail FROM cats),
each AS (SELECT program, category, unnest(questions) AS question FROM cats),
texts AS (SELECT program, category, unnest([CASE WHEN trim(question, ' ') = '' THEN 'empty question' END,
 CASE WHEN regexp_matches(regexp_replace(question, '<statement>.*?</statement>', '<statement></statement>', 'g'), '\{{(?:src|dst|cond|func|var|code|a|b|a_id|b_id)\}}') THEN 'placeholder' END,
 CASE WHEN contains(question, '<statement>  </statement>') THEN 'empty statement' END, CASE WHEN contains(lower(question), 'unknown') THEN 'unknown value' END]) AS problem, question AS detail FROM each),
n AS (SELECT program, CASE WHEN ls[-1] = '' THEN len(ls) - 1 ELSE len(ls) END AS n FROM (SELECT program, regexp_split_to_array(code, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM code WHERE code <> '')),
refs AS (SELECT program, category, question, try_cast(unnest(regexp_extract_all(question, 'line (\d+): <statement>', 1)) AS INT) AS line FROM each)
SELECT * FROM lists WHERE problem IS NOT NULL UNION ALL SELECT * FROM texts WHERE problem IS NOT NULL
UNION ALL SELECT program, category, 'unknown line', question FROM refs r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.program = r.program AND r.line BETWEEN 1 AND n.n)""",
)
def label_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the given question lists."""
    sizes = table(spark, sf_dir, "code").where("code IS NOT NULL AND code <> ''").select("program", line_count(F.col("code")).alias("n"))
    lines = sizes.where("n > 0").select("program", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("line"))
    return labels.violations(table(spark, sf_dir, "question_labels"), lines)


_INSTRUCTION = "Answer the question about the program with yes or no."
_BACKGROUND = {"dominators": "A statement dominates another if every path to the other passes it.", "liveness": "A variable is live where its value may still be needed."}


@REGISTRY.query(
    "prompts",
    rf"""WITH {_ZIP}, c AS (SELECT program, code, list_aggregate(list_transform(string_split(lower(coalesce(language, 'the')), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS language,
 list_aggregate(list_transform(ls, lambda x, i: i::VARCHAR || ': ' || x), 'string_agg', chr(10)) AS numbered FROM
 (SELECT *, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS ls FROM (SELECT *, regexp_split_to_array(code, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM code))),
t AS (SELECT program, {_CAT} AS category, pos::INT AS pos, question, label FROM zipped)
SELECT t.*, concat_ws(chr(10) || chr(10), '{_INSTRUCTION}', CASE t.category WHEN 'dominators' THEN '{_BACKGROUND["dominators"]}' WHEN 'liveness' THEN '{_BACKGROUND["liveness"]}' END,
 coalesce(c.language, 'The') || ' code:' || chr(10) || coalesce(CASE WHEN t.category IN ('dominators', 'data_dependency') THEN c.numbered ELSE c.code END, ''), 'Question: ' || t.question) AS prompt FROM t LEFT JOIN c USING (program)""",
)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for every question: instruction, background, code and question."""
    tasks = labels.zipped(table(spark, sf_dir, "question_labels")).withColumn("category", category_name(F.col("category")))
    return labels.prompts(tasks, table(spark, sf_dir, "code"), _BACKGROUND, _INSTRUCTION)


def _replay_sql() -> str:
    """Verdicts of the recorded answers by the SQL of ``verdict_parse``, with keys for ids."""
    from semantide.plans.results import _VERDICT

    log = """src AS (SELECT * FROM result_log WHERE model IS NOT NULL AND program IS NOT NULL AND prompt IS NOT NULL), t AS (SELECT model, program, prompt, max(ground_truth) AS truth FROM src GROUP BY ALL),
k AS (SELECT model, program, prompt, min_by(struct_pack(a := conversation[1].response.generated_texts[1]), struct_pack(l := log_id, r := received_at)) AS a FROM src WHERE error IS NULL GROUP BY ALL),
j AS (SELECT t.*, k.a.a AS text, k.model IS NULL AS missing FROM t LEFT JOIN k USING (model, program, prompt)),
log AS (SELECT struct_pack(m := model, p := program, q := prompt) AS log_id, truth AS ground_truth, [struct_pack(response := struct_pack(generated_texts := [text]))] AS conversation FROM j)"""
    return f"""WITH {log}, {_VERDICT} SELECT j.model, j.program, j.prompt, j.truth AS ground_truth, j.text AS answer, CASE WHEN missing THEN 'no recorded answer' END AS error, CASE WHEN NOT missing THEN v.verdict END AS verdict,
CASE WHEN NOT missing THEN CASE WHEN coalesce(v.verdict, false) THEN 'yes' ELSE 'no' END END AS final_answer, CASE WHEN NOT missing THEN v.verdict IS NOT DISTINCT FROM j.truth END AS correct,
CASE WHEN NOT missing THEN v.verdict = j.truth END AS first_response_correct FROM j JOIN verdicts v ON v.log_id.m = j.model AND v.log_id.p = j.program AND v.log_id.q = j.prompt"""


@REGISTRY.query("replayed_answers", _replay_sql())
def replayed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the log answered again from its own first answers, and scored."""
    log = table(spark, sf_dir, "result_log").where("model IS NOT NULL AND program IS NOT NULL AND prompt IS NOT NULL")
    answer = F.try_element_at(F.try_element_at("conversation", F.lit(1))["response"]["generated_texts"], F.lit(1))
    keys = ["model", "program", "prompt"]
    recorded = log.where("error IS NULL").groupBy(*keys).agg(F.min_by(answer, F.struct("log_id", "received_at")).alias("answer"))
    tasks = log.groupBy(*keys).agg(F.max("ground_truth").alias("ground_truth"))
    return answering.replay(tasks, recorded, keys)


@REGISTRY.query(
    "toy_statements",
    r"""SELECT program, CAST(i AS BIGINT) AS line, trim(regexp_replace(ls[i], '\s+', ' ', 'g')) AS statement FROM (SELECT program, ls, unnest(range(1, len(ls) + 1)) AS i FROM
(SELECT program, string_split(rtrim(code, chr(10)), chr(10)) AS ls FROM toy_programs))""",
)
def toy_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the small check programs with white space collapsed."""
    from semantide.functions.text import lines

    each = table(spark, sf_dir, "toy_programs").select("program", F.posexplode(lines(F.rtrim(F.col("code"), F.lit("\n")))).alias("i", "statement"))
    return each.select("program", (F.col("i") + 1).cast("bigint").alias("line"), collapse(F.col("statement")).alias("statement"))
