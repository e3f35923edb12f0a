"""Queries for joins, sets, orders, samples and ranked selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semantide.functions.text import loc_bin, non_blank_count
from semantide.operators import analysis, dataflow, sampling
from semantide.plans import Registry
from semantide.sources.tables import table, text_table

REGISTRY = Registry()


@REGISTRY.query("stem_semi", "SELECT unique_id, program FROM code c WHERE EXISTS (SELECT 1 FROM parsed_code p WHERE p.program = c.program)")
def stem_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs with a semantic record."""
    return table(spark, sf_dir, "code").select("unique_id", "program").join(table(spark, sf_dir, "parsed_code").select("program"), "program", "left_semi")


@REGISTRY.query("stem_anti", "SELECT unique_id, program FROM code c WHERE NOT EXISTS (SELECT 1 FROM parsed_code p WHERE p.program = c.program)")
def stem_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs without one."""
    return table(spark, sf_dir, "code").select("unique_id", "program").join(table(spark, sf_dir, "parsed_code").select("program"), "program", "left_anti")


@REGISTRY.query(
    "parsed_with_code",
    "SELECT p.program, p.unsupported, c.unique_id, c.code IS NOT NULL AS has_code, CAST(coalesce(len(p.functions), 0) AS BIGINT) AS n_functions FROM parsed_code p LEFT JOIN code c USING (program)",
)
def parsed_with_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records beside their source."""
    p, c = table(spark, sf_dir, "parsed_code"), table(spark, sf_dir, "code").select("program", "unique_id", "code")
    n = F.when(F.col("functions").isNull(), 0).otherwise(F.size("functions"))
    return p.join(c, "program", "left").select("program", "unsupported", "unique_id", F.col("code").isNotNull().alias("has_code"), n.cast("bigint").alias("n_functions"))


@REGISTRY.query(
    "source_priority",
    """SELECT program, min_by(origin, rank) AS origin FROM (SELECT DISTINCT program, 'toy' AS origin, 1 AS rank FROM toy_programs UNION ALL SELECT DISTINCT program, 'corpus', 2 FROM code WHERE code IS NOT NULL
UNION ALL SELECT DISTINCT program, 'log', 3 FROM result_log) WHERE program IS NOT NULL GROUP BY program""",
)
def source_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each program is found first, in a fixed order of places."""
    places = [("toy", table(spark, sf_dir, "toy_programs")), ("corpus", table(spark, sf_dir, "code").where("code IS NOT NULL")), ("log", table(spark, sf_dir, "result_log"))]
    rows = None
    for rank, (name, df) in enumerate(places):
        part = df.select("program", F.lit(name).alias("origin"), F.lit(rank).alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.where("program IS NOT NULL").groupBy("program").agg(F.min_by("origin", "rank").alias("origin"))


@REGISTRY.query(
    "first_path",
    "SELECT repo_name, min(path) AS path, count(*) AS files FROM code WHERE path IS NOT NULL GROUP BY repo_name",
)
def first_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First path in order of every repository; null repositories are one group."""
    return table(spark, sf_dir, "code").where("path IS NOT NULL").groupBy("repo_name").agg(F.min("path").alias("path"), F.count("*").alias("files"))


@REGISTRY.query(
    "latest_def",
    """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM events""",
)
def latest_def(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the last defining row before each row."""
    events = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id")).withColumn("defines", F.col("event_type") == "purchase")
    return dataflow.latest_definition(events, ["user_id"], "at", "defines", "value").select("event_id", "latest")


_STEPS = """steps AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS pos, event_type AS var, value >= 50 AS is_def, value < 50 AS is_use FROM events)"""


@REGISTRY.query(
    "live_before",
    f"""WITH {_STEPS}, vars AS (SELECT DISTINCT user_id, var FROM steps), pl AS (SELECT DISTINCT user_id, pos FROM steps)
SELECT a.user_id, CAST(a.pos AS BIGINT) AS pos, v.var FROM pl a JOIN vars v USING (user_id) WHERE EXISTS (SELECT 1 FROM steps u WHERE u.user_id = a.user_id AND u.var = v.var AND u.is_use AND u.pos >= a.pos
AND NOT EXISTS (SELECT 1 FROM steps d WHERE d.user_id = a.user_id AND d.var = v.var AND d.is_def AND d.pos >= a.pos AND d.pos < u.pos))""",
)
def live_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is live before each step."""
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = table(spark, sf_dir, "events").select("user_id", pos.alias("pos"), F.col("event_type").alias("var"), (F.col("value") >= 50).alias("is_def"), (F.col("value") < 50).alias("is_use"))
    return dataflow.live_before(steps, ["user_id"]).withColumn("pos", F.col("pos").cast("bigint"))


_COUNTS = "counts AS (SELECT p_type AS bin, count(*) AS n FROM part GROUP BY 1)"


def _quota_sql(tie: str) -> str:
    return f"""WITH {_COUNTS}, e AS (SELECT bin, n, n * 200.0::DOUBLE / (SELECT sum(n)::DOUBLE FROM counts) AS x FROM counts)
SELECT bin, n, CAST(floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, bin {tie}) <= 200 - (SELECT sum(floor(x)) FROM e) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM e"""


@REGISTRY.query("largest_remainder", _quota_sql("ASC"))
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seats by largest remainder, ties in order of the label."""
    return sampling.largest_remainder(table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("bin")).agg(F.count("*").alias("n")), 200)


@REGISTRY.query("largest_remainder_last", _quota_sql("DESC"))
def largest_remainder_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ties against the order of the label."""
    return sampling.largest_remainder(table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("bin")).agg(F.count("*").alias("n")), 200, ties="last")


_SIZE = "CASE WHEN n_chars <= 50 THEN '<=50' WHEN n_chars <= 100 THEN '51-100' WHEN n_chars <= 200 THEN '101-200' WHEN n_chars <= 500 THEN '201-500' WHEN n_chars <= 1000 THEN '501-1000' WHEN n_chars <= 2000 THEN '1001-2000' ELSE '>2000' END"


@REGISTRY.query(
    "stratified_sample",
    f"""WITH q(bin, quota) AS (VALUES ('<=50', 5), ('51-100', 5), ('101-200', 5), ('201-500', 10), ('501-1000', 10), ('1001-2000', 10), ('>2000', 5))
SELECT doc_id, bin FROM (SELECT d.doc_id, d.bin, quota, row_number() OVER (PARTITION BY d.bin ORDER BY sha256('42:' || doc_id), doc_id) AS k FROM (SELECT doc_id, {_SIZE} AS bin FROM documents WHERE n_chars IS NOT NULL) d JOIN q USING (bin)) WHERE k <= quota""",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts drawn by size class in hash order."""
    quotas = spark.createDataFrame([("<=50", 5), ("51-100", 5), ("101-200", 5), ("201-500", 10), ("501-1000", 10), ("1001-2000", 10), (">2000", 5)], "bin string, quota int")
    docs = table(spark, sf_dir, "documents").where("n_chars IS NOT NULL").select("doc_id", loc_bin(F.col("n_chars")).alias("bin"))
    return sampling.stratified_sample(docs, "bin", quotas, "doc_id").select("doc_id", "bin")


@REGISTRY.query(
    "quota_shortage",
    f"""WITH t(bin, need) AS (VALUES ('<=50', 10), ('101-200', 40), ('501-1000', 100), ('>2000', 1000)), c AS (SELECT {_SIZE} AS bin, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY 1)
SELECT t.bin, CAST(need AS BIGINT) AS need, coalesce(n, 0) AS available, CAST(greatest(need - coalesce(n, 0), 0) AS BIGINT) AS missing FROM t LEFT JOIN c USING (bin)""",
)
def quota_shortage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a target lacks by size class."""
    targets = spark.createDataFrame([("<=50", 10), ("101-200", 40), ("501-1000", 100), (">2000", 1000)], "bin string, need long")
    have = table(spark, sf_dir, "documents").where("n_chars IS NOT NULL").select(loc_bin(F.col("n_chars")).alias("bin"))
    return sampling.shortage(targets, have)


@REGISTRY.query(
    "name_dedupe",
    """SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) = 1 THEN p_type ELSE p_type || '_' || row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) END AS unique_name FROM part""",
)
def name_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made unique by numbers."""
    return sampling.dedupe_names(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", ["p_partkey"]).select("p_partkey", "unique_name")


@REGISTRY.query(
    "min_max_scale",
    "SELECT p_partkey, round(coalesce((p_size - min(p_size) OVER w) / nullif((max(p_size) OVER w - min(p_size) OVER w)::DOUBLE, 0), 0), 9) AS p_size FROM part WINDOW w AS (PARTITION BY p_type)",
)
def min_max_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure scaled to 0..1 within its group."""
    return sampling.min_max(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), ["p_type"], ["p_size"]).select("p_partkey", F.round("p_size", 9).alias("p_size"))


@REGISTRY.query("diverse_select")
def diverse_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diverse Python programs of each size class, chosen greedily."""
    code = text_table(spark, sf_dir, "code", "program", "repo_name", "file_name", "code").where(F.lower("file_name").endswith(".py"))
    features = ["function_count", "class_count", "loop_count", "if_count", "return_count", "assign_count", "call_count", "max_ast_depth"]
    rows = analysis.profile_trees(code, "program", "code").where("syntax_ok").join(code.select("program", "repo_name", loc_bin(non_blank_count(F.col("code"))).alias("bin")), "program")
    return sampling.diverse_sample(rows, "bin", features, "program", "repo_name", "node_count", 20)


@REGISTRY.query(
    "priority_select",
    """SELECT doc_id, round FROM (SELECT doc_id, CAST(row_number() OVER (PARTITION BY repo_name ORDER BY n_chars DESC, doc_id) AS BIGINT) AS round, n_chars FROM documents WHERE repo_name IS NOT NULL AND n_chars IS NOT NULL)
ORDER BY round, n_chars DESC, doc_id LIMIT 100""",
)
def priority_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred texts, the longest of each repository before any second one."""
    docs = table(spark, sf_dir, "documents").where("repo_name IS NOT NULL AND n_chars IS NOT NULL").select("doc_id", "repo_name", "n_chars")
    return sampling.priority_select(docs, "repo_name", [F.col("n_chars").desc(), F.col("doc_id")], 100).select("doc_id", F.col("round").cast("bigint").alias("round"))


@REGISTRY.query(
    "micro_batches",
    "SELECT log_id, logged_at, model, CAST(floor((row_number() OVER (PARTITION BY program, model ORDER BY log_id, logged_at, received_at) - 1) / 8) AS BIGINT) AS batch FROM result_log",
)
def micro_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a program and model in slices of eight."""
    rows = sampling.micro_batches(table(spark, sf_dir, "result_log"), ["program", "model"], ["log_id", "logged_at", "received_at"], 8)
    return rows.select("log_id", "logged_at", "model", F.col("batch").cast("bigint").alias("batch"))


@REGISTRY.query("shards", "SELECT log_id, (('0x' || md5(log_id::VARCHAR)[:8])::BIGINT % 16)::INT AS shard FROM result_log")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by a stable shard number."""
    return sampling.shard(table(spark, sf_dir, "result_log").select("log_id"), "log_id", 16)


@REGISTRY.query("multi_key_sort_topk", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def multi_key_sort_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows by several keys, nulls last; a top-k, not a sort of the table."""
    keys = [F.col("o_orderstatus").asc_nulls_last(), F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")]
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").orderBy(*keys).limit(50)


@REGISTRY.query("set_union", "SELECT program FROM parsed_code UNION SELECT program FROM question_labels")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs of either table."""
    return table(spark, sf_dir, "parsed_code").select("program").union(table(spark, sf_dir, "question_labels").select("program")).distinct()


@REGISTRY.query("set_intersect", "SELECT program FROM code INTERSECT SELECT program FROM question_labels")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs of both tables."""
    return table(spark, sf_dir, "code").select("program").intersect(table(spark, sf_dir, "question_labels").select("program"))


@REGISTRY.query("set_minus", "SELECT program FROM code EXCEPT SELECT program FROM question_labels")
def set_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs of the one and not of the other."""
    return table(spark, sf_dir, "code").select("program").subtract(table(spark, sf_dir, "question_labels").select("program"))


@REGISTRY.query(
    "required_subset",
    "SELECT program, len(list_filter(['liveness', 'dominators', 'data_dependency'], lambda k: NOT list_contains(map_keys(queries), k))) = 0 AS has_all FROM question_labels",
)
def required_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a program's categories contain the required ones."""
    need = F.array(*map(F.lit, ("liveness", "dominators", "data_dependency")))
    keys = F.coalesce(F.map_keys("queries"), F.array().cast("array<string>"))
    return table(spark, sf_dir, "question_labels").select("program", F.when(F.col("queries").isNotNull(), F.size(F.array_except(need, keys)) == 0).alias("has_all"))


@REGISTRY.query("category_union", "SELECT DISTINCT e AS category FROM (SELECT unnest(map_keys(queries)) AS e FROM question_labels UNION ALL SELECT category FROM result_log) WHERE e IS NOT NULL")
def category_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All categories seen in either table, spelled as they are."""
    keys = table(spark, sf_dir, "question_labels").select(F.explode(F.map_keys("queries")).alias("category"))
    return keys.union(table(spark, sf_dir, "result_log").select("category")).where("category IS NOT NULL").distinct()


@REGISTRY.query("json_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum FROM events GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of JSON text, summed by type."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"))


@REGISTRY.query("null_and_distinct", "SELECT event_type, count(*) FILTER (WHERE value IS NULL) AS n_null, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def null_and_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls and distinct values by group."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value").isNull()).alias("n_null"), F.countDistinct("user_id").alias("n_users"))


@REGISTRY.query("status_counts", "SELECT unsupported, count(*) AS n, count(DISTINCT program) AS programs FROM parsed_code GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by status."""
    return table(spark, sf_dir, "parsed_code").groupBy("unsupported").agg(F.count("*").alias("n"), F.countDistinct("program").alias("programs"))
