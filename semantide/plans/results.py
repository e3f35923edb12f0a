"""Queries over recorded answers, scores and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semantide.functions.verdict import CATEGORIES, category_name, final_answer, first_response_correct, is_correct, verdict
from semantide.operators import scoring, stats
from semantide.plans import Registry
from semantide.sources.tables import table

REGISTRY = Registry()

_CAT = "CASE WHEN lower(trim(category)) = 'deadcode' THEN 'dead_code' ELSE lower(trim(category)) END"
#: Rows that were delivered twice collapse to the one received last.
_LOG = "log AS (SELECT * FROM result_log QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY received_at DESC, logged_at DESC, model DESC, program DESC) = 1)"
_SP = r"\s\x0B\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_V = f"(?i)(?:final[{_SP}]*)?answer[{_SP}]*:[{_SP}]*(yes|no)"
_VERDICT = rf"""answers AS (SELECT log_id, ground_truth, conversation[1].response.generated_texts[1] AS answer FROM log),
cut AS (SELECT log_id, ground_truth, list_reverse(regexp_split_to_array(regexp_replace(answer, '[^A-Za-z0-9\[\]:{_SP}]', '', 'g'), '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]')) AS ls FROM answers),
deciding AS (SELECT log_id, ground_truth, list_filter(ls, lambda x: contains(lower(x), 'answer') AND len(regexp_extract_all(x, '(?i)\[final[{_SP}]*answer:[{_SP}]*(?:yes|no)\]')) <= 1
  AND regexp_matches(x, '(?i)(?:final[{_SP}]*)?answer[{_SP}]*:') AND NOT (regexp_matches(x, '\byes\b') AND regexp_matches(x, '\bno\b'))
  AND len(list_distinct(list_transform(regexp_extract_all(x, '{_V}', 1), lambda h: lower(h)))) = 1) AS ds FROM cut),
verdicts AS (SELECT log_id, ground_truth, CASE WHEN len(ds) > 0 THEN lower(regexp_extract(ds[1], '{_V}', 1)) = 'yes' END AS verdict FROM deciding)"""


def _log(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Recorded answers, each delivered once: the key, what orders deliveries, and ``columns``; the rest isn't read."""
    order = ["received_at", "logged_at", "model", "program"]
    return scoring.latest_rows(table(spark, sf_dir, "result_log").select("log_id", *order, *columns), "log_id", order)


def _answer() -> Column:
    return F.try_element_at(F.try_element_at("conversation", F.lit(1))["response"]["generated_texts"], F.lit(1))


@REGISTRY.query(
    "verdict_parse",
    f"""WITH {_LOG}, {_VERDICT} SELECT log_id, verdict, CASE WHEN coalesce(verdict, false) THEN 'yes' ELSE 'no' END AS final_answer,
verdict IS NOT DISTINCT FROM ground_truth AS correct, verdict = ground_truth AS first_response_correct FROM verdicts""",
)
def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every answer, what it counts as, and whether it is right."""
    rows = _log(spark, sf_dir, "ground_truth", "conversation").select("log_id", "ground_truth", verdict(_answer()).alias("verdict"))
    v, t = F.col("verdict"), F.col("ground_truth")
    return rows.select("log_id", "verdict", final_answer(v).alias("final_answer"), is_correct(v, t).alias("correct"), first_response_correct(v, t).alias("first_response_correct"))


@REGISTRY.query(
    "accuracy_by_category",
    f"""WITH {_LOG} SELECT model, {_CAT} AS category, count(*) AS n, count(*) FILTER (WHERE first_response_correct) AS n_correct, count(*) FILTER (WHERE first_response_correct IS NULL) AS n_null,
count(DISTINCT program) AS n_programs, round(count(*) FILTER (WHERE first_response_correct) / count(*), 9) AS accuracy FROM log GROUP BY 1, 2""",
)
def accuracy_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each model in each category; rows without verdict count as wrong."""
    log = _log(spark, sf_dir, "category", "first_response_correct").withColumn("category", category_name(F.col("category")))
    return scoring.accuracy(log, ["model", "category"]).withColumn("accuracy", F.round("accuracy", 9))


_CELLS = ", ".join(f"round(max(CASE WHEN category = '{c}' THEN accuracy END), 9) AS {c}" for c in CATEGORIES)
_KNOWN = ", ".join(f"'{c}'" for c in CATEGORIES)
_GEO = f"""CASE WHEN count(CASE WHEN category IN ({_KNOWN}) THEN accuracy END) = 0 THEN NULL WHEN min(CASE WHEN category IN ({_KNOWN}) THEN accuracy END) <= 0 THEN 0.0
ELSE round(exp(avg(CASE WHEN category IN ({_KNOWN}) AND accuracy > 0 THEN ln(accuracy) END)), 9) END"""
_ACC = f"acc AS (SELECT model, {_CAT} AS category, count(*) AS n, count(*) FILTER (WHERE first_response_correct) / count(*) AS accuracy FROM log GROUP BY 1, 2)"


@REGISTRY.query("accuracy_matrix", f"WITH {_LOG}, {_ACC} SELECT model, {_CELLS}, {_GEO} AS geo_mean, CAST(sum(n) AS BIGINT) AS n FROM acc GROUP BY model")
def accuracy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each model: accuracy by category and the geometric mean of those present."""
    wide = scoring.accuracy_matrix(_log(spark, sf_dir, "category", "first_response_correct"))
    return wide.withColumns({c: F.round(c, 9) for c in (*CATEGORIES, "geo_mean")})


@REGISTRY.query(
    "complete_programs",
    f"WITH {_LOG} SELECT program FROM (SELECT DISTINCT program, {_CAT} AS category FROM log WHERE {_CAT} IN ({_KNOWN})) GROUP BY program HAVING count(*) = {len(CATEGORIES)}",
)
def complete_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs asked in every category."""
    return scoring.complete_programs(_log(spark, sf_dir, "category"))


@REGISTRY.query(
    "accuracy_of_complete",
    f"""WITH {_LOG}, done AS (SELECT program FROM (SELECT DISTINCT program, {_CAT} AS category FROM log WHERE {_CAT} IN ({_KNOWN})) GROUP BY program HAVING count(*) = {len(CATEGORIES)})
SELECT model, count(*) AS n, count(*) FILTER (WHERE first_response_correct) AS n_correct, count(DISTINCT program) AS n_programs FROM log SEMI JOIN done USING (program) GROUP BY model""",
)
def accuracy_of_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy over the programs asked in every category."""
    log = _log(spark, sf_dir, "category", "first_response_correct")
    kept = log.join(scoring.complete_programs(log), "program", "left_semi")
    return scoring.accuracy(kept, ["model"]).select("model", "n", "n_correct", "n_programs")


@REGISTRY.query(
    "token_usage",
    f"""WITH {_LOG}, u AS (SELECT model, program, coalesce(list_sum(list_transform(_usage_list, lambda x: coalesce(x.input, 0))), 0) AS i, coalesce(list_sum(list_transform(_usage_list, lambda x: coalesce(x.cached_input, 0))), 0) AS c,
coalesce(list_sum(list_transform(_usage_list, lambda x: coalesce(x.output, 0))), 0) AS o, coalesce(list_sum(list_transform(_usage_list, lambda x: coalesce(x.reasoning, 0))), 0) AS r FROM log)
SELECT model, CAST(sum(greatest(i - c, 0)) AS BIGINT) AS fresh_input, CAST(sum(c) AS BIGINT) AS cached_input, CAST(sum(o) AS BIGINT) AS output, CAST(sum(r) AS BIGINT) AS reasoning, count(*) AS calls FROM u GROUP BY model""",
)
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by model; fresh input is clamped before it is summed."""
    return scoring.token_usage(_log(spark, sf_dir, "_usage_list"), ["model"])


@REGISTRY.query(
    "rate_lookup",
    f"""WITH {_LOG}, rates(family, weight) AS (VALUES ('knot', 1.0), ('tern', 2.0), ('other', 0.5)), m AS (SELECT model, regexp_replace(model, '-.*$', '') AS family, count(*) AS n FROM log GROUP BY 1, 2)
SELECT m.model, m.family, m.n, CAST(coalesce(r.weight, (SELECT weight FROM rates WHERE family = 'other')) AS DOUBLE) AS weight FROM m LEFT JOIN rates r USING (family)""",
)
def rate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup with a default row for what the table lacks."""
    # A family given twice has the rate given last.
    rates = spark.createDataFrame([(0, "tern", 9.0), (1, "knot", 1.0), (2, "tern", 2.0), (3, "other", 0.5)], "line int, family string, weight double")
    models = _log(spark, sf_dir).groupBy("model", F.regexp_replace("model", "-.*$", "").alias("family")).agg(F.count("*").alias("n"))
    return scoring.with_default(models, rates, "family", "other", "line").select("model", "family", "n", "weight")


@REGISTRY.query("error_rows", f"WITH {_LOG} SELECT coalesce(error, 'none') AS error, count(*) AS n, count(*) FILTER (WHERE final_answer IS NULL) AS unanswered FROM log GROUP BY 1")
def error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by error."""
    return _log(spark, sf_dir, "error", "final_answer").groupBy(F.coalesce("error", F.lit("none")).alias("error")).agg(F.count("*").alias("n"), F.count_if(F.col("final_answer").isNull()).alias("unanswered"))


@REGISTRY.query(
    "model_union",
    f"WITH {_LOG}, m AS (SELECT DISTINCT model FROM log), s AS (SELECT DISTINCT model FROM model_scores) SELECT coalesce(m.model, s.model) AS model, m.model IS NOT NULL AS in_log, s.model IS NOT NULL AS in_scores FROM m FULL JOIN s ON m.model = s.model",
)
def model_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of the log and of the score table, by a full outer join."""
    m = _log(spark, sf_dir).select("model").distinct().withColumn("a", F.lit(True))
    s = table(spark, sf_dir, "model_scores").select("model").distinct().withColumn("b", F.lit(True))
    return m.join(s, "model", "full").select("model", F.coalesce("a", F.lit(False)).alias("in_log"), F.coalesce("b", F.lit(False)).alias("in_scores"))


_SCORES = ("All_geo_p1", "DataDep_p1", "DeadCode_p1", "Dominators_p1", "FuncReach_p1", "Liveness_p1", "LoopReach_p1")
_BENCH = ("HumanEval_p1", "MBPP_p1")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``category``, ``benchmark``, ``x``, ``y`` for each model, score column and benchmark; scores in fractions become percent."""
    scores = table(spark, sf_dir, "model_scores")
    pairs = [F.struct(F.lit(c).alias("category"), F.lit(b).alias("benchmark"), F.col(c).alias("x"), F.col(b).alias("y")) for c in _SCORES for b in _BENCH]
    long = scores.select("model", "family", F.inline(F.array(*pairs)))
    top = F.max("x").over(Window.partitionBy("category", "benchmark"))
    return long.withColumn("x", F.when(top <= 1, F.col("x") * 100).otherwise(F.col("x")))


_UNION = " UNION ALL ".join(f"SELECT model, family, '{c}' AS category, '{b}' AS benchmark, {c} AS x, {b} AS y FROM model_scores" for c in _SCORES for b in _BENCH)
_LONG = f"raw AS ({_UNION}), long AS (SELECT * REPLACE (CASE WHEN max(x) OVER (PARTITION BY category, benchmark) <= 1 THEN x * 100 ELSE x END AS x) FROM raw)"
_PAIRS = "pairs AS (SELECT category, benchmark, x, y FROM long WHERE x IS NOT NULL AND y IS NOT NULL AND isfinite(x) AND isfinite(y))"


@REGISTRY.query("pearson", f"WITH {_LONG}, {_PAIRS} SELECT category, benchmark, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(x, y) END, 9) AS r FROM pairs GROUP BY 1, 2")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation of every score with every benchmark."""
    return stats.pearson(_long(spark, sf_dir), ["category", "benchmark"], "x", "y").select("category", "benchmark", "n", F.round("r", 9).alias("r"))


@REGISTRY.query(
    "spearman",
    f"""WITH {_LONG}, {_PAIRS}, ranked AS (SELECT category, benchmark, rank() OVER (PARTITION BY category, benchmark ORDER BY x) + (count(*) OVER (PARTITION BY category, benchmark, x) - 1) / 2.0 AS x,
rank() OVER (PARTITION BY category, benchmark ORDER BY y) + (count(*) OVER (PARTITION BY category, benchmark, y) - 1) / 2.0 AS y FROM pairs)
SELECT category, benchmark, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN corr(x, y) END, 9) AS r FROM ranked GROUP BY 1, 2""",
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman correlation of every score with every benchmark."""
    return stats.spearman(_long(spark, sf_dir), ["category", "benchmark"], "x", "y").select("category", "benchmark", "n", F.round("r", 9).alias("r"))


# Student's t for whole degrees of freedom is a finite series in the angle.
_SERIES = """list_sum(list_transform(range(0, {terms}), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda i: {factor})), 1) * pow(cos(a), {power})))"""


@REGISTRY.query(
    "correlation_tests",
    f"""WITH {_LONG}, {_PAIRS}, ranked AS (SELECT category, benchmark, rank() OVER (PARTITION BY category, benchmark ORDER BY x) + (count(*) OVER (PARTITION BY category, benchmark, x) - 1) / 2.0 AS x,
rank() OVER (PARTITION BY category, benchmark ORDER BY y) + (count(*) OVER (PARTITION BY category, benchmark, y) - 1) / 2.0 AS y FROM pairs),
c AS (SELECT category, benchmark, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(x, y) END AS r FROM ranked GROUP BY 1, 2),
t AS (SELECT *, n - 2 AS v, CASE WHEN abs(r) < 1 THEN atan(abs(r) / sqrt(1 - r * r)) END AS a FROM c),
q AS (SELECT *, CASE WHEN r IS NULL THEN NULL WHEN abs(r) >= 1 THEN 0.0 WHEN v % 2 = 0 THEN 1 - sin(a) * {_SERIES.format(terms="v // 2", factor="(2 * i - 1) / (2.0 * i)", power="2 * k")}
ELSE 1 - 2 / pi() * (a + sin(a) * coalesce({_SERIES.format(terms="(v - 1) // 2", factor="2 * i / (2.0 * i + 1)", power="2 * k + 1")}, 0)) END AS p FROM t)
SELECT category, benchmark, n, round(r, 9) AS r, round(p, 9) AS p, CASE WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' ELSE '' END AS stars FROM q""",
)
def correlation_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The correlations with p-values and marks of significance."""
    found = stats.spearman(_long(spark, sf_dir), ["category", "benchmark"], "x", "y")
    return found.withColumn("stars", stats.stars(F.col("p"))).withColumns({"r": F.round("r", 9), "p": F.round("p", 9)})


@REGISTRY.query(
    "kendall",
    f"""WITH {_LONG}, {_PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY category, benchmark ORDER BY x, y) AS i FROM pairs),
s AS (SELECT a.category, a.benchmark, sum(sign(a.x - b.x) * sign(a.y - b.y)) AS s, count(*) FILTER (WHERE a.x = b.x) AS tx, count(*) FILTER (WHERE a.y = b.y) AS ty, count(*) AS m
 FROM t a JOIN t b ON a.category = b.category AND a.benchmark = b.benchmark AND a.i < b.i GROUP BY 1, 2), k AS (SELECT category, benchmark, count(*) AS n FROM pairs GROUP BY 1, 2)
SELECT category, benchmark, n, round(CASE WHEN n >= 3 THEN s / nullif(sqrt((m - tx)::DOUBLE * (m - ty)), 0) END, 9) AS tau FROM k LEFT JOIN s USING (category, benchmark)""",
)
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kendall's tau-b of every score with every benchmark."""
    return stats.kendall(_long(spark, sf_dir), ["category", "benchmark"], "x", "y").select("category", "benchmark", "n", F.round("tau", 9).alias("tau"))


@REGISTRY.query(
    "linear_fit",
    f"WITH {_LONG}, {_PAIRS} SELECT category, benchmark, count(*) AS n, round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 9) AS intercept FROM pairs GROUP BY 1, 2",
)
def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line through benchmark against score."""
    fits = stats.linear_fit(_long(spark, sf_dir), ["category", "benchmark"], "x", "y")
    return fits.select("category", "benchmark", "n", F.round("slope", 9).alias("slope"), F.round("intercept", 9).alias("intercept"))


@REGISTRY.query(
    "log_fit",
    r"""WITH s AS (SELECT family, CAST(regexp_extract(model, '-([0-9.]+)b$', 1) AS DOUBLE) AS size, All_geo_p1 AS y FROM model_scores WHERE regexp_matches(model, '-[0-9.]+b$') AND All_geo_p1 IS NOT NULL)
SELECT family, count(*) AS n, round(CASE WHEN count(*) >= 3 AND min(size) < max(size) THEN regr_slope(y, ln(size)) END, 9) AS slope, round(CASE WHEN count(*) >= 3 AND min(size) < max(size) THEN regr_intercept(y, ln(size)) END, 9) AS intercept
FROM s WHERE size > 0 GROUP BY family""",
)
def log_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score against the logarithm of model size, by family."""
    sized = table(spark, sf_dir, "model_scores").select("family", F.regexp_extract("model", r"-([0-9.]+)b$", 1).try_cast("double").alias("size"), "All_geo_p1")
    fits = stats.linear_fit(sized, ["family"], "size", "All_geo_p1", log_x=True)
    return fits.select("family", "n", F.round("slope", 9).alias("slope"), F.round("intercept", 9).alias("intercept"))


@REGISTRY.query(
    "category_spread",
    f"""WITH {_LONG}, o AS (SELECT category, count(x) AS n, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std FROM long WHERE benchmark = 'MBPP_p1' GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY mean DESC, category) AS place FROM o""",
)
def category_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories in order of their mean score. The window runs over one row a category."""
    by = _long(spark, sf_dir).where("benchmark = 'MBPP_p1'").groupBy("category").agg(F.count("x").alias("n"), F.round(F.avg("x"), 9).alias("mean"), F.round(F.stddev_pop("x"), 9).alias("std"))
    place = F.row_number().over(Window.partitionBy().orderBy(F.col("mean").desc(), "category"))
    return by.withColumn("place", place.cast("bigint"))


@REGISTRY.query(
    "family_best",
    """SELECT family, max_by(model, struct_pack(s := All_geo_p1, m := model)) AS best, max(All_geo_p1) AS score FROM model_scores WHERE All_geo_p1 IS NOT NULL GROUP BY family""",
)
def family_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best model of each family; ties go to the later name."""
    scores = table(spark, sf_dir, "model_scores").where("All_geo_p1 IS NOT NULL")
    return scores.groupBy("family").agg(F.max_by("model", F.struct("All_geo_p1", "model")).alias("best"), F.max("All_geo_p1").alias("score"))


@REGISTRY.query(
    "best_and_family",
    """WITH best AS (SELECT max_by(model, struct_pack(s := All_geo_p1, m := model)) AS model FROM model_scores WHERE All_geo_p1 IS NOT NULL GROUP BY family)
SELECT model FROM best UNION SELECT model FROM model_scores WHERE family = 'tern'""",
)
def best_and_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each family together with all of one family, each once."""
    return family_best(spark, sf_dir).select(F.col("best").alias("model")).union(table(spark, sf_dir, "model_scores").where("family = 'tern'").select("model")).distinct()


@REGISTRY.query("model_order", "SELECT model, All_geo_p1, row_number() OVER (ORDER BY All_geo_p1 NULLS LAST, model) AS place FROM model_scores")
def model_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by rising score, null scores last. The score table has one row a model."""
    w = Window.partitionBy().orderBy(F.col("All_geo_p1").asc_nulls_last(), "model")
    return table(spark, sf_dir, "model_scores").select("model", "All_geo_p1", F.row_number().over(w).cast("bigint").alias("place"))


@REGISTRY.query(
    "measure_correlation",
    "SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1",
)
def measure_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation and slope over a large table, in one aggregation."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(stats.correlation("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(stats.slope("l_quantity", "l_extendedprice"), 4).alias("slope"))
