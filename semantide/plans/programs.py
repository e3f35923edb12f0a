"""Queries over source programs and their semantic records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semantide.functions import ctext
from semantide.functions import text as X
from semantide.operators import analysis, dataflow, graph, profile
from semantide.plans import Registry
from semantide.sources.readers import derived_rates
from semantide.sources.tables import table, text_table

REGISTRY = Registry()

# Line breaks and white space as the expressions have them, in DuckDB's notation.
_BREAK = r"'\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]'"
_SPACE = r"[\s\x0B\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LINES = f"""lines AS (
  SELECT unique_id, file_name, CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END AS ls
  FROM (SELECT unique_id, file_name, regexp_split_to_array(code, {_BREAK}) AS ls FROM code WHERE code IS NOT NULL))"""
_FULL = f"list_filter(ls, lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g') <> '')"


@REGISTRY.query(
    "loc_counts",
    f"""WITH {_LINES}
SELECT unique_id, CAST(len(ls) AS BIGINT) AS total_lines, CAST(len({_FULL}) AS BIGINT) AS non_blank,
  CAST(len(list_filter(ls, lambda x: starts_with(regexp_replace(x, '^{_SPACE}+', ''), '#'))) AS BIGINT) AS hash_lines
FROM lines""",
)
def loc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, lines that aren't blank and hash lines of every program."""
    code = text_table(spark, sf_dir, "code", "unique_id", "code").where("code IS NOT NULL")
    c = F.col("code")
    return code.select(
        "unique_id", X.line_count(c).cast("bigint").alias("total_lines"), X.non_blank_count(c).cast("bigint").alias("non_blank"), X.python_comment_count(c).cast("bigint").alias("hash_lines")
    )


_BLANK_LINE = rf"regexp_full_match(x, '{_SPACE}*')"


@REGISTRY.query(
    "source_lines_of_code",
    rf"""WITH plain AS (SELECT unique_id, lower(file_name) LIKE '%.c' AS c, CASE WHEN lower(file_name) LIKE '%.c' THEN
 list_aggregate(list_transform(regexp_extract_all(regexp_replace(code, '("(?:\\[\s\S]|[^"\\])*(?:"|$)|''(?:\\[\s\S]|[^''\\])*(?:''|$)|/\*[\s\S]*?(?:\*/|$))|//[^\n]*', '\1', 'g'),
  '("(?:\\[\s\S]|[^"\\])*(?:"|$)|''(?:\\[\s\S]|[^''\\])*(?:''|$)|/\*[\s\S]*?(?:\*/|$)|[^/"'']+|[/"''])', 1), lambda p: CASE WHEN starts_with(p, '/*') THEN regexp_replace(p, '[^\n]', '', 'g') ELSE p END), 'string_agg', '')
 ELSE code END AS code FROM code WHERE code IS NOT NULL),
ls AS (SELECT unique_id, c, regexp_split_to_array(coalesce(code, ''), {_BREAK}) AS ls FROM plain)
SELECT unique_id, CASE WHEN c THEN 'c' ELSE 'python' END AS language, (len(list_filter(ls, lambda x: NOT {_BLANK_LINE})) - CASE WHEN c THEN 0 ELSE len(list_filter(ls, lambda x: starts_with(regexp_replace(x, '^{_SPACE}+', ''), '#'))) END)::INT AS sloc FROM ls""",
)
def source_lines_of_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of code without comments: by a comment stripper for C, by line starts for Python."""
    code = text_table(spark, sf_dir, "code", "unique_id", "file_name", "code").where("code IS NOT NULL")
    lang = X.language_of(F.col("file_name"))
    return code.select("unique_id", lang.alias("language"), F.when(lang == "c", X.c_sloc(F.col("code"))).otherwise(X.python_sloc(F.col("code"))).alias("sloc"))


_BIN = "CASE WHEN n <= 50 THEN '<=50' WHEN n <= 100 THEN '51-100' WHEN n <= 200 THEN '101-200' WHEN n <= 500 THEN '201-500' WHEN n <= 1000 THEN '501-1000' WHEN n <= 2000 THEN '1001-2000' ELSE '>2000' END"
_BINS = "bins(ordinal, bin) AS (VALUES (0, '<=50'), (1, '51-100'), (2, '101-200'), (3, '201-500'), (4, '501-1000'), (5, '1001-2000'), (6, '>2000'))"


@REGISTRY.query(
    "loc_histogram",
    f"""WITH {_LINES}, {_BINS}, c AS (SELECT {_BIN} AS bin, count(*) AS n FROM (SELECT len({_FULL}) AS n FROM lines) GROUP BY 1)
SELECT b.ordinal, b.bin, coalesce(c.n, 0) AS n, round(coalesce(c.n, 0) * 100.0 / (SELECT sum(n) FROM c), 6) AS pct FROM bins b LEFT JOIN c USING (bin)""",
)
def loc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs by size class, empty classes included."""
    sized = text_table(spark, sf_dir, "code", "code").select(X.non_blank_count(F.col("code")).alias("loc"))
    return profile.histogram(sized, "loc").withColumn("pct", F.round("pct", 6))


_LANG = "regexp_replace(lower(trim(lang)), '-.*$', '')"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.regexp_replace(F.lower(F.trim("lang")), "-.*$", "").alias("lang"), "n_chars")


@REGISTRY.query(
    "percentile_linear",
    f"SELECT {_LANG} AS lang, quantile_cont(n_chars::DOUBLE, 0.25) AS p25, quantile_cont(n_chars::DOUBLE, 0.5) AS p50, quantile_cont(n_chars::DOUBLE, 0.9) AS p90 FROM documents GROUP BY 1",
)
def percentile_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated percentiles of text length by language."""
    return profile.percentiles_linear(_texts(spark, sf_dir), ["lang"], "n_chars", {"p25": 0.25, "p50": 0.5, "p90": 0.9})


def _nearest(p: float) -> str:
    return f"list_sort(list(n_chars))[1 + CAST(round_even((count(*) - 1) * {p}, 0) AS BIGINT)]"


@REGISTRY.query("percentile_nearest", f"SELECT {_LANG} AS lang, {_nearest(0.25)} AS p25, {_nearest(0.5)} AS p50, {_nearest(0.9)} AS p90 FROM documents GROUP BY 1")
def percentile_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of text length by language; null languages are a group."""
    texts = _texts(spark, sf_dir)
    return profile.percentiles_nearest(texts, ["lang"], "n_chars", {"p25": 0.25, "p50": 0.5, "p90": 0.9})


@REGISTRY.query(
    "describe_stats",
    """SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, round(stddev_pop(l_quantity), 6) AS std_pop, min(l_quantity) AS min,
quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS max FROM lineitem GROUP BY 1""",
)
def describe_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact summary of a measure by group."""
    out = profile.describe(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "std_pop")})


@REGISTRY.query(
    "size_summary",
    f"""WITH {_LINES} SELECT CAST(round_even(avg(n), 0) AS BIGINT) AS avg, CAST(min(n) AS BIGINT) AS min, CAST(max(n) AS BIGINT) AS max FROM (SELECT len({_FULL}) AS n FROM lines)""",
)
def size_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded average and extremes of program size."""
    sized = table(spark, sf_dir, "code").where("code IS NOT NULL").select(X.non_blank_count(F.col("code")).alias("loc"))
    return profile.rounded_summary(sized, "loc")


@REGISTRY.query(
    "language_resolver",
    r"""SELECT unique_id, CASE WHEN lower(trim(language)) IN ('python', 'py') THEN 'python' WHEN lower(trim(language)) IN ('c', 'ansi c') THEN 'c'
WHEN lower(file_name) LIKE '%.py' THEN 'python' WHEN lower(file_name) LIKE '%.c' THEN 'c' END AS language FROM code""",
)
def language_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared language, or that of the extension."""
    return table(spark, sf_dir, "code").select("unique_id", X.language_of(F.col("file_name"), F.col("language")).alias("language"))


@REGISTRY.query(
    "name_transforms",
    r"""SELECT unique_id, regexp_replace(file_name, '\.[^.]*$', '') AS stem, lower(regexp_extract(file_name, '(\.[^.]*)$', 1)) AS extension, replace(path, '/', '_') AS flat,
sha256('42:' || file_name)[:16] AS seed_hex FROM code""",
)
def name_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem, extension, flattened path and the hash a file's seed comes from."""
    return table(spark, sf_dir, "code").select(
        "unique_id", X.stem(F.col("file_name")).alias("stem"), X.extension(F.col("file_name")).alias("extension"), F.replace("path", F.lit("/"), F.lit("_")).alias("flat"),
        F.substring(F.sha2(F.concat(F.lit("42:"), F.col("file_name")), 256), 1, 16).alias("seed_hex"),
    )


@REGISTRY.query("c_functions")
def c_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of the C programs and what they call, by patterns."""
    return ctext.c_functions(text_table(spark, sf_dir, "code", "program", "file_name", "code").where(F.lower("file_name").endswith(".c")))


@REGISTRY.query(
    "c_loops",
    r"""WITH l AS (SELECT program, list_concat(list_concat(list_transform(regexp_extract_all(code, '\bfor\s*\([^;]+;([^;]*);[^)]+\)', 1), lambda x: {'kind': 'for', 'cond': trim(x, ' ')}),
list_transform(regexp_extract_all(code, '\bwhile\s*\(([^)]*)\)', 1), lambda x: {'kind': 'while', 'cond': trim(x, ' ')})), list_transform(regexp_extract_all(code, '(\bdo\s*\{)', 1), lambda x: {'kind': 'do', 'cond': 'do-while'})) AS ls
FROM code WHERE code IS NOT NULL AND lower(file_name) LIKE '%.c') SELECT program, i::INT AS header_id, ls[i + 1].kind AS kind, ls[i + 1].cond AS cond FROM (SELECT program, ls, unnest(range(len(ls))) AS i FROM l)""",
)
def c_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops of the C programs, by patterns."""
    code = text_table(spark, sf_dir, "code", "program", "file_name", "code").where(F.lower("file_name").endswith(".c"))
    return code.select("program", F.inline(ctext.c_loops(F.col("code"))))


@REGISTRY.query("ast_features")
def ast_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the syntax tree of every Python program."""
    code = text_table(spark, sf_dir, "code", "program", "file_name", "code").where(F.lower("file_name").endswith(".py"))
    return analysis.profile_trees(code, "program", "code")


@REGISTRY.query("sampling_candidates")
def sampling_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python programs fit for sampling: they parse, have a function and a for loop; cheap tests come before the parse."""
    code = text_table(spark, sf_dir, "code", "program", "file_name", "code").where(F.lower("file_name").endswith(".py") & F.col("code").contains("for") & F.col("code").contains("def"))
    sized = code.select("program", "code", X.non_blank_count(F.col("code")).alias("loc"))
    fit = analysis.profile_trees(sized.where("loc >= 10"), "program", "code").where("syntax_ok AND function_count > 0 AND has_for")
    return sized.join(fit, "program").select("program", "loc", X.loc_bin(F.col("loc")).alias("bin"), "function_count", "loop_count")


@REGISTRY.query("selection_cascade")
def selection_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many Python programs pass each stage of a selection, in one pass."""
    code = text_table(spark, sf_dir, "code", "program", "file_name", "code").where(F.lower("file_name").endswith(".py"))
    loc = code.select("program", X.python_sloc(F.col("code")).alias("loc"))
    rows = analysis.profile_trees(code, "program", "code").join(loc, "program")
    base = F.col("loc").between(20, 500) & (F.col("function_count") >= 1) & (F.col("loop_count") >= 1)
    return rows.agg(
        F.count("*").alias("all_programs"), F.count_if(base).alias("base"), F.count_if(base & (F.col("function_count") >= 2)).alias("two_functions"), F.count_if(base & (F.col("class_count") == 0)).alias("no_class")
    )


def _records(spark: SparkSession, sf_dir: str, *fields: str, strict: bool = False) -> DataFrame:
    code = text_table(spark, sf_dir, "code", "program", "file_name", "code").where(F.lower("file_name").endswith(".py"))
    return analysis.analyse(code, "program", "code", strict, fields or None)


@REGISTRY.query("semantic_records")
def semantic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of facts for every Python program."""
    return _records(spark, sf_dir)


@REGISTRY.query("record_routing")
def record_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs by status of their record."""
    return profile.value_counts(_records(spark, sf_dir, "functions"), "status")


@REGISTRY.query("cfg_statements")
def cfg_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of all programs with their place in the flow, dead ones marked."""
    return analysis.fact_table(_records(spark, sf_dir, "cfg_statements"), "cfg_statements")


@REGISTRY.query("loop_certainty")
def loop_certainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops and whether they surely, never or perhaps run; nested writes are taken into account."""
    return analysis.fact_table(_records(spark, sf_dir, "loops", strict=True), "loops")


@REGISTRY.query("statement_dominators")
def statement_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict dominator pairs between statements."""
    return analysis.fact_table(_records(spark, sf_dir, "strict_dominators"), "strict_dominators")


@REGISTRY.query("variable_dependencies")
def variable_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What assigned variables depend on, and one thing each that they don't."""
    deps = analysis.fact_table(_records(spark, sf_dir, "var_dependencies"), "var_dependencies")
    return deps.select("program", "label", F.col("from.var").alias("var"), F.col("from.line").alias("line"), F.col("depends_on.var").alias("on_var"), F.col("depends_on.line").alias("on_line"))


@REGISTRY.query("dependency_distance")
def dependency_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines between a variable and what it depends on: average and greatest by program, then over programs."""
    deps = variable_dependencies(spark, sf_dir).where("label = 'must'")
    by = deps.groupBy("program").agg(F.bround(F.avg(F.abs(F.col("line") - F.col("on_line"))), 0).alias("avg_gap"), F.max(F.abs(F.col("line") - F.col("on_line"))).alias("max_gap"))
    return by.agg(*[F.bround(f(c).cast("double"), 0).cast("bigint").alias(f"{n}_{c}") for c in ("avg_gap", "max_gap") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])


@REGISTRY.query("live_variables")
def live_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables live before each statement, by windows over each variable's own rows."""
    return dataflow.live_before(analysis.def_use_rows(_records(spark, sf_dir, "steps")), ["program", "function"])


@REGISTRY.query("live_out_variables")
def live_out_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each variable is live at the end of its function."""
    return dataflow.live_out_rows(_records(spark, sf_dir, "steps", "liveness"))


@REGISTRY.query("def_use_pairs")
def def_use_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each use with the definition before it."""
    return dataflow.direct_def_use(analysis.def_use_rows(_records(spark, sf_dir, "steps")), ["program", "function"])


_ONE = """parsed AS (SELECT program, max_by(functions, struct_pack(a := analysed_at, f := file)) AS functions FROM parsed_code GROUP BY program),
fns AS (SELECT program, unnest(functions) AS f FROM parsed), names AS (SELECT DISTINCT program, f.name AS node FROM fns),
calls AS (SELECT DISTINCT program, src, dst FROM (SELECT program, f.name AS src, unnest(f.calls) AS dst FROM fns)),
edges AS (SELECT c.* FROM calls c SEMI JOIN names n ON c.program = n.program AND c.dst = n.node)"""


def parsed_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each program with its functions."""
    records = table(spark, sf_dir, "parsed_code")
    return records.groupBy("program").agg(F.max_by("functions", F.struct("analysed_at", "file")).alias("functions"))


@REGISTRY.query(
    "call_reachability",
    f"""WITH RECURSIVE {_ONE}, paths AS (SELECT program, src, dst FROM edges UNION SELECT p.program, p.src, e.dst FROM paths p JOIN edges e ON p.program = e.program AND p.dst = e.src)
SELECT * FROM paths""",
)
def call_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of functions with a call path, by program."""
    return graph.small_graphs(graph.call_graphs(parsed_functions(spark, sf_dir)), graph.paths_of, ["src", "dst"])


_ENTRY = "entries AS (SELECT program, max_by(f.name, struct_pack(l := f.lineno, n := f.name)) AS node FROM fns GROUP BY program)"


@REGISTRY.query(
    "dead_functions",
    f"""WITH RECURSIVE {_ONE}, {_ENTRY}, live AS (SELECT program, node FROM entries UNION SELECT l.program, e.dst FROM live l JOIN edges e ON l.program = e.program AND l.node = e.src)
SELECT n.program, n.node FROM names n ANTI JOIN live l ON n.program = l.program AND n.node = l.node""",
)
def dead_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that the last function of their program, where it starts, never calls, directly or not."""
    return graph.small_graphs(graph.call_graphs(parsed_functions(spark, sf_dir)), graph.unreached_of, ["node"])


@REGISTRY.query(
    "call_dominators",
    f"""WITH RECURSIVE {_ONE}, {_ENTRY}, live AS (SELECT program, node FROM entries UNION SELECT l.program, e.dst FROM live l JOIN edges e ON l.program = e.program AND l.node = e.src),
inner_nodes AS (SELECT * FROM live EXCEPT SELECT * FROM entries),
around AS (SELECT i.program, i.node AS removed, e.node FROM inner_nodes i JOIN entries e ON i.program = e.program
 UNION SELECT a.program, a.removed, e.dst FROM around a JOIN edges e ON a.program = e.program AND a.node = e.src WHERE e.dst <> a.removed)
SELECT x.program, x.node AS a, y.node AS b FROM inner_nodes x JOIN inner_nodes y ON x.program = y.program AND x.node <> y.node
WHERE NOT EXISTS (SELECT 1 FROM around r WHERE r.program = x.program AND r.removed = x.node AND r.node = y.node)""",
)
def call_dominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions without which another one isn't reached from the entry."""
    return graph.small_graphs(graph.call_graphs(parsed_functions(spark, sf_dir)), graph.dominators_of, ["a", "b"])


@REGISTRY.query(
    "call_components",
    f"""WITH RECURSIVE {_ONE}, both_ways AS (SELECT program, src, dst FROM edges UNION SELECT program, dst, src FROM edges),
paths AS (SELECT program, src, dst FROM both_ways UNION SELECT p.program, p.src, e.dst FROM paths p JOIN both_ways e ON p.program = e.program AND p.dst = e.src)
SELECT program || ':' || src AS id, min(program || ':' || least(src, dst)) AS component FROM paths GROUP BY 1""",
)
def call_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that hang together by calls, named by the least of them."""
    edges = graph.call_edges(parsed_functions(spark, sf_dir))
    named = edges.select(F.concat_ws(":", "program", "src").alias("src"), F.concat_ws(":", "program", "dst").alias("dst"))
    return graph.connected_components(named)


@REGISTRY.query(
    "presence_flags",
    """WITH p AS (SELECT program, coalesce(functions, []) AS fs, coalesce(loops, []) AS ls FROM parsed_code)
SELECT program, len(fs) >= 2 AS has_functions, len(ls) > 0 AS has_loops, len(list_filter(ls, lambda x: x.certainty IN ('always_runs', 'never_runs', 'always', 'never'))) > 0 AS has_sure_loop,
CAST(len(fs) + len(ls) + coalesce(list_sum(list_transform(fs, lambda f: len(coalesce(f.variables, [])))), 0) AS BIGINT) AS score FROM p""",
)
def presence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which facts a record has, and a score of how many."""
    p = table(spark, sf_dir, "parsed_code")
    fs, ls = F.coalesce("functions", F.expr("cast(array() as array<struct<name:string,lineno:int,end_lineno:int,calls:array<string>,variables:array<string>>>)")), F.col("loops")
    n_loops = F.coalesce(F.size(F.when(ls.isNotNull(), ls)), F.lit(0))
    sure = F.coalesce(F.exists(ls, lambda x: x["certainty"].isin("always_runs", "never_runs", "always", "never")), F.lit(False))
    variables = F.aggregate(fs, F.lit(0), lambda a, f: a + F.coalesce(F.size(F.when(f["variables"].isNotNull(), f["variables"])), F.lit(0)))
    n_loops = F.when(ls.isNull(), 0).otherwise(n_loops)
    return p.select("program", (F.size(fs) >= 2).alias("has_functions"), (n_loops > 0).alias("has_loops"), sure.alias("has_sure_loop"), (F.size(fs) + n_loops + variables).cast("bigint").alias("score"))


@REGISTRY.query(
    "variable_multiplicity",
    f"""WITH {_ONE}, v AS (SELECT program, unnest(f.variables) AS var, f.lineno AS line FROM fns)
SELECT program, var, count(*) AS functions, CAST(min(line) AS BIGINT) AS first_line, CASE WHEN count(*) > 1 THEN var || ' (line ' || min(line) || ')' ELSE var END AS shown FROM v GROUP BY 1, 2""",
)
def variable_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables of a program with the functions they occur in; a line tells apart those that occur more than once."""
    each = parsed_functions(spark, sf_dir).select("program", F.explode("functions").alias("f")).select("program", F.explode("f.variables").alias("var"), F.col("f.lineno").alias("line"))
    by = each.groupBy("program", "var").agg(F.count("*").alias("functions"), F.min("line").cast("bigint").alias("first_line"))
    return by.withColumn("shown", F.when(F.col("functions") > 1, F.concat("var", F.lit(" (line "), F.col("first_line").cast("string"), F.lit(")"))).otherwise(F.col("var")))


@REGISTRY.query(
    "next_function_line",
    f"""WITH {_ONE}, l AS (SELECT program, f.name AS name, f.lineno AS lineno FROM fns)
SELECT program, name, CAST(lineno AS BIGINT) AS lineno, CAST(coalesce(lead(lineno) OVER (PARTITION BY program ORDER BY lineno, name), 2147483647) AS BIGINT) AS next_line FROM l""",
)
def next_function_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the function after each function starts; a large number for the last."""
    each = parsed_functions(spark, sf_dir).select("program", F.explode("functions").alias("f")).select("program", "f.name", F.col("f.lineno").cast("bigint").alias("lineno"))
    w = Window.partitionBy("program").orderBy("lineno", "name")
    return each.withColumn("next_line", F.coalesce(F.lead("lineno").over(w), F.lit(2147483647)).cast("bigint"))


@REGISTRY.query(
    "profile_rates",
    """SELECT unique_id, round(CAST(execution_time_cycles AS DOUBLE) / nullif(CAST(instruction_count AS DOUBLE), 0), 9) AS cpi_derived,
round((I1mr + ILmr)::DOUBLE / nullif(instruction_count::DOUBLE, 0), 9) AS instruction_miss_rate, round((D1mr + DLmr + D1mw + DLmw)::DOUBLE / nullif((Dr + Dw)::DOUBLE, 0), 9) AS data_miss_rate FROM exec_profile""",
)
def profile_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates from execution counts; null where the divisor is null or zero. Repeated rows stay."""
    rows = derived_rates(table(spark, sf_dir, "exec_profile"))
    return rows.select("unique_id", *[F.round(c, 9).alias(c) for c in ("cpi_derived", "instruction_miss_rate", "data_miss_rate")])
