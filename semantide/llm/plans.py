"""Queries of the training-data problems."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semantide.llm.encoding import garbled
from semantide.llm.leakage import leaks
from semantide.llm.mixing import Mix
from semantide.llm.neardup import NearDuplicates
from semantide.llm.provenance import not_hand_written
from semantide.llm.quality import quality
from semantide.llm.syntax import Syntax, rates
from semantide.llm.spans import SharedSpans
from semantide.plans import Registry
from semantide.sources.tables import table, text_table

REGISTRY = Registry()

#: Folder of the public tokenizers' vocabularies.
TOKENIZERS = os.environ.get("SEMANTIDE_TOKENIZERS", "/opt/tokenizers")


@REGISTRY.query(
    "p4_found",
    """WITH w AS (SELECT DISTINCT unique_id, substr(code, i, 200) AS s FROM (SELECT unique_id, code, unnest(range(1, length(code) - 198)) AS i FROM code WHERE length(code) >= 200)),
m AS (SELECT list(unique_id) AS ids FROM w GROUP BY s HAVING count(*) > 1), u AS (SELECT DISTINCT list_sort(ids) AS ids FROM m), x AS (SELECT ids, unnest(ids) AS id_a FROM u)
SELECT DISTINCT id_a, id_b FROM (SELECT id_a, unnest(ids) AS id_b FROM x) WHERE id_a < id_b""",
)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of programs with 200 or more successive code points in common."""
    return SharedSpans(text_table(spark, sf_dir, "code", "unique_id", "code"), "unique_id", "code", 200).pairs()


@REGISTRY.query(
    "p4_shared_part",
    """WITH x AS (SELECT unique_id, unnest(range(1, length(code) - 198)) AS i, code FROM code WHERE length(code) >= 200), w AS (SELECT unique_id, i, substr(code, i, 200) AS s FROM x),
r AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT unique_id) > 1), k AS (SELECT * FROM w SEMI JOIN r USING (s)),
g AS (SELECT unique_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY unique_id ORDER BY i) < 200 THEN 0 ELSE 1 END AS fresh FROM k),
n AS (SELECT unique_id, i, sum(fresh) OVER (PARTITION BY unique_id ORDER BY i) AS span FROM g), m AS (SELECT unique_id, span, max(i) + 200 - min(i) AS size FROM n GROUP BY ALL),
c AS (SELECT unique_id, count(*) AS n_spans, sum(size) AS shared_chars FROM m GROUP BY ALL),
p AS (SELECT a.unique_id, a.i, b.unique_id AS other, a.i - b.i AS d FROM k a JOIN k b ON a.s = b.s AND a.unique_id <> b.unique_id),
q AS (SELECT unique_id, other, d, i - row_number() OVER (PARTITION BY unique_id, other, d ORDER BY i) AS run FROM p), t AS (SELECT unique_id, count(*) + 199 AS size FROM q GROUP BY unique_id, other, d, run),
l AS (SELECT unique_id, max(size) AS longest_span FROM t GROUP BY ALL)
SELECT unique_id, length(code)::BIGINT AS n_chars, coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(shared_chars, 0)::BIGINT AS shared_chars, coalesce(longest_span, 0)::BIGINT AS longest_span,
coalesce(shared_chars / nullif(length(code), 0)::DOUBLE, 0) AS shared_part FROM code LEFT JOIN c USING (unique_id) LEFT JOIN l USING (unique_id) WHERE code IS NOT NULL""",
)
def p4_shared_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each program the part of its text that other programs have too, and the longest stretch shared with one of them."""
    code = table(spark, sf_dir, "code").where(F.col("code").isNotNull())
    shared = SharedSpans(text_table(spark, sf_dir, "code", "unique_id", "code"), "unique_id", "code", 200).coverage().withColumnRenamed("id", "unique_id")
    n = F.length("code").cast("long")
    return code.select("unique_id", n.alias("n_chars")).join(shared, "unique_id", "left").select(
        "unique_id",
        "n_chars",
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"),
        F.coalesce("longest_span", F.lit(0)).alias("longest_span"),
        F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)).alias("shared_part"),
    )


@REGISTRY.query(
    "p4_links",
    """WITH reps AS (SELECT code, min(unique_id) AS rep FROM code WHERE length(code) >= 200 GROUP BY code), w AS (SELECT DISTINCT rep, substr(code, i, 200) AS s FROM (SELECT rep, code, unnest(range(1, length(code) - 198)) AS i FROM reps)),
m AS (SELECT list(rep) AS ids FROM w GROUP BY s HAVING count(*) > 1), u AS (SELECT DISTINCT list_sort(ids) AS ids FROM m), x AS (SELECT ids, unnest(ids) AS a FROM u),
l AS (SELECT a, count(*) AS n FROM (SELECT DISTINCT a, b FROM (SELECT a, unnest(ids) AS b FROM x) WHERE a <> b) GROUP BY a)
SELECT unique_id, coalesce(rep, unique_id) AS class_id, coalesce(n, 0) AS n_links FROM code LEFT JOIN reps USING (code) LEFT JOIN l ON l.a = coalesce(rep, unique_id)""",
)
def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a program: the program that stands for its class of equal texts, and how many unlike texts share a stretch with it."""
    spans = SharedSpans(text_table(spark, sf_dir, "code", "unique_id", "code"), "unique_id", "code", 200)
    links = spans.links()
    counts = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    programs = table(spark, sf_dir, "code").select(F.col("unique_id").alias("id"))
    rows = programs.join(spans.classes_of_texts(), "id", "left").select("id", F.coalesce("rep", "id").alias("rep")).join(counts, "rep", "left")
    return rows.select(F.col("id").alias("unique_id"), F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


# Pairs of p3_found as a common table.
_NEAR = """t AS (SELECT unique_id, regexp_extract_all(code, '[A-Za-z0-9_]+') AS t FROM code WHERE code IS NOT NULL),
s AS (SELECT DISTINCT unique_id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS run FROM (SELECT unique_id, t, unnest(range(1, len(t) - 1)) AS i FROM t WHERE len(t) >= 3)),
n AS (SELECT unique_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.unique_id AS id_a, b.unique_id AS id_b, count(*) AS k FROM s a JOIN s b ON a.run = b.run AND a.unique_id < b.unique_id GROUP BY 1, 2),
p AS (SELECT id_a, id_b FROM c JOIN n x ON x.unique_id = id_a JOIN n y ON y.unique_id = id_b WHERE k >= 0.6 * (x.n + y.n - k) - 1e-9)"""


@REGISTRY.query(
    "p3_found",
    f"WITH {_NEAR} SELECT id_a, id_b FROM p",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of programs whose sets of three successive tokens have a similarity of 0.6 or more."""
    return NearDuplicates(text_table(spark, sf_dir, "code", "unique_id", "code"), "unique_id", "code", 0.6, 3).pairs()


@REGISTRY.query(
    "p3_groups",
    f"""WITH RECURSIVE {_NEAR}, b AS (SELECT id_a AS id, id_b AS other FROM p UNION SELECT id_b, id_a FROM p), r AS (SELECT id, other FROM b UNION SELECT r.id, b.other FROM r JOIN b ON r.other = b.id),
g AS (SELECT id, least(id, min(other)) AS group_id FROM r GROUP BY id), l AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT unique_id, coalesce(group_id, unique_id) AS group_id, coalesce(n, 0) AS n_links FROM code LEFT JOIN g ON g.id = unique_id LEFT JOIN l ON l.id = unique_id""",
)
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of programs that are mostly the same, a row for each program; one without a partner is its own group."""
    found = NearDuplicates(text_table(spark, sf_dir, "code", "unique_id", "code"), "unique_id", "code", 0.6, 3).groups().withColumnRenamed("id", "unique_id")
    return table(spark, sf_dir, "code").select("unique_id").join(found, "unique_id", "left").select(
        "unique_id", F.coalesce("group_id", "unique_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


@REGISTRY.query("p5_found")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs with a comment or string that was decoded with a wrong character set."""
    return garbled(text_table(spark, sf_dir, "code", "unique_id", "code"), "unique_id", "code", restored=False).select(F.col("id").alias("unique_id"))


@REGISTRY.query("p5_restored")
def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled programs with the chain of character sets and, where nothing was lost, the original text."""
    found = garbled(text_table(spark, sf_dir, "code", "unique_id", "code"), "unique_id", "code")
    return found.select(
        F.col("id").alias("unique_id"), "chain", "garbled_lines", "lost_lines", F.when(F.col("lost_lines") == 0, F.col("restored")).alias("restored")
    )


def _leaks(spark: SparkSession, sf_dir: str, quoted: bool = False) -> DataFrame:
    return leaks(text_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text", "answer", quoted=quoted)


@REGISTRY.query("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items they give away."""
    return _leaks(spark, sf_dir).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


@REGISTRY.query("p6_passages")
def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked passages with their offsets in the original text."""
    found = _leaks(spark, sf_dir, quoted=True)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "start", "stop", "words", "passage")


@REGISTRY.query("p7_mix")
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the mix and how often each is used."""
    return _mix(spark, sf_dir).chosen().withColumnRenamed("id", "doc_id")


@REGISTRY.query("p7_shares")
def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    return _mix(spark, sf_dir).shares()


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return Mix(text_table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "mix_targets"), table(spark, sf_dir, "common_words"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


@REGISTRY.query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are a list, a table or junk as a whole."""
    rows = quality(text_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", table(spark, sf_dir, "common_words"))
    return rows.where("NOT prose").select(F.col("id").alias("doc_id"))


@REGISTRY.query("p8_quality")
def p8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics and the verdict of every document."""
    return quality(text_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", table(spark, sf_dir, "common_words")).withColumnRenamed("id", "doc_id")


def _not_hand_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_hand_written(text_table(spark, sf_dir, "code", "unique_id", "code", "repo_name", "path", "file_name"), "unique_id", "code", "repo_name", "path", "file_name")


@REGISTRY.query("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are tool output, minified, mostly data, or a copy of an outside project's file."""
    return _not_hand_written(spark, sf_dir).select(F.col("id").alias("unique_id"))


@REGISTRY.query("p1_reasons")
def p1_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files with the reason and, for outside code, the project."""
    return _not_hand_written(spark, sf_dir).withColumnRenamed("id", "unique_id")


def _syntax(spark: SparkSession, sf_dir: str) -> Syntax:
    return Syntax(text_table(spark, sf_dir, "code", "unique_id", "code", "file_name"), "unique_id", "code", "file_name")


@REGISTRY.query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that aren't valid in the language of their extension."""
    return _syntax(spark, sf_dir).invalid().withColumnRenamed("id", "unique_id")


@REGISTRY.query("p2_flags")
def p2_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag for each file, why, and what the semantic record of the program says: without functions it bears no witness."""
    code = table(spark, sf_dir, "code").where("code IS NOT NULL").select("unique_id", "program", "repo_name")
    bad = _syntax(spark, sf_dir).findings().withColumnRenamed("id", "unique_id")
    witness = table(spark, sf_dir, "parsed_code").groupBy("program").agg(F.max(F.coalesce(F.size("functions"), F.lit(0))).alias("functions_seen"))
    return (
        code.join(bad, "unique_id", "left")
        .join(witness, "program", "left")
        .select("unique_id", "repo_name", F.col("reason").isNotNull().alias("invalid"), "reason", F.coalesce("functions_seen", F.lit(0)).alias("functions_seen"))
    )


@REGISTRY.query("p2_rates")
def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of invalid files by repository and language."""
    code = table(spark, sf_dir, "code")
    return rates(code, _syntax(spark, sf_dir).invalid(), "unique_id", "repo_name", "file_name", "code").withColumnRenamed("repo", "repo_name")


@REGISTRY.query(
    "p8_statistics",
    r"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS ws, list_filter(regexp_split_to_array(text, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]'), lambda x: trim(x, ' ' || chr(9)) <> '') AS ls FROM documents WHERE text IS NOT NULL),
k AS (SELECT list(DISTINCT lower(word)) AS words FROM common_words)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(list_avg(list_transform(ws, lambda x: length(x))), 6) AS mean_word_length,
round(length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) / nullif(length(regexp_replace(text, '\s', '', 'g')), 0)::DOUBLE, 6) AS symbol_ratio,
round(len(list_filter(ls, lambda x: regexp_matches(rtrim(x), '([.!?\x{2026}:;]|[.!?]"|[.?!]\)|\.\x{201d}|\.\x{bb})$'))) / nullif(len(ls), 0)::DOUBLE, 6) AS closed_line_share,
round(len(list_filter(ws, lambda x: list_contains(k.words, lower(x)))) / nullif(len(ws), 0)::DOUBLE, 6) AS common_share FROM w, k""",
)
def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of words, their mean length, and the shares of symbols, of lines that end in punctuation and of common words."""
    rows = p8_quality(spark, sf_dir).where("n_words IS NOT NULL")
    return rows.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "closed_line_share", "common_share")])
