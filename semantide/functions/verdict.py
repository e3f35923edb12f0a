"""Reading a yes or no out of an answer in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from semantide.functions.text import lines

# What counts as an answer line and as a verdict.
_PREFIX = r"(?i)(?:final\s*)?answer\s*:"
_BRACKET = r"(?i)(\[final\s*answer:\s*(?:yes|no)\])"
_VERDICT = r"(?i)(?:final\s*)?answer\s*:\s*(yes|no)"


def verdict(response: Column) -> Column:
    """True, false or null for an answer in words.

    All but letters, digits, brackets, colons and white space is dropped. Lines are read from
    the last to the first; the first one decides that speaks of an answer, has the
    prefix, at most one bracketed verdict, not both words, and verdicts that agree. "answer: not
    sure" reads as no. Null and texts without such a line give null.
    """
    cleaned = F.regexp_replace(response, r"(?U)[^A-Za-z0-9\[\]:\s]", "")

    def hits(line: Column) -> Column:
        return F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit("(?U)" + _VERDICT), 1), F.lower))

    def decides(line: Column) -> Column:
        both = line.rlike(r"(?U)\byes\b") & line.rlike(r"(?U)\bno\b")
        return (
            F.lower(line).contains("answer")
            & (F.size(F.regexp_extract_all(line, F.lit("(?U)" + _BRACKET), 1)) <= 1)
            & line.rlike("(?U)" + _PREFIX)
            & ~both
            & (F.size(hits(line)) == 1)
        )

    deciding = F.filter(F.reverse(lines(cleaned)), decides)
    return F.when(F.size(deciding) > 0, F.element_at(hits(F.try_element_at(deciding, F.lit(1))), 1) == "yes")


def final_answer(parsed: Column) -> Column:
    """"yes" or "no"; an unread verdict counts as no."""
    return F.when(F.coalesce(parsed, F.lit(False)), "yes").otherwise("no")


def is_correct(parsed: Column, truth: Column) -> Column:
    """Whether the verdict equals the truth; a null verdict is never correct where the truth is known."""
    return parsed.eqNullSafe(truth)


def first_response_correct(parsed: Column, truth: Column) -> Column:
    """Like ``is_correct``, but null for an unread verdict."""
    return parsed == truth


#: Other names of categories.
ALIASES = {"deadcode": "dead_code"}
#: Categories in their usual order.
CATEGORIES = ("function_reachability", "loop_reachability", "dominators", "data_dependency", "liveness", "dead_code")


def category_name(category: Column) -> Column:
    """A category by its usual name."""
    plain = F.lower(F.trim(category))
    out = F.when(category.isNull(), F.lit(None).cast("string"))
    for alias, name in ALIASES.items():
        out = out.when(plain == alias, name)
    return out.otherwise(plain)
