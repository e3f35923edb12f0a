"""C source read by patterns, for where no compiler front end is at hand; and the texts of loop analyses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words before a parenthesis that are no calls.
NO_CALLS = "if for while switch return sizeof do else case".split()


def brace_block(text: str, start: int) -> str:
    """The text from an opening brace to the one that closes it; empty if none does."""
    depth = 0
    for at in range(start, len(text)):
        depth += (text[at] == "{") - (text[at] == "}")
        if depth == 0:
            return text[start : at + 1]
    return ""


def c_functions(programs: DataFrame, key: str = "program", text: str = "code") -> DataFrame:
    """``key``, ``name``, ``calls``: functions found by their heads, and the names called in their bodies, themselves left out.

    Finding the end of a body needs a count of braces, so bodies are cut in Arrow batches; the rest is expressions.
    Null text has no functions.
    """
    rows = programs.select(key, text).where(F.col(text).isNotNull())
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        head = re.compile(r"^[ \t]*(?:[A-Za-z_][\w \t*]*?[\s*])(\w+)[ \t]*\([^)]*\)\s*\{", re.M)
        for batch in batches:
            owners, names, bodies = [], [], []
            for row, code in enumerate(batch.column(1).to_pylist()):
                for m in head.finditer(code):
                    if m.group(1) not in NO_CALLS:
                        owners.append(row)
                        names.append(m.group(1))
                        bodies.append(brace_block(code, m.end() - 1))
            if owners:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), pa.array(names), pa.array(bodies)], [key, "name", "body"])

    found = rows.mapInArrow(run, f"{key} {kind}, name string, body string")
    called = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b(\w+)\s*\("), 1))
    return found.select(key, "name", F.array_sort(F.array_except(called, F.array(F.col("name"), *map(F.lit, NO_CALLS)))).alias("calls"))


def c_loops(text: Column) -> Column:
    """Array of (header_id, kind, cond) of the loops of a text: first all for, then all while, then all do loops, numbered through."""
    fors = F.transform(F.regexp_extract_all(text, F.lit(r"\bfor\s*\([^;]+;([^;]*);[^)]+\)"), 1), lambda x: F.struct(F.lit("for").alias("kind"), F.trim(x).alias("cond")))
    whiles = F.transform(F.regexp_extract_all(text, F.lit(r"\bwhile\s*\(([^)]*)\)"), 1), lambda x: F.struct(F.lit("while").alias("kind"), F.trim(x).alias("cond")))
    dos = F.transform(F.regexp_extract_all(text, F.lit(r"(\bdo\s*\{)"), 1), lambda x: F.struct(F.lit("do").alias("kind"), F.lit("do-while").alias("cond")))
    return F.transform(F.concat(fors, whiles, dos), lambda x, i: F.struct(i.alias("header_id"), x["kind"].alias("kind"), x["cond"].alias("cond")))


def trip_counts(text: Column) -> Column:
    """Map from loop number to its greatest trip count in a loop analysis; null where that is unknown."""
    rows = F.regexp_extract_all(text, F.lit(r"(Loop #\d+:[^\n]*Backedge[^\n]*count is (?:\d+|unknown))"), 1)
    entries = F.transform(rows, lambda x: F.struct(F.regexp_extract(x, r"Loop #(\d+)", 1).cast("int").alias("k"), F.regexp_extract(x, r"count is (\w+)$", 1).try_cast("bigint").alias("v")))
    return F.map_from_entries(_last_of_each(entries))


def dominated(text: Column) -> Column:
    """Map from node number to the numbers of the nodes it dominates, in a dominator tree's text."""
    rows = F.regexp_extract_all(text, F.lit(r"(Node\s+\d+ dominates:\s*[\d, ]+)"), 1)
    numbers = lambda x: F.transform(F.regexp_extract_all(F.regexp_extract(x, r"dominates:(.*)$", 1), F.lit(r"(\d+)"), 1), lambda n: n.cast("int"))
    return F.map_from_entries(_last_of_each(F.transform(rows, lambda x: F.struct(F.regexp_extract(x, r"Node\s+(\d+)", 1).cast("int").alias("k"), numbers(x).alias("v")))))


def _last_of_each(entries: Column) -> Column:
    """Entries with a key of its own each: the last one given."""
    return F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))


def c_steps(programs: DataFrame, key: str = "program", text: str = "code") -> DataFrame:
    """``key``, ``function``, ``pos``, ``line``, ``var``, ``is_def``, ``is_use`` of the statements of C functions, in textual order.

    A statement is what ends in a semicolon or a brace; it defines the names that are assigned, incremented or declared with a value, and uses
    the other names in it; names of functions that are called, keywords and members after ``.`` and ``->`` are left out.
    Comments and strings are blanked first. Null text has no steps.
    """
    rows = programs.select(key, text).where(F.col(text).isNotNull())
    spec = f"{key} {rows.schema[key].dataType.simpleString()}, function string, pos int, line int, var string, is_def boolean, is_use boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        head = re.compile(r"^[ \t]*(?:[A-Za-z_][\w \t*]*?[\s*])(\w+)[ \t]*\([^)]*\)\s*\{", re.M)
        silent = re.compile(r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'', re.S)
        name = re.compile(r"(?<![\w.])(?<!->)([A-Za-z_]\w*)\b(\s*\()?")
        target = re.compile(r"(?<![\w.])(?<!->)([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)*((?:[-+*/%&|^]|<<|>>)?=(?!=)|\+\+|--)|(?:\+\+|--)\s*([A-Za-z_]\w*)")
        words = frozenset(C_WORDS)
        for batch in batches:
            at, found = [], []
            for row, code in enumerate(batch.column(1).to_pylist()):
                code = silent.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), code)
                for m in head.finditer(code):
                    if m.group(1) in NO_CALLS:
                        continue
                    start = m.end() - 1
                    body, pos = brace_block(code, start), 0
                    for s in re.finditer(r"[^;{}]+", body):
                        defs, uses = set(), set()
                        for t in target.finditer(s.group()):
                            v = t.group(1) or t.group(3)
                            if v in words:
                                continue
                            defs.add(v)
                            if (t.group(2) or "++") != "=":
                                uses.add(v)
                        plain = target.sub(lambda t: " " * len(t.group()) if t.group(2) == "=" and "[" not in t.group() else t.group(), s.group())
                        uses |= {x.group(1) for x in name.finditer(plain) if not x.group(2) and x.group(1) not in words and x.group(1) not in defs}
                        uses |= {v for v in defs if re.search(rf"(?<![\w.])(?<!->){v}\b(?!\s*\()", plain)}
                        if not defs | uses:
                            continue
                        first = start + s.start() + len(s.group()) - len(s.group().lstrip())
                        line = code.count("\n", 0, first) + 1
                        for v in sorted(defs | uses):
                            at.append(row)
                            found.append((m.group(1), pos, line, v, v in defs, v in uses))
                        pos += 1
            if at:
                types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
                names = ("function", "pos", "line", "var", "is_def", "is_use")
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, t) for c, t in zip(zip(*found), types)]], [key, *names])

    return rows.mapInArrow(run, spec)


# Words of C that are no variables.
C_WORDS = (
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union "
    "unsigned void volatile while NULL size_t bool true false uint8_t uint16_t uint32_t uint64_t int8_t int16_t int32_t int64_t"
).split()
