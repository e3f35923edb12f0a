"""Expressions over source text, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks as a text editor counts them: also form feed, vertical tab, file separators, NEL and the Unicode separators.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\u0085\u2028\u2029]"

#: Upper bounds of the size classes of a program, in lines of code; the last class is open.
LOC_BOUNDS = (50, 100, 200, 500, 1000, 2000)
LOC_LABELS = ("<=50", "51-100", "101-200", "201-500", "501-1000", "1001-2000", ">2000")


def lines(text: Column) -> Column:
    """Array of the lines of a text; a final break opens no further line, an empty text has none, null gives null."""
    parts = F.split(text, LINE_BREAK)
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text.isNotNull(), trimmed)


def _count(rows: Column, test) -> Column:
    return F.size(F.filter(rows, test))


def _blank(line: Column) -> Column:
    return ~line.rlike(r"(?U)\S")


def line_count(text: Column) -> Column:
    """All lines."""
    return F.size(lines(text))


def non_blank_count(text: Column) -> Column:
    """Lines with anything but white space."""
    return _count(lines(text), lambda x: ~_blank(x))


def strip_c_comments(text: Column) -> Column:
    """C source without comments; line breaks inside them stay, strings and characters are left alone.

    An unfinished block comment runs to the end of the text.
    """
    literal = r"\"(?:\\[\s\S]|\\\z|[^\"\\])*+(?:\"|\z)|'(?:\\[\s\S]|\\\z|[^'\\])*+(?:'|\z)"
    no_line = F.regexp_replace(text, rf"({literal}|/\*(?:[^*]|\*(?!/))*+(?:\*/|\z))|//[^\n]*+", "$1")
    return _drop_blocks(no_line, literal)


def _drop_blocks(text: Column, literal: str) -> Column:
    """Replace each block comment by its line breaks: split on comments, keep the breaks of each."""
    block = r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\z)"
    pieces = F.regexp_extract_all(text, F.lit(rf"({literal}|{block}|[^/\"']++|[/\"'])"), 1)
    kept = F.transform(pieces, lambda p: F.when(p.startswith("/*"), F.regexp_replace(p, r"[^\n]", "")).otherwise(p))
    return F.array_join(kept, "")


def c_sloc(text: Column) -> Column:
    """Lines of C that hold something besides comments."""
    return _count(lines(strip_c_comments(text)), lambda x: ~_blank(x))


def python_comment_count(text: Column) -> Column:
    """Lines whose first visible character is a hash."""
    return _count(lines(text), lambda x: x.rlike(r"(?U)^\s*#"))


def python_sloc(text: Column) -> Column:
    """All lines less blank ones and comment lines."""
    return non_blank_count(text) - python_comment_count(text)


def loc_bin(loc: Column) -> Column:
    """Size class of a number of lines; bounds belong to the smaller class, null gives null."""
    out = F.when(loc.isNull(), F.lit(None).cast("string"))
    for bound, label in zip(LOC_BOUNDS, LOC_LABELS):
        out = out.when(loc <= bound, label)
    return out.otherwise(LOC_LABELS[-1])


def truthy(value: Column) -> Column:
    """Whether a text says yes: true, 1, yes or y in any case; null is no."""
    return F.coalesce(F.lower(F.trim(value)).isin("true", "1", "yes", "y"), F.lit(False))


def lenient_int(value: Column) -> Column:
    """Integer part of a number in a text; 0 where there is none."""
    return F.coalesce(value.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def source_line(text: Column, number: Column) -> Column:
    """Line ``number`` (from 1) without outer blanks; null where there is none."""
    return F.trim(F.try_element_at(lines(text), number.cast("int")))


def numbered(text: Column) -> Column:
    """The text with a line number and a colon before each line."""
    return F.array_join(F.transform(lines(text), lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x)), "\n")


def from_code_map(document: Column) -> Column:
    """Numbered code from a JSON object of line numbers and lines: numbers in their order, then other keys by text; null for what is no object."""
    entries = F.map_entries(F.from_json(document, "map<string, string>"))
    keyed = F.transform(entries, lambda e: F.struct(e["key"].try_cast("bigint").isNull().alias("other"), e["key"].try_cast("bigint").alias("n"), e["key"].alias("key"), e["value"].alias("line")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["line"], F.lit("")))), "\n")


def stem(name: Column) -> Column:
    """File name without directories and its last extension."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    """Last extension with its dot, lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)(\.[^.]*)$", 1))


def language_of(name: Column, declared: Column | None = None) -> Column:
    """Language a caller declares, else that of the extension, else null."""
    by_name = F.when(extension(name) == ".py", "python").when(extension(name) == ".c", "c")
    if declared is None:
        return by_name
    said = F.lower(F.trim(declared))
    return F.when(said.isin("python", "py"), "python").when(said.isin("c", "ansi c"), "c").otherwise(by_name)


def relative_path(path: Column, root: str) -> Column:
    """Path from ``root`` where it lies inside, else as it is."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def stable_seed(seed: Column, name: Column) -> Column:
    """First 16 hex digits of the SHA-256 of ``seed:name`` as a decimal text."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), name), 256), 1, 16), 16, 10)


def header_function(header: Column) -> Column:
    """Name of the function in a C header: the last identifier before the first parenthesis."""
    return F.regexp_extract(header, r"([A-Za-z_]\w*)\s*\([^)]*.*$", 1)


def error_digest(log: Column, most: int = 6) -> Column:
    """First lines of a log that aren't blank, joined by bars."""
    return F.array_join(F.slice(F.filter(F.transform(lines(log), lambda x: F.trim(x)), lambda x: x != ""), 1, most), " | ")
