"""Text statistics and layout of documents; which of them are natural prose.

Layout is read from three signals over the lines of a text: delimiters that stand in
as many places on every line or under each other (tables), a marker or an
indentation that returns with a short period (lists), and the lengths of lines: where they repeat with a short period or don't
vary (autocorrelation above ``ECHO``) and the lines are short and hardly ever end a sentence, they are the entries of a list, whatever
words they are made of. Lines that take part in such a layout aren't prose.
Of the rest, stretches of lines count as prose where enough words are common
words of one language and letters, not symbols, make up the text. A document is prose
if more than half of its characters, headings and code left out, are.

Defined results: null texts have null statistics and are not prose; an empty text has zero
words and is not prose. Words are runs of letters, digits and underscores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of common words above which a stretch of lines reads as a language, and the share of a text such stretches need.
COMMON_SHARE, PROSE_SHARE = 0.2, 0.5
#: Autocorrelation of line lengths from which short lines count as entries, the words of a short line, and the share of lines that may end a sentence.
ECHO, ENTRY_WORDS, CLOSED_SHARE = 0.5, 7, 0.3

_WORD = re.compile(r"\w+")
_DELIMITERS = ("\t", "|", ";", ",", ":", "=", "»", ">", "/")
_MARKER = re.compile(
    r"\s*(?:[-*+•·–‣◦]\s+|\(?(?:\d{1,3}|[a-zA-Z]|[ivxlc]{1,6})[.)]\s+|\[[ xX]?\]\s+|\d+(?:\.\d+)+\.?\s+)"
)
_GAP = re.compile(r"\S( {2,}|\t+)(?=\S)")
_SENTENCE_END = (".", "!", "?", "…", ":", ";", '."', '!"', '?"', ".”", ".»", ".)", "?)", "!)")
_CODE_LINE = re.compile(r"^(?: {4}|\t)\s*\S|^\s*(?:def |class |return\b|for .*:$|if .*:$|while .*[:{]$|import |from \w+ import|#include|int |void |char |printf\(|print\(|[}{]\s*;?$)|[;{}]\s*$")


def autocorrelation(values: np.ndarray, most: int = 4) -> float:
    """Largest autocorrelation of a series at lags 1 to ``most``; 1 for a constant one."""
    n = len(values)
    if n < 4:
        return 0.0
    x = values - values.mean()
    power = float((x * x).sum())
    if power < 1e-9:
        return 1.0
    return max(float((x[k:] * x[:-k]).sum()) / power for k in range(1, min(most, n // 2) + 1))


def layout(lines: list[str]) -> tuple[list[bool], str, float, float]:
    """For each line whether it belongs to a table or list; the kind of layout; delimiter agreement; autocorrelation.

    ``lines`` are not blank.
    """
    n = len(lines)
    part = [False] * n
    lengths = np.array([len(x) for x in lines], float)
    echo = autocorrelation(lengths)
    if n < 3:
        return part, "", 0.0, echo
    kind, agreement = "", 0.0
    # Tables: the commonest number of a delimiter, on lines that are mostly cells and not sentences.
    for d in _DELIMITERS:
        counts = [x.count(d) for x in lines]
        often = Counter(c for c in counts if c > 0).most_common(1)
        if not often:
            continue
        usual, times = often[0]
        cells = [i for i, c in enumerate(counts) if c and abs(c - usual) <= max(0, usual // 4) and _cells(lines[i], d)]
        if usual >= (2 if d in ",;:=/" else 1) and len(cells) >= 3 and len(cells) >= 0.3 * n:
            if len(cells) / n > agreement:
                agreement, kind = len(cells) / n, "table"
            for i in cells:
                part[i] = True
    # Columns under each other, set apart by blanks.
    stops = [{m.end() for m in _GAP.finditer(x)} for x in lines]
    shared = Counter(p for s in stops for p in s)
    aligned = [i for i, s in enumerate(stops) if any(shared[p] >= 3 for p in s)]
    if len(aligned) >= 3 and len(aligned) >= 0.3 * n:
        if len(aligned) / n > agreement:
            agreement, kind = len(aligned) / n, "table"
        for i in aligned:
            part[i] = True
    for i, x in enumerate(lines):
        if re.fullmatch(r"[\s|+:=─━┼│-]{3,}", x):
            part[i] = True
    # Lists: markers or indentation that come back with a short period.
    marked = [bool(_MARKER.match(x)) for x in lines]
    def short(i: int) -> bool:
        return len(_WORD.findall(lines[i])) <= 9

    indents = np.array([len(x) - len(x.lstrip()) for x in lines], float)
    periodic = len(set(indents.tolist())) > 1 and autocorrelation(indents) > 0.35
    items = [i for i in range(n) if (marked[i] or (periodic and indents[i] > 0)) and short(i)]
    if len(items) >= 3 and len(items) >= 0.3 * n:
        if len(items) / n > agreement:
            agreement, kind = len(items) / n, "list"
        for i in items:
            part[i] = True
    # Entries of one shape: "name: words", short lines of like length without a sentence.
    each = [_shape(x) for x in lines]
    shape, times = Counter(each).most_common(1)[0]
    if times >= 4 and times >= 0.5 * n and shape[0] != "w":
        if times / n > agreement:
            agreement, kind = times / n, "list"
        for i in range(n):
            if each[i] == shape and short(i):
                part[i] = True
    # Lengths that come back: records of a few lines each, or entries of one length.
    if n >= 6 and echo > ECHO:
        entries = [i for i in range(n) if lines[i].count(" ") < ENTRY_WORDS and len(_WORD.findall(lines[i])) <= ENTRY_WORDS]
        closed = sum(x.rstrip().endswith(_SENTENCE_END) for x in lines)
        if len(entries) >= 0.8 * n and closed <= CLOSED_SHARE * n:
            if len(entries) / n > agreement:
                agreement, kind = len(entries) / n, "list"
            for i in entries:
                part[i] = True
    return part, kind, agreement, echo


def _cells(line: str, d: str) -> bool:
    """Whether what stands between the delimiters is short."""
    parts = line.split(d)
    return sum(len(p.split()) <= 3 for p in parts) >= 0.8 * len(parts)


def _shape(line: str) -> tuple[str, str]:
    """Kinds of the first two tokens of a line."""
    m = re.match(r"\s*(\w+|\S)\s*(\w+|\S)?", line)
    first, second = (m.group(1), m.group(2) or "") if m else ("", "")
    head = "id" if "_" in first else "n" if first.isdigit() else "w" if first[:1].isalpha() else first[:1]
    return head, second if second and not second[:1].isalnum() else ""


class Judge:
    """Statistics and verdict of one text at a time."""

    def __init__(self, common: dict[str, set[str]]):
        self.common = common
        #: For each common word a bit for each language that has it.
        self.bits: dict[str, int] = {}
        for k, words in enumerate(common.values()):
            for w in words:
                self.bits[w] = self.bits.get(w, 0) | 1 << k

    def __call__(self, text: str) -> tuple:
        words = _WORD.findall(text)
        n = len(words)
        bare = sum(map(len, text.split()))
        # A word's characters are letters, digits and underscores; of these the last are symbols.
        symbols = bare - sum(map(len, words)) + text.count("_")
        lines = [x for x in text.splitlines() if x.strip()]
        closed = sum(x.rstrip().endswith(_SENTENCE_END) for x in lines)
        lower = [w.lower() for w in words]
        known = sum(map(self.bits.__contains__, lower))
        part, kind, agreement, echo = layout(lines)
        share = self._prose(lines, part)
        prose = share > PROSE_SHARE
        return (
            n,
            sum(map(len, words)) / n if n else None,
            symbols / bare if bare else None,
            closed / len(lines) if lines else None,
            known / n if n else None,
            agreement,
            echo,
            kind if kind and not prose else "" if prose else "junk",
            share,
            prose,
        )

    def _prose(self, lines: list[str], part: list[bool]) -> float:
        """Share of the characters, headings and code left out, in stretches that read as a language."""
        good = total = 0
        block: list[str] = []
        for line, layed in [*zip(lines, part), ("", True)]:
            if not layed:
                block.append(line)
                continue
            g, t = self._block(block)
            good, total = good + g, total + t
            block = []
            total += len(line.strip())
        return good / total if total else 0.0

    def _block(self, block: list[str]) -> tuple[int, int]:
        good = total = 0
        for start in range(0, len(block), 6):
            chunk = [x for x in block[start : start + 6]]
            size = sum(len(x.strip()) for x in chunk)
            words = _WORD.findall("\n".join(chunk).lower())
            hits = [b for b in map(self.bits.get, words) if b]
            best = max((sum(b >> k & 1 for b in hits) for k in range(len(self.common))), default=0)
            letters = sum(map(len, words))
            if len(words) >= 3 and best >= COMMON_SHARE * len(words) and letters >= 0.6 * size:
                good, total = good + size, total + size
            elif sum(bool(_CODE_LINE.search(x)) for x in chunk) * 2 > len(chunk):
                total += size // 4
            else:
                total += size
        return good, total


_COLUMNS = [
    ("n_words", pa.int64()),
    ("mean_word_length", pa.float64()),
    ("symbol_ratio", pa.float64()),
    ("closed_line_share", pa.float64()),
    ("common_share", pa.float64()),
    ("layout_agreement", pa.float64()),
    ("line_echo", pa.float64()),
    ("layout", pa.string()),
    ("prose_share", pa.float64()),
    ("prose", pa.bool_()),
]
_SQL = {pa.int64(): "long", pa.float64(): "double", pa.string(): "string", pa.bool_(): "boolean"}


def quality(documents: DataFrame, id_col: str, text_col: str, common_words: DataFrame) -> DataFrame:
    """One row for each document: ``id``, the statistics, ``layout`` ("", "table", "list" or "junk"), ``prose``.

    ``common_words`` (``lang``, ``word``) is a fixed table of frequent words; at most 100,000
    rows of it are accepted, since it goes to every task.
    """
    rows = common_words.where("word IS NOT NULL").select("lang", "word").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("common_words must not have more than 100,000 rows")
    common: dict[str, set[str]] = {}
    for r in rows:
        common.setdefault(r["lang"] or "", set()).add(r["word"].lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(common)
        nothing = (None,) * (len(_COLUMNS) - 1) + (False,)
        for batch in batches:
            out = [nothing if t is None else judge(t) for t in batch.column(1).to_pylist()]
            cols = list(zip(*out)) if out else [()] * len(_COLUMNS)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, (_, k) in zip(cols, _COLUMNS)], ["id"] + [c for c, _ in _COLUMNS])

    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} {_SQL[k]}" for c, k in _COLUMNS))
