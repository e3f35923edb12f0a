"""Evaluation passages inside a training corpus.

Every question, followed by its answer, is normalised to words, and every run of ``SEED``
successive words goes into one Aho-Corasick automaton. A document is normalised
the same way and scanned once; where a seed of an item ends, the item's words are
aligned with the document's around it. An item leaks where ``min_words`` successive
words of it follow each other in the document with single words replaced, at most one
in ten over the passage's whole length, and at most one inserted aside.
An aside of up to ``ASIDE`` words may stand anywhere; a longer one, of any length, must have ``SEED`` unchanged words of the item
on either side, as otherwise any later use of the item's next word would count.
Offsets of the normalised words are kept, so each leak is reported with its place in the original text.

Any such passage holds ``SEED`` words in a row: r replaced words and an aside leave r + 2
parts at most, of which one has five words or more when ``min_words`` is 15 (14 words in
three parts, 18 in four, 27 in five and so on).

The automaton is built for blocks of items of about ``BLOCK_WORDS`` words, and the
documents are scanned once for each block, so what is held by the driver and sent to a task is bounded
whatever the size of the evaluation set.

Defined results: null or empty documents and items never match; an item, or a question without its answer, that is shorter than
``min_words`` words matches as a whole only.
"""

from __future__ import annotations

import html
import itertools
import itertools
import itertools
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semantide.sources.shared import materialise

SEED = 4
BLOCK_WORDS = 400_000
#: Words of an aside that needs nothing else to show.
ASIDE = 40

# Markup, entities and escapes separate or vanish; a word is letters and digits, joined by apostrophes or underscores.
_PIECES = re.compile(
    r"<[/!]?[A-Za-z][^<>\n]{0,200}>"  # tags
    r"|&(?:[A-Za-z]{2,8}|\#\d{1,6}|\#x[0-9A-Fa-f]{1,5});"  # entities
    r"|\\[nrt](?![A-Za-z])|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}"  # escapes
    r"|[^\W_]+(?:(?:\\?_|['’]|[-­]\r?\n[ \t>*#|]*(?=[a-z]))[^\W_]+)*"
)
_JOINTS = re.compile(r"[\\_'’­]|-\r?\n[ \t>*#|]*")


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """Normalised words of a text and where each starts and stops."""
    words, starts, stops = [], [], []
    for m in _PIECES.finditer(text):
        piece = m.group()
        first = piece[0]
        if first == "<":
            continue
        if first == "&":
            piece = html.unescape(piece)
            if not piece.isalnum():
                continue
        elif first == "\\":
            if piece[1] in "nrt":
                continue
            piece = chr(int(piece[2:], 16))
            if not piece.isalnum():
                continue
        if not piece.isascii():
            piece = "".join(c for c in unicodedata.normalize("NFKD", piece) if not unicodedata.combining(c))
        piece = _JOINTS.sub("", piece).lower()
        if piece:
            words.append(piece)
            starts.append(m.start())
            stops.append(m.end())
    return words, starts, stops


_PLAIN = re.compile(r"[a-z0-9]+").findall
_SPECIAL = re.compile(r"[<&\\]|-\r?\n|[^\x00-\x7f]|[_'][_']").search
_SILENT = str.maketrans("", "", "_'")


def quick_words(text: str) -> list[str]:
    """The words alone; texts without markup, escapes and foreign letters take a short way."""
    if _SPECIAL(text):
        return words_of(text)[0]
    return _PLAIN(text.lower().translate(_SILENT))


_Starts = tuple[tuple[int, int], ...]


def _align(item: list[str], question: int, doc: list[str], places: list[tuple[int, int]], need: int) -> tuple[int, int, int] | None:
    """First and last document word, and item words, of the best passage; None below ``need`` words, or the whole question where it is shorter.

    ``places`` are the stretches of the document in which the item can be.
    """
    where = defaultdict(list)
    for j, w in enumerate(item):
        where[w].append(j)
    most = max(1, len(item) // 10)
    # best[(j, d)]: for no aside and one aside, by the number of replaced words the earliest (first item word, first document word)
    best: dict[tuple[int, int], tuple[_Starts | None, _Starts | None, int]] = {}
    by_j: dict[int, list[int]] = defaultdict(list)
    # The earliest starts of parts that end with an item word after ``SEED`` unchanged words, and the document words they end at.
    parts: dict[int, list[tuple[int, _Starts]]] = defaultdict(list)
    found = None
    for d in (d for lo, hi in places for d in range(lo, hi)):
        for j in where.get(doc[d], ()):
            plain: _Starts | None = ((j, d),)
            parted: _Starts | None = None
            run = 1  # unchanged words up to here
            before = best.get((j - 1, d - 1))
            if before:
                plain, parted, run = before[0], before[1], before[2] + 1
            else:
                skipped = best.get((j - 2, d - 2))
                if skipped:
                    plain = ((j, d), *skipped[0][:most])
                    parted = ((j, d), *skipped[1][:most]) if skipped[1] else None
            for d0 in reversed(by_j.get(j - 1, ())):
                if d - d0 > ASIDE:
                    break
                if d0 < d - 1:
                    parted = _longer(parted, best[(j - 1, d0)][0])
            if run == SEED:
                # What is unchanged from item word j - SEED + 1 on may go on after a long aside.
                for d0, starts in parts.get(j - SEED, ()):
                    if d0 < d - SEED:
                        parted = _longer(parted, starts)
            best[(j, d)] = plain, parted, run
            by_j[j].append(d)
            if run >= SEED:
                kept = parts[j]
                merged = _longer(kept[-1][1], plain) if kept else plain
                if not kept or merged != kept[-1][1]:
                    kept.append((d, merged))
            for starts in (plain, parted):
                for replaced, (start, first) in enumerate(starts or ()):
                    n = j - start + 1
                    enough = n >= need or start == 0 and n >= question
                    if enough and replaced * 10 <= n and (found is None or n > found[2]):
                        found = (first, d, n)
    return found


def _longer(a: _Starts | None, b: _Starts | None) -> _Starts | None:
    """For each number of replaced words the earlier start."""
    if a is None or b is None:
        return a or b
    return tuple(map(min, a, b)) + (a[len(b) :] or b[len(a) :])


def _fewest_seeds(n: int) -> int:
    """How many seeds any passage of ``n`` words or more holds: a replaced word breaks up to ``SEED`` of them, an aside one less."""
    return max(1, min(m - 2 * (SEED - 1) - SEED * (m // 10) for m in range(n, n + 30)))


def _words_suffice(item: list[str], there: set[str], n: int) -> bool:
    """Whether some ``n`` successive words of an item are in the document but for those that may be replaced.

    A passage of m words has m / 10 replaced ones at most; some ``n`` of its words in a row have no more than n / 10 rounded up.
    """
    known = list(itertools.accumulate((w in there for w in item), initial=0))
    return max(map(int.__sub__, known[n:], known)) >= n - -(-n // 10)


def _scan_mapper(items: list[tuple[object, list[str], int]], min_words: int, id_type: pa.DataType, quoted: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        seeds: dict[str, list[int]] = defaultdict(list)
        for k, (_, words, question) in enumerate(items):
            n = min(SEED, len(words), question or len(words))
            for i in range(len(words) - n + 1):
                key = f" {' '.join(words[i : i + n])} "
                if not seeds[key] or seeds[key][-1] != k:
                    seeds[key].append(k)
        least = [_fewest_seeds(min(min_words, len(words), question or len(words))) for _, words, question in items]
        for key, owners in seeds.items():
            automaton.add_word(key, (key.count(" ") - 1, owners))
        if seeds:
            automaton.make_automaton()
        for batch in batches:
            docs, out = batch.column(0).to_pylist(), []
            for doc_id, text in zip(docs, batch.column(1).to_pylist()):
                if not text or not seeds:
                    continue
                line = f" {' '.join(quick_words(text))} "
                hits: dict[int, list[int]] = defaultdict(list)
                counted, at = 0, 0
                for end, (_, owners) in automaton.iter(line):
                    counted += line.count(" ", at, end)
                    at = end
                    for k in owners:
                        hits[k].append(counted - 1)
                if not hits:
                    continue
                likely = [(k, ends) for k, ends in hits.items() if len(ends) >= least[k]]
                if not likely:
                    continue
                words, starts, stops = words_of(text)
                there = set(words)
                for k, ends in likely:
                    item_id, item, question = items[k]
                    need = min(min_words, len(item))
                    if not _words_suffice(item, there, min(need, question or need)):
                        continue
                    reach = len(item) + ASIDE + 2
                    places: list[tuple[int, int]] = []
                    for e in ends:
                        lo, hi = max(0, e - reach), min(len(words), e + reach)
                        if places and lo <= places[-1][1]:
                            places[-1] = places[-1][0], max(hi, places[-1][1])
                        else:
                            places.append((lo, hi))
                    best = _align(item, question or need, words, places, need)
                    if best:
                        a, b = starts[best[0]], stops[best[1]]
                        out.append((doc_id, item_id, a, b, best[2], text[a:b] if quoted else None))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], id_type)] + [pa.array(c, pa.int64()) for c in cols[2:5]] + [pa.array(cols[5], pa.string())],
                    ["doc", "item", "start", "stop", "words", "passage"],
                )

    return run


def leaks(
    documents: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, item_answer: str | None = None, min_words: int = 15, quoted: bool = False
) -> DataFrame:
    """``doc``, ``item``, ``start``, ``stop``, ``words``, ``passage``: one row for each document and item it gives away.

    ``start`` and ``stop`` are code point offsets of the longest passage in the original text,
    ``words`` the item's words in it, ``passage`` its text if ``quoted``, else null. See the module's text.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    docs = documents.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text"))
    answer = F.coalesce(F.col(item_answer), F.lit("")) if item_answer else F.lit("")
    rows = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"), answer.alias("answer")).where("text IS NOT NULL").distinct()
    item_type, doc_type = rows.schema["item"].dataType, docs.schema["doc"].dataType
    schema = f"doc {doc_type.simpleString()}, item {item_type.simpleString()}, start long, stop long, words long, passage string"
    # Six characters a word; the driver holds one block at a time.
    size = rows.agg(F.sum(F.length("text") + F.length("answer"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * BLOCK_WORDS)))
    found = None
    for block in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item", "text", "answer"), F.lit(blocks)) == block)
        words = [(r["item"], words_of(f"{r['text']} {r['answer']}")[0], len(words_of(r["text"])[0])) for r in part.toLocalIterator()]
        hits = docs.mapInArrow(_scan_mapper([w for w in words if w[1]], min_words, to_arrow_type(item_type), quoted), schema)
        hits = hits if blocks == 1 else materialise(hits, "leaks")
        found = hits if found is None else found.unionByName(hits)
    return found
