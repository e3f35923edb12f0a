"""Source files nobody wrote by hand: tool output, minified programs, data, copies of outside projects.

One Aho-Corasick automaton holds all cues of generation and origin notices; a text is
scanned once. Where a cue of generation is found, the comments are weighed: each cue has a kind and a weight, the kinds found in a comment add up
(the heaviest cue of each kind counts), a comment at the head of the file counts one more, and ``NOTICE`` is enough for a notice. What
stands before "generated by" and after "auto-generated" tells whether the file is meant or something
it deals with, so that prose that uses the same words ("tokens generated by the lexer", "do not edit the pool by hand while ...") doesn't
count. Where a cue of origin is found, patterns read the project's name. To that come path rules (vendored directories, lock files, minified suffixes), the
share of characters in numbers and encoded strings, the shape of minified code, and the
share of lines that follow a handful of templates. Copies of outside files whose notice was
cut off are found by similarity to the files that still have one, leading comments left out.

Defined results: null texts are never a case; an empty text is one only if its path says so.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semantide.llm.neardup import NearDuplicates
from semantide.sources.shared import materialise

#: Weight of a comment that makes it a notice of generation.
NOTICE = 4

_WEAK, _STRONG = ("created", "made", "written", "compiled", "built"), ("generated", "produced", "emitted", "output")
# Cues of generation notices in lower case, by kind, with their weights.
CUES: dict[str, tuple[str, int]] = (
    {f"{verb} {how}": ("agent", 3) for verb in _STRONG for how in ("by", "from", "with", "using", "via")}
    | {f"{verb} automatically {how}": ("agent", 3) for verb in _STRONG + _WEAK for how in ("by", "from", "with", "using")}
    | {f"{verb} {how}": ("weak", 1) for verb in _WEAK for how in ("by", "from", "with", "using")}
    | {f"{auto}{gap}{verb}": ("auto", 2) for auto in ("auto", "automatically", "machine") for gap in ("", "-", " ") for verb in ("generated", "produced", "created", "written", "made")}
    | dict.fromkeys((
        "automatisch erzeugt", "automatisch generiert", "automatisch erstellt", "généré automatiquement", "générée automatiquement", "généré par", "generado automáticamente", "generada automáticamente",
        "generado por", "gerado automaticamente", "gerada automaticamente", "gerado por", "generato automaticamente", "generato da", "сгенерировано автоматически", "создано автоматически",
        "автоматически сгенерирован", "автоматически создан", "自动生成", "自動生成",
    ), ("auto", 3))
    | {"@generated": ("mark", 4), "buffer-read-only": ("mark", 3), "generated file": ("mark", 3), "code generated": ("mark", 2), "generated code": ("mark", 2), "generated source": ("mark", 2)}
    | {f"{never} {verb}": ("hands", 2) for never in ("do not", "don't", "never", "not be", "not to be") for verb in ("edit", "edited", "modify", "modified", "change", "changed", "touch", "hand-edit")}
    | dict.fromkeys((
        "hands off", "manual change", "manual edit", "manual modification", "hand edit", "changes to this", "edits to this", "changes made to this", "nicht bearbeiten", "nicht ändern", "nicht von hand", "ne pas modifier", "ne pas éditer", "no editar", "no modificar", "não editar", "não modificar", "non modificare",
        "не редактировать", "не изменять", "请勿", "不要修改", "不要编辑", "編集しない", "変更しない", "编辑无效",
    ), ("hands", 2))
    | {f"{what} {how}": ("weak hands", 1) for what in ("changes", "edits", "modifications") for how in ("will", "are", "get", "may", "lost", "made")}
    | dict.fromkeys((" lost", "overwritten", "discarded", "undone", "regenerate", "re-generate", "regenerated"), ("loss", 2))
    | dict.fromkeys(("this file", "this code", "this module", "this source", "this header", "this program", "file is", "file was", "parser", "scanner", "lexer", "bindings", "stubs", "wrapper", "migration"), ("subject", 1))
    | {" instead": ("instead", 1), " output": ("instead", 1)}
)
# Public programs that write source files.
TOOLS = (
    "bison yacc byacc flex lex cython swig protoc protobuf grpc thrift flatc flatbuffers capnp antlr antlr4 javacc re2c ragel lemon gperf pyuic pyuic4 pyuic5 pyuic6 pyrcc pyrcc5 uic moc rcc "
    "django alembic flask-migrate openapi openapi-generator swagger autorest asn1c asn1scc rpcgen gsoap wsdl2py f2c f2py sip pybind11 shiboken boost.python ctypesgen bindgen cbindgen cffi "
    "autoconf automake autogen m4 cmake meson vala valac nim haxe transcrypt emscripten matlab simulink stateflow scade ecl webpack babel terser uglifyjs xxd bin2c sqlc sqlalchemy sqlacodegen "
    "datamodel-codegen xsdata pyxb generateds nanopb glade wxglade wxformbuilder qt designer unicode tablegen"
).split()
CUES |= {tool: ("tool", 2) for tool in TOOLS}
#: Words before "generated by" that mean the file itself.
_ITSELF = frozenset("file code module source header program script is was been are be automatically parser scanner lexer implementation bindings stub stubs wrapper wrappers migration class document and c python output ui".split())

# Patterns of origin notices; the group names the project.
ORIGIN = [
    re.compile(p, re.I)
    for p in (
        r"\b(?:this file|this module|this source|file) is part of (?:the )?([\w.+-]+)",
        r"(?:copyright|\(c\)|©)[^\n]{0,40}?\bthe ([\w.+-]+) (?:project|foundation|developers|authors|contributors)\b",
        r"(?:copyright|\(c\)|©)[ \d,;–—-]*\b([A-Za-z][\w.+-]*) (?:developers|authors|contributors|project)\b",
        r"\b(?:imported|copied|taken|adapted|vendored|borrowed|derived|synced|pulled)\b(?: \w+){0,2}? from (?:the )?(?:upstream )?(?:project )?([\w.+/-]+)[, ]+(?:revision|commit|version|release|tag|rev|at|v?\d)",
        r"\bunchanged from (?:upstream )?([\w.+-]+)",
        r"@license see ([\w.+-]+)/",
        r"\bpart of the ([\w.+-]+)(?: \w+)? (?:toolkit|library|suite|framework|distribution)\b",
        r"^\W*lib([\w+-]+), version \d",
        r"(?:copyright|\(c\)|©)[^\n]{0,80}?\band ([A-Za-z][\w.+-]*) (?:developers|authors|contributors|project)\b",
        r"\b(?:originally|imported|copied|taken|adapted|vendored|borrowed|derived|ported|downloaded|forked|based) (?:from|on) https?://[^\s/]+/(?:[^\s/]+/)*?([\w.+-]+?)(?:\.git)?(?:/(?:blob|tree|raw|archive|releases|commit)\b|[#?\s,;)]|/?$)",
        r"^\W*(?:[\w.+-]+ (?:-+ )?)?(?:the )?(?:public )?interface (?:of|to) the [\'\"`]([\w+.-]+)[\'\"`]",
        r"^\W*([A-Za-z][\w.+-]*)(?: -)? v?\d+(?:\.\d+)?\.\d\d? - [A-Za-z]",
        r"^\W*([\w.+-]+) is free software\b",
        r"__version__\s*=[^\n]*#\s*([\w.+-]+) upstream\b",
        r"^\s*#\s*define\s+(\w+)_VERSION_STRING\b",
    )
]
_BUNDLED = re.compile(r"\bbundled copy\b(?:, | )(?:of|from|snapshot|version|rev)", re.I)

# Cues of origin, in lower case: every match of a pattern holds one of them, in one line, so a text without them needs no patterns.
ORIGIN_CUES = [
    "is part of", "part of the ", "developers", "contributors", "authors", "project", "foundation", "imported", "copied", "taken", "adapted", "vendored", "borrowed",
    "derived", "synced", "pulled", "unchanged from", "@license see ", ", version ", *(f".{k} - " for k in range(100)), "from http", "on http", "interface of the", "interface to the", " is free software", "upstream", "_version_string", "bundled copy",
]

#: Directories for outside projects, one level above the project's own name; suffixes and names of tool output.
_VENDOR_DIR = re.compile(r"(?:^|/)(?:vendor|vendored|third_party|third-party|thirdparty|external|extern|contrib|deps|node_modules|site-packages|submodules)/([\w.+-]+)/")
_STRONG_PATH = re.compile(r"\.min\.(?:py|c|js|css)$|(?:^|/)(?:package-lock\.json|yarn\.lock|poetry\.lock|Pipfile\.lock|Cargo\.lock|go\.sum)$|(?:^|/)node_modules/", re.I)
_TOOL_PATH = re.compile(r"(?:_pb2?|_pb2_grpc|_gen|_generated|_autogen|_tab|_lex|\.gen|\.auto|\.generated|\.yy|\.tab|\.pb)\.(?:py|c|h)$|(?:^|/)(?:gen|generated|autogen|build|out|dist)/", re.I)

# Templates: share of lines in the four commonest, the same where the path names tool output, and lines below which four templates mean nothing.
TEMPLATE_SHARE, TOOL_TEMPLATE_SHARE, TEMPLATE_LINES = 0.9, 0.7, 15
# Data: share of the visible characters, and characters below which a list is no payload. Minified: see _minified.
DATA_SHARE, DATA_CHARS = 0.6, 300

_NUMBERS = re.compile(r"(?:[-+]?(?:0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][-+]?\d+)?)[uUlLfF]*[\s,;:|{}\[\]()]*){4,}")
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{48,}|(?:\\x[0-9a-fA-F]{2}){8,}|(?:\\[0-7]{3}){8,}")
_WORDS = re.compile(r"[A-Za-z_]\w*")
_COMMENT = re.compile(r"\s*(?://|/\*|\*|#(?!\s*(?:define|include|if|ifdef|ifndef|endif|else|elif|undef|pragma)\b))")
_NUM = re.compile(r"0[xX][0-9a-fA-F]+|\d+")
_HEADER = re.compile(r"\s*(?:(?:#(?!\s*(?:define|include|if|ifdef|ifndef|endif|else|elif|undef|pragma)\b)[^\n]*\n|//[^\n]*\n|/\*.*?\*/|\"\"\".*?\"\"\"|'''.*?''')\s*)+", re.S)


def without_header(text: str) -> str:
    """The text after its leading comments."""
    m = _HEADER.match(text)
    return text[m.end() :] if m else text


#: Kinds that can begin a notice; the others only add to it.
_LEADING = frozenset(("agent", "weak", "auto", "mark", "hands", "weak hands"))


def _automaton() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """For texts: 1 for cues of generation, 2 for cues of origin. For comments: a cue, its kind and its weight."""
    quick, full = ahocorasick.Automaton(), ahocorasick.Automaton()
    for cue, (kind, weight) in CUES.items():
        full.add_word(cue, (cue, kind, weight))
        if kind in _LEADING:
            quick.add_word(cue, quick.get(cue, 0) | 1)
    for cue in ORIGIN_CUES:
        quick.add_word(cue, quick.get(cue, 0) | 2)
    quick.make_automaton()
    full.make_automaton()
    return quick, full


def _kinds(cues: ahocorasick.Automaton, text: str) -> int:
    """1 for cues of generation notices, 2 for cues of origin notices, 3 for both."""
    kinds = 0
    for _, kind in cues.iter(text.lower()):
        kinds |= kind
        if kinds == 3:
            break
    return kinds


def weigh(comment: str, head: bool, cues: ahocorasick.Automaton) -> int:
    """Weight of a comment as a notice of generation; ``head`` if nothing but comments stands before it."""
    low = comment.lower()
    weights: dict[str, int] = {}
    for end, (cue, kind, weight) in cues.iter(low):
        start = end - len(cue) + 1
        if cue[0].isalnum() and start and (low[start - 1].isalnum() or low[start - 1] == "_") or cue[-1].isalnum() and cue.isascii() and end + 1 < len(low) and (low[end + 1].isalnum() or low[end + 1] == "_"):
            continue
        if kind == "agent":
            # "Tokens generated by the lexer" is about tokens.
            line = low[low.rfind("\n", 0, start) + 1 : start]
            before = _LAST_WORD.search(line)
            if before and before.group(1) not in _ITSELF and not line.rstrip().endswith((".", ":", ";", ",", "-", "#", "(")):
                weight = 1
        elif kind in ("auto", "hands") and weight == 2 and _STATED.match(low, end + 1):
            weight = 3
        weights[kind] = max(weights.get(kind, 0), weight)
    if not _LEADING & weights.keys():
        return 0
    return sum(weights.values()) + head


_LAST_WORD = re.compile(r"([\w]+)\W*$")
# After "auto-generated" or "do not edit": who did it, or the end of a clause, rather than the noun it goes with.
_STATED = re.compile(r"\s*(?:(?:by|from|with|using|via|durch|mit|von|aus|par|por|da)\b|[-–—,;:!.)]|$)", re.M)


def _comment_blocks(text: str, trailing: bool) -> list[str]:
    """Stretches of successive comment or docstring lines; with ``trailing`` also lines that end in a comment or define a version.

    Notices in strings, as in a program that writes other programs, are not among them.
    """
    lines, blocks, block, inside = text.splitlines(), [], [], ""
    for line in lines:
        s = line.strip()
        if inside:
            block.append(s)
            if inside in s:
                inside = ""
            continue
        m = re.match(r'[rRbBuU]{0,2}("""|\'\'\')', s)
        if m or s.startswith("/*"):
            close = m.group(1) if m else "*/"
            block.append(s)
            if close not in s[m.end() if m else 2 :]:
                inside = close
        elif _COMMENT.match(line):
            block.append(s)
        else:
            if block:
                blocks.append("\n".join(block))
                block = []
            if trailing:
                at = max(s.rfind(" # "), s.rfind("//"), s.rfind("/*"))
                if s.startswith("#") or at > 0 and s.count('"', 0, at) % 2 == 0 and s.count("'", 0, at) % 2 == 0:
                    blocks.append(s)
    if block:
        blocks.append("\n".join(block))
    return blocks


def _bare(line: str) -> str:
    return re.sub(r"^[\s#/*!\"'-]+|[\s#/*!\"']+$", "", line)


def generated_notice(text: str, cues: ahocorasick.Automaton | None = None) -> bool:
    """Whether a comment says that a program made the file."""
    cues = cues or _automaton()[1]
    first = text.lstrip("\ufeff \t\r\n")[:3]
    head = first[:1] == "#" and not _DIRECTIVE.match(first) or first[:2] in ("//", "/*") or first in ('"""', "'''")
    for block in _comment_blocks(text, False):
        if weigh("\n".join(_bare(x) for x in block.split("\n")), head, cues) >= NOTICE:
            return True
        head = False
    return False


_DIRECTIVE = re.compile(r"#\s*(?:de|in|if|pr|un|er|el|en)")


def origin(text: str, repo: str | None) -> str | None:
    """Name of the outside project a comment gives as origin."""
    own = set(re.split(r"[^a-z0-9]+", (repo or "").lower())) | {(repo or "").lower()}
    for block in _comment_blocks(text, True):
        lines = [_bare(x) for x in block.split("\n")] if not block.startswith(("#define", "# define")) else [block]
        for line in lines:
            for p in ORIGIN:
                m = p.search(line)
                if m:
                    name = m.group(1).lower().strip(".-")
                    if name not in own and name not in ("this", "the", "course", "our", "a", "an"):
                        return name
            if _BUNDLED.search(line):
                return "bundled"
    return None


def _minified(text: str, words: list[str]) -> bool:
    n = len(text)
    if len(words) <= 40:
        return False
    lines = text.count("\n") + 1
    blanks = sum(map(text.count, " \t\n\r"))
    if blanks >= 0.12 * n:
        return False
    longest = max(map(len, text.split("\n")))
    return (n / lines > 100 or longest > 400) and sum(map(len, words)) / len(words) < 3.4


def _data_share(text: str, raw: bytes, parts: list[str], solid: int) -> float:
    """Share of the visible characters in lists of numbers and in encoded strings; 0 where a bound shows that it isn't above ``DATA_SHARE``.

    Numbers need a digit in twelve characters and consist of what ``_NUMERIC`` has; an
    encoded string is in a stretch of 32 characters without blanks.
    """
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    numeric = len(raw) - len(raw.translate(None, _NUMERIC)) if digits * 12 >= solid else 0
    encoded = sum(n for n in map(len, parts) if n >= 32)
    if numeric + encoded <= DATA_SHARE * solid:
        return 0.0
    data = 0
    if numeric:
        data += sum(len("".join(m.group().split())) for m in _NUMBERS.finditer(text))
    if encoded:
        data += sum(len(m.group()) for m in _ENCODED.finditer(text))
    return data / solid if solid else 0.0


def _template_bound(raw: bytes) -> float:
    """At least the share of the code lines in their four commonest templates: punctuation alone makes fewer templates."""
    lines = [x for x in map(bytes.strip, raw.translate(None, _WORD_BYTES).splitlines())]
    shapes = Counter(lines)
    shapes.pop(b"", None)
    n = sum(k for x, k in shapes.items() if not x.startswith((b"#", b"/", b"*")))
    return sum(k for _, k in shapes.most_common(4)) / n if n else 1.0


def _template_share(text: str) -> tuple[float, int]:
    """Share of the code lines in their four commonest templates, words and numbers left open, and their number."""
    flat = _WORDS.sub("x", _NUM.sub("0", text)).splitlines()
    shapes = Counter(t.strip() for line, t in zip(text.splitlines(), flat) if t and not t.isspace() and not _COMMENT.match(line))
    n = sum(shapes.values())
    return (sum(k for _, k in shapes.most_common(4)) / n if n else 0.0), n


_NUMERIC = b"0123456789abcdefABCDEFxXuUlL,;:|{}[]()-+."
_WORD_BYTES = bytes(range(0x80, 0x100)) + b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    quick, cues = _automaton()
    for batch in batches:
        repos, paths, names, texts = (batch.column(i).to_pylist() for i in range(1, 5))
        out: list[list] = [[] for _ in range(7)]
        for repo, path, name, text in zip(repos, paths, names, texts):
            text = text or ""
            place = path or name or ""
            kinds = _kinds(quick, text)
            notice = bool(kinds & 1) and generated_notice(text, cues)
            project = origin(text, repo) if kinds & 2 else None
            words = _WORDS.findall(text)
            parts = text.split()
            solid = sum(map(len, parts))
            raw = text.encode("utf-8", "surrogatepass")
            data = _data_share(text, raw, parts, solid)
            dense = data > DATA_SHARE and solid > DATA_CHARS
            wanted = TOOL_TEMPLATE_SHARE if _TOOL_PATH.search(place) else TEMPLATE_SHARE
            templated = False
            if _template_bound(raw) >= wanted:
                share, lines = _template_share(text)
                templated = lines >= TEMPLATE_LINES and share >= wanted
            folder = _VENDOR_DIR.search(place)
            in_folder = folder.group(1).lower() if folder else None
            if project is None and in_folder and re.search(rf"(?<![a-z]){re.escape(in_folder)}(?![a-z])", text.lower()):
                project = in_folder
            for column, value in zip(
                out, (notice, project, _minified(text, words) or bool(_STRONG_PATH.search(place)), dense, templated, in_folder, data)
            ):
                column.append(value)
        types = [pa.bool_(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.float64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0)] + [pa.array(c, t) for c, t in zip(out, types)],
            ["id", "notice", "project", "minified", "payload", "templated", "folder", "data_share"],
        )


def not_hand_written(df: DataFrame, id_col: str, text_col: str, repo_col: str, path_col: str, name_col: str) -> DataFrame:
    """``id``, ``reason``, ``project``: one row for each file that nobody wrote by hand for its repository.

    ``reason`` is the first of "generated", "minified", "payload", "vendored" and "vendored copy" that holds.
    """
    rows = df.select(
        F.col(id_col).alias("id"), F.col(repo_col).alias("repo"), F.col(path_col).alias("path"), F.col(name_col).alias("name"), F.col(text_col).alias("text")
    ).where("text IS NOT NULL")
    kind = rows.schema["id"].dataType.simpleString()
    signs = materialise(
        rows.mapInArrow(_mapper, f"id {kind}, notice boolean, project string, minified boolean, payload boolean, templated boolean, folder string, data_share double")
        .where("notice OR project IS NOT NULL OR minified OR payload OR templated OR folder IS NOT NULL"),
        "signs",
    )
    # A directory named after a project that notices elsewhere name, in the folders for outside code.
    projects = signs.where("project IS NOT NULL").select(F.col("project").alias("folder")).distinct().withColumn("known", F.lit(True))
    judged = signs.join(projects, "folder", "left").withColumn("project", F.coalesce("project", F.when(F.col("known"), F.col("folder"))))
    reason = (
        F.when(F.col("notice") | F.col("templated"), "generated").when(F.col("minified"), "minified").when(F.col("payload"), "payload").when(F.col("project").isNotNull(), "vendored")
    )
    direct = materialise(judged.select("id", reason.alias("reason"), "project").where("reason IS NOT NULL"), "direct")
    # Copies without notice: at least 0.8 of the runs of five words in common with a file that has one.
    outside = direct.where("project IS NOT NULL").select("id", "project")
    near = NearDuplicates(rows, "id", "text", 0.8, 5, prepare=without_header, probes=outside.select("id"))
    partners = near.partners()
    copies = (
        partners.join(outside.select(F.col("id").alias("other"), "project"), "other")
        .groupBy("id")
        .agg(F.min("project").alias("project"))
        .join(direct.select("id"), "id", "left_anti")
        .select("id", F.lit("vendored copy").alias("reason"), "project")
    )
    return direct.unionByName(copies)
