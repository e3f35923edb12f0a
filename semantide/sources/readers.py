"""Readers of source trees, JSON documents and lines, CSV, logs and tool dumps."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import partial
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semantide.functions.text import header_function, lines, stem

#: Bytes of files that a task holds at a time, beyond the file it reads.
READ_BYTES = 8 << 20
RESULT_FIELDS = (
    "log_id long, model string, program string, category string, prompt string, ground_truth boolean, "
    "conversation array<struct<role string, response struct<generated_texts array<string>>, parsed_decisions boolean>>, first_response_correct boolean, "
    "final_answer string, correct boolean, error string, _usage_list array<struct<input long, cached_input long, output long, reasoning long>>"
)


def programs(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True, errors: str = "replace") -> DataFrame:
    """``path``, ``file_name``, ``program`` (stem), ``code``: each file whole, empty ones too.

    With ``errors`` "replace" bytes that aren't UTF-8 become U+FFFD, with "ignore" they are dropped, with "strict" such a file's code is null.
    Files of the local file system (or of one mounted on all executors) are listed and read by tasks, whose number doesn't depend on that of
    the files. Other file systems are scanned by Spark, which leaves out names that begin with "_" or ".".
    """
    roots = _local_roots(spark, path)
    rows = _local_files(spark, roots, pattern, recursive) if roots else _scanned_files(spark, path, pattern, recursive)
    if errors == "ignore":
        code = rows.mapInArrow(_decode_ignoring, "path string, code string")
    else:
        text = F.col("content").cast("string")
        code = rows.select("path", (F.try_validate_utf8(text) if errors == "strict" else F.make_valid_utf8(text)).alias("code"))
    name = F.regexp_replace("path", r"^.*/", "")
    return code.select("path", name.alias("file_name"), stem(name).alias("program"), "code")


def _local_roots(spark: SparkSession, path: str) -> list[str]:
    """The local files and folders that ``path`` names or matches; none where it is on another file system or isn't there."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().toUri().getPath() for f in fs.globStatus(root) or ()] if fs.getUri().getScheme() == "file" else []


def _local_files(spark: SparkSession, roots: list[str], pattern: str, recursive: bool) -> DataFrame:
    """``path``, ``content`` of local files.

    One task lists what is directly below ``roots``, others what is in the folders found there. Both times the paths, not the contents, are
    dealt out by their hash, so a crowded folder isn't read by the task that lists it.
    """
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern.compile(pattern).pattern()
    found = spark.range(0, 1, 1, 1).mapInArrow(partial(_list_roots, roots, glob, recursive), "path binary, is_folder boolean").repartition(tasks, "path")
    if recursive:
        found = found.mapInArrow(partial(_list_folders, glob), "path binary, is_folder boolean").repartition(tasks, "path")
    return found.select("path").mapInArrow(_read_files, "path string, content binary")


def _entries(folder: str, glob: str) -> Iterator[tuple[str, bool]]:
    """Folders and fitting files directly below ``folder``, and whether they are folders."""
    fits = re.compile(glob, re.DOTALL).fullmatch
    with os.scandir(folder) as entries:
        for e in entries:
            if e.is_dir():
                yield e.path, True
            elif e.is_file() and fits(e.name):
                yield e.path, False


def _list_roots(roots: list[str], glob: str, recursive: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found() -> Iterator[tuple[str, bool]]:
        for root in roots:
            if os.path.isdir(root):
                yield from (e for e in _entries(root, glob) if recursive or not e[1])
            elif re.compile(glob, re.DOTALL).fullmatch(os.path.basename(root)):
                yield root, False

    for _ in batches:
        yield from _listed(found())


def _list_folders(glob: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found(batch: pa.RecordBatch) -> Iterator[tuple[str, bool]]:
        for path, is_folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not is_folder:
                yield os.fsdecode(path), False
            waiting = [os.fsdecode(path)] if is_folder else []
            while waiting:
                for entry in _entries(waiting.pop(), glob):
                    if entry[1]:
                        waiting.append(entry[0])
                    else:
                        yield entry

    for batch in batches:
        yield from _listed(found(batch))


def _listed(found: Iterator[tuple[str, bool]]) -> Iterator[pa.RecordBatch]:
    for part in batched(found, 10_000):
        yield pa.RecordBatch.from_arrays([pa.array([os.fsencode(p) for p, _ in part], pa.binary()), pa.array([d for _, d in part], pa.bool_())], ["path", "is_folder"])


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files whole, in batches of about ``READ_BYTES``."""
    paths, contents, held = [], [], 0

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    for batch in batches:
        for path in batch.column(0).to_pylist():
            with open(path, "rb") as f:
                contents.append(f.read())
            paths.append("file:" + path.decode("utf-8", "replace"))
            held += len(contents[-1]) + len(path)
            if held >= READ_BYTES:
                yield packed()
                paths, contents, held = [], [], 0
    if paths:
        yield packed()


def _scanned_files(spark: SparkSession, path: str, pattern: str, recursive: bool) -> DataFrame:
    """``path``, ``content`` by Spark's scan; it leaves out files of zero bytes, which are taken from the listing."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")
    empty = list(_empty_files(spark, path, pattern, recursive))
    if empty:
        rows = rows.where(F.length("content") > 0).unionByName(spark.createDataFrame([(f, b"") for f in empty], "path string, content binary"))
    return rows


def _decode_ignoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if b is None else b.decode("utf-8", "ignore") for b in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["path", "code"])


def _empty_files(spark: SparkSession, path: str, pattern: str, recursive: bool) -> Iterator[str]:
    """Files of zero bytes below a folder; the listing is the one the scan's own index is made of."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return
    glob = jvm.org.apache.hadoop.fs.GlobFilter(pattern)
    files = fs.listFiles(root, recursive)
    while files.hasNext():
        f = files.next()
        name = f.getPath().getName()
        if f.getLen() == 0 and not name.startswith(("_", ".")) and glob.accept(f.getPath()):
            yield f.getPath().toString()


def suffix_or_none(df: DataFrame, suffix: str, all_files: bool = False) -> DataFrame:
    """Rows whose file name has the suffix or no suffix at all; all with ``all_files``."""
    if all_files:
        return df
    return df.where(F.lower("file_name").endswith(suffix) | ~F.col("file_name").contains("."))


def first_by_stem(df: DataFrame) -> DataFrame:
    """One row for each stem: the first path in order."""
    best = df.groupBy("program").agg(F.min("path").alias("path"))
    return df.join(best, ["program", "path"], "left_semi")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object for each file, with the file's stem as ``program``; malformed files fail the read."""
    df = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return df.withColumn("program", stem(F.col("_metadata.file_name")))


def json_lines(spark: SparkSession, path: str, schema: str = RESULT_FIELDS, required: tuple[str, ...] = ("category",), numbered: bool = False) -> DataFrame:
    """JSON lines with the model's name from the directory; blank lines are skipped, malformed ones raise with their file and text.

    Fields a line lacks are null; a null in ``required`` raises. With ``numbered`` the number of the line is told, too; files
    are then read whole instead of in splits.
    """
    text = spark.read.text(path, recursiveFileLookup=True, wholetext=numbered).select("value", F.col("_metadata.file_path").alias("_file"))
    if numbered:
        text = text.select("_file", F.posexplode(F.split("value", "\r?\n")).alias("_n", "value")).withColumn("_file", F.concat("_file", F.lit(":"), (F.col("_n") + 1).cast("string"))).drop("_n")
    text = text.where(F.trim("value") != "")
    parsed = text.withColumn("row", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    message = F.concat(F.lit("malformed line in "), F.col("_file"), F.lit(": "), F.substring("value", 1, 200))
    good = F.col("row._bad").isNull()
    for name in required:
        good = good & F.col(f"row.{name}").isNotNull()
    checked = parsed.withColumn("row", F.when(good, F.col("row")).otherwise(F.raise_error(message)))
    rows = checked.select("row.*", "_file").drop("_bad")
    folder = F.url_decode(F.replace(F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1), F.lit("+"), F.lit("%2B")))
    # A partitioned writer puts the column's name before the value, escapes it, and has a name for null.
    value = F.url_decode(F.replace(F.regexp_replace(folder, r"^\w+=", ""), F.lit("+"), F.lit("%2B")))
    model = F.when(~folder.rlike(r"^\w+="), folder).when(value != "__HIVE_DEFAULT_PARTITION__", value)
    return rows.withColumn("model", F.coalesce("model", model) if "model" in rows.columns else model).drop("_file")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; fields may span lines and double their quotes; an empty field in quotes is empty, one without is null."""
    df = spark.read.schema(schema).option("emptyValue", "\x01").csv(path, header=True, multiLine=True, escape='"')
    return df.select(*[F.when(F.col(c) == "\x01", "").otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def status_log(df: DataFrame, text: str = "value", order: str = "line_no") -> DataFrame:
    """``file_name``, ``status``, ``message``: the last line "status: file[: message]" for each file."""
    pattern = r"^\s*([\w-]+):\s*([^:\s]+\.\w+)(?::\s*(.*))?\s*$"
    rows = df.select(F.regexp_extract(text, pattern, 1).alias("status"), F.regexp_replace(F.regexp_extract(text, pattern, 2), r"^.*/", "").alias("file_name"), F.regexp_extract(text, pattern, 3).alias("message"), order)
    last = rows.where("file_name <> ''").groupBy("file_name").agg(F.max_by(F.struct("status", "message"), order).alias("s"))
    return last.select("file_name", "s.status", "s.message")


def dump_sections(df: DataFrame, key: str, text: str, marker: str = r"ENTRY") -> DataFrame:
    """``key``, ``section``, ``header``, ``function``, ``line_no``, ``line``: an analyzer dump cut where ``marker`` opens a section.

    The header of a section is the last line before it that isn't blank. Lines stay ordered within their text, so
    the cut is made inside the row, before anything is exploded.
    """
    rows = df.select(F.col(key).alias("key"), lines(F.col(text)).alias("ls"))
    tagged = rows.withColumn(
        "state",
        F.aggregate(
            "ls",
            F.struct(F.lit(0).alias("n"), F.lit("").alias("last"), F.lit("").alias("head"), F.array().cast("array<struct<section:int,header:string,line:string>>").alias("out")),
            lambda a, x: F.struct(
                F.when(x.rlike(marker), a["n"] + 1).otherwise(a["n"]).alias("n"),
                F.when(F.trim(x) != "", x).otherwise(a["last"]).alias("last"),
                F.when(x.rlike(marker), a["last"]).otherwise(a["head"]).alias("head"),
                F.concat(
                    a["out"],
                    F.array(F.struct(F.when(x.rlike(marker), a["n"] + 1).otherwise(a["n"]).alias("section"), F.when(x.rlike(marker), a["last"]).otherwise(a["head"]).alias("header"), x.alias("line"))),
                ).alias("out"),
            ),
        ),
    )
    each = tagged.select("key", F.posexplode("state.out").alias("line_no", "s"))
    return each.where("s.section > 0").select(
        F.col("key").alias(key), F.col("s.section").alias("section"), F.trim("s.header").alias("header"), header_function(F.col("s.header")).alias("function"), "line_no", F.col("s.line").alias("line")
    )


def cfg_blocks(sections: DataFrame, key: str) -> DataFrame:
    """``key``, ``function``, ``block``, ``kind``, ``preds``, ``succs`` from the block headers and edge lines of dump sections."""
    w_line = F.regexp_extract("line", r"\[B(\d+)(?:\s*\((\w+)\))?\]", 1)
    head = sections.where(F.col("line").rlike(r"^\s*\[B\d+(?:\s*\(\w+\))?\]\s*$")).select(
        key, "section", "function", "line_no", w_line.cast("int").alias("block"), F.regexp_extract("line", r"\((\w+)\)", 1).alias("kind")
    )
    edge = sections.where(F.col("line").rlike(r"^\s*(?:Preds|Succs)")).select(
        key, "section", "line_no", F.regexp_extract("line", r"^\s*(\w+)", 1).alias("side"), F.transform(F.regexp_extract_all("line", F.lit(r"B(\d+)"), 1), lambda x: x.cast("int")).alias("others")
    )
    from pyspark.sql import Window

    opened = head.select(key, "section", "line_no", "block", "kind", "function").unionByName(edge.select(key, "section", "line_no", "side", "others"), allowMissingColumns=True)
    w = Window.partitionBy(key, "section").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = opened.select(key, "section", F.last("block", True).over(w).alias("block"), F.last("kind", True).over(w).alias("kind"), F.last("function", True).over(w).alias("function"), "side", "others")
    none = F.array().cast("array<int>")
    return carried.groupBy(key, "section", "function", "block").agg(
        F.first("kind", True).alias("kind"),
        F.coalesce(F.first(F.when(F.col("side") == "Preds", F.col("others")), True), none).alias("preds"),
        F.coalesce(F.first(F.when(F.col("side") == "Succs", F.col("others")), True), none).alias("succs"),
    )


def ir_edges(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``function``, ``src``, ``dst``: successors of the basic blocks in LLVM IR text."""
    functions = df.select(F.col(key), F.explode(F.regexp_extract_all(text, F.lit(r"(define [^\n]*\{[\s\S]*?\n\})"), 1)).alias("body"))
    named = functions.select(key, F.regexp_extract("body", r"@([\w.$]+)\(", 1).alias("function"), F.regexp_replace("body", r"^[^\n]*\n", "entry:\n").alias("body"))
    blocks = named.select(key, "function", F.explode(F.regexp_extract_all("body", F.lit(r"(?:^|\n)([\w.$]+:[\s\S]*?(?=\n[\w.$]+:|\n\}|\z))"), 1)).alias("block"))
    src = F.regexp_extract("block", r"^([\w.$]+):", 1)
    return blocks.select(key, "function", src.alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("block", F.lit(r"label %([\w.$]+)"), 1))).alias("dst"))


def ir_line_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``line``, ``block``: for each source line the first block, by name, that has an instruction of it."""
    places = df.select(F.col(key), F.explode(F.regexp_extract_all(text, F.lit(r"(![0-9]+ = !DILocation\(line: \d+)"), 1)).alias("d")).select(
        key, F.regexp_extract("d", r"^(![0-9]+)", 1).alias("tag"), F.regexp_extract("d", r"line: (\d+)", 1).cast("int").alias("line")
    )
    named = df.select(F.col(key), F.explode(F.regexp_extract_all(text, F.lit(r"(?:^|\n)([\w.$]+:[\s\S]*?(?=\n[\w.$]+:|\n\}|\z))"), 1)).alias("block"))
    uses = named.select(key, F.regexp_extract("block", r"^([\w.$]+):", 1).alias("name"), F.explode(F.array_distinct(F.regexp_extract_all("block", F.lit(r"!dbg (![0-9]+)"), 1))).alias("tag"))
    return uses.join(places, [key, "tag"]).groupBy(key, "line").agg(F.min("name").alias("block"))


# The order of a cachegrind summary.
CACHE_EVENTS = ("instruction_count", "I1mr", "ILmr", "Dr", "D1mr", "DLmr", "Dw", "D1mw", "DLmw")


def cache_summary(text: Column) -> list[Column]:
    """The numbers of a "summary:" line, one column for each event; null where there is none."""
    numbers = F.split(F.trim(F.regexp_extract(text, r"summary:\s+([\d ]+)", 1)), r"\s+")
    return [F.try_element_at(numbers, F.lit(i + 1)).try_cast("bigint").alias(name) for i, name in enumerate(CACHE_EVENTS)]


def derived_rates(df: DataFrame) -> DataFrame:
    """Cycles an instruction, miss rates and frequency from the counts; null for a null or zero divisor."""
    return df.select(
        "*",
        F.try_divide(F.col("execution_time_cycles").cast("double"), F.col("instruction_count").cast("double")).alias("cpi_derived"),
        F.try_divide((F.col("I1mr") + F.col("ILmr")).cast("double"), F.col("instruction_count").cast("double")).alias("instruction_miss_rate"),
        F.try_divide((F.col("D1mr") + F.col("DLmr") + F.col("D1mw") + F.col("DLmw")).cast("double"), (F.col("Dr") + F.col("Dw")).cast("double")).alias("data_miss_rate"),
        F.try_divide(F.col("execution_time_cycles").cast("double"), F.col("execution_time")).alias("frequency"),
    )


def program_list(df: DataFrame, suffix: str = ".c") -> DataFrame:
    """``file_name`` of the programs a list names, once each, the suffix added where it lacks; null and blank names are left out."""
    name = F.trim("program")
    full = F.when(name.endswith(suffix), name).otherwise(F.concat(name, F.lit(suffix)))
    return df.where(F.trim("program") != "").select(full.alias("file_name")).distinct()


def dump_status(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``status`` of a tool's output: EMPTY without any text, STAT_ERROR where it complains, else OK."""
    t = F.coalesce(F.col(text), F.lit(""))
    status = F.when(~t.rlike(r"\S"), "EMPTY").when(t.rlike(r"(?im)^\s*(?:[^\s:]+:\s*)?(?:fatal )?error:"), "STAT_ERROR").otherwise("OK")
    return df.select(F.col(key), status.alias("status"))
