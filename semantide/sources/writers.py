"""Sinks: partitioned JSON and CSV, a file a row, routed records, plans of file moves, a LaTeX table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines, in a directory for each value of ``by``."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def ordered_columns(df: DataFrame, preferred: list[str]) -> DataFrame:
    """Preferred columns that exist, in their order, then the others by name."""
    return df.select(*[c for c in preferred if c in df.columns], *sorted(c for c in df.columns if c not in preferred))


def write_csv(df: DataFrame, path: str, preferred: list[str] | None = None, sep: str = ",") -> None:
    """CSV with a header, preferred columns first."""
    ordered_columns(df, preferred or df.columns).write.mode("overwrite").option("header", "true").option("sep", sep).option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def write_routed(records: DataFrame, path: str, status: str = "status") -> None:
    """Records by status: complete and incomplete ones in directories of their own."""
    records.write.mode("overwrite").partitionBy(status).json(path)


def move_plan(wanted: DataFrame, here: DataFrame, there: DataFrame) -> DataFrame:
    """``file_name``, ``action``: what moving each wanted file would do, by content.

    ``here`` and ``there`` have ``file_name`` and ``code``. Actions: move, already (only at the target), deduplicate (the
    same on both sides), conflict (both, but different), missing.
    """
    a = here.select("file_name", F.sha2("code", 256).alias("a"))
    b = there.select("file_name", F.sha2("code", 256).alias("b"))
    rows = wanted.select("file_name").distinct().join(a, "file_name", "left").join(b, "file_name", "left")
    action = (
        F.when(F.col("a").isNull() & F.col("b").isNull(), "missing").when(F.col("a").isNull(), "already").when(F.col("b").isNull(), "move").when(F.col("a") == F.col("b"), "deduplicate").otherwise("conflict")
    )
    return rows.select("file_name", action.alias("action"))


def latex_table(rows: list[tuple[str, ...]], head: tuple[str, ...], caption: str) -> str:
    """A LaTeX table of a few rows; numbers get thousands separators."""
    def cell(x: object) -> str:
        return f"{x:,}" if isinstance(x, int) else str(x).replace("_", r"\_").replace("%", r"\%")

    body = "\n".join(" & ".join(map(cell, r)) + r" \\" for r in rows)
    return "\n".join(
        [r"\begin{table}", r"\centering", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{l{'r' * (len(head) - 1)}}}", r"\hline", " & ".join(head) + r" \\", r"\hline", body, r"\hline", r"\end{tabular}", r"\end{table}"]
    )


def write_files(df: DataFrame, path: str, name: str, content: str) -> int:
    """Each row's ``content`` (text or bytes) as a file of its own at ``name`` below ``path``; the number of files.

    An export for tools that want files: the tasks write them, a repeated task writes the same again. Rows without name or content have no file;
    without any file ``path`` is an empty folder.
    """
    rows = df.select(F.col(name).cast("string").alias("name"), F.col(content).cast("binary").alias("content")).where("name IS NOT NULL AND content IS NOT NULL")
    place = path if ":" in path.split("/")[0] else "file://" + path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(place)
        made = set()
        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = f"{root}/{n}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(target) as out:
                    out.write(c)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    fs, root = FileSystem.from_uri(place)
    fs.create_dir(root, recursive=True)
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def report_line(label: str, value: float, digits: int | None = None) -> str:
    """One line of a fixed report: integers with thousands separators, others with a fixed number of digits."""
    return f"{label}: {value:,}" if digits is None else f"{label}: {value:.{digits}f}"
