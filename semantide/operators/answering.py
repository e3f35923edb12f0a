"""Asking models: tasks in, result rows out, whatever answers them.

A responder is a Python callable from (model, prompt) to a text and, if there is one, a usage text in JSON. It runs inside
Arrow batches, so a partition is a worker of its own; an exception becomes an error row and never
stops the others. Tests and replays use a table of recorded answers instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semantide.functions.verdict import final_answer, first_response_correct, is_correct, verdict

Responder = Callable[[str, str], tuple[str, str | None]]


def usage_fields(usage: Column) -> Column:
    """(input, cached_input, output, reasoning) from usage in JSON, of either of two usual shapes; 0 for what is missing."""
    def number(*paths: str) -> Column:
        return F.coalesce(*[F.get_json_object(usage, p).try_cast("bigint") for p in paths], F.lit(0).cast("bigint"))

    return F.struct(
        number("$.input_tokens", "$.prompt_tokens").alias("input"),
        number("$.input_tokens_details.cached_tokens", "$.prompt_tokens_details.cached_tokens").alias("cached_input"),
        number("$.output_tokens", "$.completion_tokens").alias("output"),
        number("$.output_tokens_details.reasoning_tokens", "$.completion_tokens_details.reasoning_tokens").alias("reasoning"),
    )


def scored(rows: DataFrame) -> DataFrame:
    """Rows with ``answer``, ``ground_truth`` and ``error`` as result rows; error rows have no verdict of any kind."""
    v, t, fine = F.col("verdict"), F.col("ground_truth"), F.col("error").isNull()
    read = rows.withColumn("verdict", F.when(F.col("error").isNull(), verdict(F.col("answer"))))
    return read.withColumns(
        {
            "final_answer": F.when(fine, final_answer(v)),
            "correct": F.when(fine, is_correct(v, t)),
            "first_response_correct": F.when(fine, first_response_correct(v, t)),
        }
    )


def ask(tasks: DataFrame, model: str, responder: Responder) -> DataFrame:
    """``tasks`` (with ``prompt`` and ``ground_truth``) with the answers of a model, scored.

    Null prompts give error rows. Asking is repeated where a task is retried, so responders should be idempotent.
    """
    kept = tasks.columns
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.schema) + ", answer string, usage string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, usages, errors = [], [], []
            for prompt in batch.column(kept.index("prompt")).to_pylist():
                answer = usage = error = None
                try:
                    if prompt is None:
                        raise ValueError("no prompt")
                    answer, usage = responder(model, prompt)
                except Exception as e:  # noqa: BLE001 - any failure of a model is a row
                    error = f"{type(e).__name__}: {e}"
                answers.append(answer)
                usages.append(usage)
                errors.append(error)
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(c, pa.string()) for c in (answers, usages, errors)], [*kept, "answer", "usage", "error"])

    return scored(tasks.mapInArrow(run, spec)).withColumn("model", F.lit(model)).withColumn("usage", usage_fields(F.col("usage")))


def replay(tasks: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """``tasks`` answered from a table of recorded answers (``keys``, ``answer``); what it lacks is an error row."""
    known = recorded.select(*keys, "answer", F.lit(True).alias("_hit"))
    joined = tasks.join(known, keys, "left").withColumn("error", F.when(F.col("_hit").isNull(), F.lit("no recorded answer")).cast("string"))
    return scored(joined.drop("_hit"))
