"""Scoring while answers arrive: the same expressions over a stream of result files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semantide.functions.verdict import category_name, is_correct, verdict
from semantide.sources.readers import RESULT_FIELDS


def result_stream(spark: SparkSession, path: str, schema: str = f"{RESULT_FIELDS}, logged_at timestamp, received_at timestamp", source: str = "json", files_per_batch: int = 100) -> DataFrame:
    """A stream of result rows from files that appear in ``path``."""
    return spark.readStream.format(source).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def score(rows: DataFrame) -> DataFrame:
    """``rows`` with ``verdict`` read from the first answer, ``scored`` against the truth, and the usual category name."""
    answer = F.try_element_at(F.try_element_at("conversation", F.lit(1))["response"]["generated_texts"], F.lit(1))
    return rows.withColumns({"verdict": verdict(answer), "category": category_name(F.col("category"))}).withColumn("scored", is_correct(F.col("verdict"), F.col("ground_truth")))


def windowed_accuracy(rows: DataFrame, time: str = "logged_at", late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Accuracy by window of time, model and category; rows delivered twice count once, rows later than ``late`` are dropped."""
    once = rows.withWatermark(time, late).dropDuplicatesWithinWatermark(["log_id"])
    scored = score(once)
    return scored.groupBy(F.window(time, width), "model", "category").agg(
        F.count("*").alias("n"), F.count_if("scored").alias("n_correct"), F.count_if(F.col("verdict").isNull()).alias("n_null")
    )


def run(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]):
    """Run a stream over what is there, batch by batch, and stop; ``write`` gets each batch and its number."""
    query = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
