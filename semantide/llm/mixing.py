"""Mixing sources to target shares of all tokens.

Each source gets its share of a total. A source smaller than its share is used in complete
epochs first; what is left of its budget is drawn by Efraimidis-Spirakis sampling:
every text has an exponential key divided by its quality weight, and the texts with the
least keys are taken while they fit. No text is used more than ``max_repeats`` times;
copies of a text count as one text, whatever their ids.

The prefix sums run over a histogram: a key k is in bucket ``BUCKETS * (1 - exp(-k * LEAST_WEIGHT))``. A text of weight
w falls into a given bucket with a probability of w / ``LEAST_WEIGHT`` / ``BUCKETS`` at most, so whatever the weights no bucket has more than
about one in 10,000 of a source's texts. The sums of the buckets (a table of at most sources times ``BUCKETS`` rows) give the
bucket in which a budget ends, and only inside that bucket texts are put in order. So no
task ever sees a whole source.

Defined results: texts that are null, without tokens, or of a source without target are left
out. Spellings of a source that differ in case, outer blanks or ``-`` for ``_`` are one. Without ``total``
the largest total is taken that every source can serve within its cap. A source without any
text has an actual share of 0, and the total is that of the others.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semantide.llm.quality import Judge
from semantide.sources.shared import materialise

BUCKETS = 100_000
#: Quality weight of a text without prose; with nothing but prose it is 1.
LEAST_WEIGHT = 0.1
#: Split pattern of the byte-level vocabulary; a fixed value that goes with its file.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _sizer(vocabulary: bytes, common: dict[str, set[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        encoding = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        judge = Judge(common)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            tokens = [len(encoding.encode_ordinary(t)) for t in texts]
            weights = [LEAST_WEIGHT + (1 - LEAST_WEIGHT) * judge(t)[8] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(weights, pa.float64())], ["id", "source", "tokens", "weight"]
            )

    return run


def source_name(column: str):
    """One spelling of a source's name."""
    return F.translate(F.lower(F.trim(F.col(column))), "- ", "__")


class Mix:
    """A mix of ``documents`` by ``targets`` (``source``, ``target_share``, ``max_repeats``; one row a source)."""

    def __init__(
        self,
        documents: DataFrame,
        targets: DataFrame,
        common_words: DataFrame,
        vocabulary_path: str,
        id_col: str = "doc_id",
        text_col: str = "text",
        source_col: str = "source",
        total: int | None = None,
        seed: int = 42,
    ):
        with open(vocabulary_path, "rb") as f:
            vocabulary = f.read()
        rows = common_words.where("word IS NOT NULL").select("lang", "word").distinct().limit(100_001).collect()
        if len(rows) > 100_000:
            raise ValueError("common_words must not have more than 100,000 rows")
        common: dict[str, set[str]] = {}
        for r in rows:
            common.setdefault(r["lang"] or "", set()).add(r["word"].lower())
        self.targets = targets.select(source_name("source").alias("source"), "target_share", "max_repeats").where("target_share > 0")
        named = documents.select(F.col(id_col).alias("id"), source_name(source_col).alias("source"), F.col(text_col).alias("text"))
        wanted = named.where("text IS NOT NULL AND length(text) > 0").join(self.targets.select("source"), "source", "left_semi")
        keys = wanted.select("id", "source", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
        first = keys.groupBy("digest").agg(F.min(F.struct("id", "source")).alias("first"), F.count("*").alias("n")).where("n > 1")
        # Copies are dropped before anything is counted; a table, so that its size is known when the join is planned.
        copies = materialise(keys.join(first, "digest").where("first.id <> id OR first.source <> source").select("id", "source"), "mix-copies")
        kind = wanted.schema["id"].dataType.simpleString()
        sized = wanted.join(copies, ["id", "source"], "left_anti").select("id", "source", "text").mapInArrow(_sizer(vocabulary, common), f"id {kind}, source string, tokens long, weight double")
        drawn = -F.log((F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)) / F.col("weight")
        self.texts = materialise(
            sized.where("tokens > 0").withColumn("key", drawn).withColumn("bucket", F.floor((1 - F.exp(-F.col("key") * LEAST_WEIGHT)) * BUCKETS).cast("int")),
            "mix-texts",
        )
        sums = self.texts.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("n_texts"))
        plan = self.targets.join(sums, "source", "left")
        reach = F.min(F.when(F.col("available") > 0, F.col("available") * F.col("max_repeats") / F.col("target_share"))).over(Window.partitionBy())
        size = F.lit(float(total)) if total is not None else reach
        budget = F.least(F.col("target_share") * size, F.col("available") * F.col("max_repeats"))
        # One row for each source: the plan of a few rows.
        self.plan = materialise(
            plan.withColumn("budget", F.floor(budget + 1e-6).cast("long"))
            .withColumn("epochs", F.floor(F.try_divide("budget", "available")).cast("long"))
            .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
            .where("available > 0"),
            "mix-plan",
        )

    def chosen(self) -> DataFrame:
        """``id``, ``source``, ``tokens``, ``repeats``: every text that is used, and how often."""
        hist = self.texts.groupBy("source", "bucket").agg(F.sum("tokens").alias("tokens"))
        w = Window.partitionBy("source").orderBy("bucket")
        ends = hist.select("source", "bucket", F.sum("tokens").over(w).alias("upto"), "tokens").join(self.plan.select("source", "rest"), "source")
        # A row a source, like the plan; as a table its size is known, and the planner decides how to join.
        edge = materialise(
            ends.where("upto > rest AND upto - tokens <= rest").select("source", F.col("bucket").alias("edge"), (F.col("rest") - (F.col("upto") - F.col("tokens"))).alias("room")), "mix-edge"
        )
        placed = self.texts.join(self.plan.select("source", "epochs", "max_repeats"), "source").join(edge, "source", "left")
        whole = placed.where("edge IS NULL OR bucket <> edge").select(
            "id", "source", "tokens", (F.col("epochs") + F.when(F.col("edge").isNull() | (F.col("bucket") > F.col("edge")), 0).otherwise(1)).alias("repeats")
        )
        within = Window.partitionBy("source", "bucket").orderBy("key", "id")
        last = placed.where("bucket = edge").withColumn("run", F.sum("tokens").over(within)).select(
            "id", "source", "tokens", (F.col("epochs") + F.when(F.col("run") <= F.col("room"), 1).otherwise(0)).alias("repeats")
        )
        return whole.unionByName(last).where("repeats > 0")

    def shares(self) -> DataFrame:
        """For each target the tokens and the share really reached."""
        used = self.chosen().groupBy("source").agg(
            F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("texts"), F.max("repeats").alias("most_repeats")
        )
        rows = self.targets.join(used, "source", "left")
        all_tokens = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())
        return rows.select(
            "source",
            "target_share",
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("texts", F.lit(0)).alias("texts"),
            F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
            F.coalesce(F.try_divide(F.coalesce("tokens", F.lit(0)), all_tokens), F.lit(0.0)).alias("actual_share"),
        )
