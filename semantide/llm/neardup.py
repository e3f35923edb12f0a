"""Near-duplicate records by an exact set similarity join over a token-group matrix.

A record is the set of its runs of ``n`` successive tokens. Records are partitioned
into groups of likely similar ones (equal least hash among their rare runs; a group
that grows past ``GROUP_SIZE`` is split by a hash of the key). Groups are named by hashes of 32 bits; those that have the same name by chance are one
larger group, whose members are compared like any. The matrix holds, for each
group, the union of its members' runs, as rows (run, group). It suffices to hold
each record's rarest ``n - ceil(t n) + k`` runs: two records of similarity
``t`` or more have at least ``k`` of those in common. The overlap of two groups in the
matrix bounds what any query of the one can share with a member of the other; only
pairs of groups that reach the bound are opened, and their members compared exactly.

Members of open groups carry a signature, a bit for each class of runs that says whether it holds an odd number. Two sets
differ in at least as many runs as their signatures in bits, so pairs that differ too much are dropped before
sets travel; what is left is compared exactly.

Which runs are rare is only an order: it is read from ``ORDER_SAMPLE`` records or a ``ORDER_SHARE``-th of them
(at most ``ORDER_MOST``), chosen by a hash from all of them, and the result doesn't depend on it. Records with equal sets
form one class from the start, so copies are compared once. A group holds records of like size, and only groups
whose sizes can reach the threshold meet. The groups of a run that the sample shows to be in very many records meet in blocks, each a
join key of its own, so no key holds all of them. No pair is lost. Each step's shuffle files and the tables that no later step reads are deleted as soon as it is written.

Defined results: null texts and texts with fewer than ``n`` tokens have no partner.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semantide.operators.graph import connected_components
from semantide.sources.shared import discard, materialise

#: Records from which the order of runs is read, on average, and the commonest runs of theirs that it tells apart. Of larger tables it is
#: read from one record in ``ORDER_SHARE``, as runs of as few records as the sample can't tell from rare ones grow with the table, up to ``ORDER_MOST``.
ORDER_SAMPLE, ORDER_RUNS = 2000, 200_000
ORDER_SHARE, ORDER_MOST = 25, 50_000
#: Bits of the longest signature; others have the power of two from twice the size of the set.
SIGNATURE = 1 << 14
#: Records that have a run, by the sample, from which its groups meet in blocks of about so many.
HOT_RUN = 2000
#: Records a group of the matrix holds at most, on average after a split.
GROUP_SIZE = 16

TOKEN = r"[A-Za-z0-9_]+"

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class _Hashes(dict):
    """Token to 64-bit hash, remembered while there is room."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * _M[0]
        return x ^ (x >> np.uint64(29))


def run_hashes(tokens: list[str], n: int, known: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` successive tokens."""
    if len(tokens) < n:
        return np.zeros(0, np.uint64)
    t = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    m = len(t) - n + 1
    with np.errstate(over="ignore"):
        h = t[:m]
        for i in range(1, n):
            h = _mix(h) * _M[i % 3] + t[i : m + i]
        h = np.sort(_mix(h))
    return h[np.r_[True, h[1:] != h[:-1]]]


def signature(h: np.ndarray) -> bytes:
    """Parities of the number of runs in each of so many classes; a longer one folds into a shorter one by exclusive or of its halves."""
    bits = min(SIGNATURE, max(64, 1 << (2 * len(h) - 1).bit_length()))
    return np.packbits(np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _differing(a: bytes, b: bytes) -> int:
    """A number of runs in which two sets with these signatures differ at least."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), len(a) * 8
    while size > len(b) * 8:
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def _spare(n: int) -> int:
    """Common runs that the prefixes of two similar records must show."""
    return 1 + n // 32


def _as_is(text: str) -> str:
    return text


def _sketch_mapper(pattern: str, n: int, threshold: float, common: np.ndarray, weight: np.ndarray, prepare: Callable[[str], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = re.compile(pattern).findall, _Hashes()
        for batch in batches:
            ids, keep, sizes, sums, firsts, prefixes, signatures = batch.column(0), [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                h = run_hashes(find(prepare(text)), n, known) if text else ()
                size = len(h)
                if not size:
                    continue
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    order = np.argsort(np.where(common[at] == h, weight[at], 0), kind="stable")
                    h = h[order]
                least = h[: size - ceil(threshold * size - 1e-9) + _spare(size)]
                keep.append(row)
                sizes.append(size)
                signatures.append(signature(h))
                with np.errstate(over="ignore"):
                    sums.append(_mix(h ^ _M[1]).sum(dtype=np.uint64))
                firsts.append(h[0] if not len(common) else least.min())
                prefixes.append(least.view(np.int64))
            if keep:
                flat = np.concatenate(prefixes)
                ends = np.cumsum([0, *map(len, prefixes)])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(keep)),
                        pa.array(sizes, pa.int32()),
                        pa.array(np.array(sums, np.uint64).view(np.int64)),
                        pa.array(np.array(firsts, np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                        pa.array(signatures, pa.binary()),
                    ],
                    ["id", "n", "c", "g", "prefix", "sig"],
                )

    return run


def _set_mapper(pattern: str, n: int, prepare: Callable[[str], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = re.compile(pattern).findall, _Hashes()
        for batch in batches:
            sets = []
            for text in batch.column(1).to_pylist():
                sets.append(run_hashes(find(prepare(text)), n, known).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "runs"])

    return run


def _run_mapper(pattern: str, n: int, prepare: Callable[[str], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known = re.compile(pattern).findall, _Hashes()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                h = run_hashes(find(prepare(text)), n, known)
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["run"])

    return run


def _near_mapper(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, na, sa, b, nb, sb = (batch.column(i) for i in range(6))
            total = na.to_numpy() + nb.to_numpy()
            # Of two sets of the similarity t, (1 - t) / (1 + t) of both sizes are runs that only one has.
            most = np.floor((total - 2 * (threshold * total - 1e-9) / (1 + threshold)) + 1e-6).tolist()
            near = [_differing(x, y) <= m for x, y, m in zip(sa.to_pylist(), sb.to_pylist(), most)]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def _compare_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        common, union = [], []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            common.append(shared)
            union.append(len(x) + len(y) - shared)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(common, pa.int32()), pa.array(union, pa.int32())], ["a", "b", "common", "total"]
        )


def _table(df: DataFrame, name: str) -> DataFrame:
    return materialise(df, name, keep_shuffles=False)


class NearDuplicates:
    """Similar records of ``df``; see the module's text.

    ``id_col`` is a unique key; other columns are ignored. Similarity is the number of
    common runs by the number of all runs of the two records. ``prepare`` is applied to a
    text before it is read. With ``probes`` (a column ``id``) only pairs with one of these records count.
    """

    def __init__(
        self,
        df: DataFrame,
        id_col: str,
        text_col: str,
        threshold: float = 0.8,
        n: int = 5,
        token: str = TOKEN,
        prepare: Callable[[str], str] = _as_is,
        probes: DataFrame | None = None,
    ):
        self.prepare, self.probes = prepare, probes
        self.texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
        self.threshold, self.n, self.token = threshold, n, token
        self.total = df.count()
        self.id_type = self.texts.schema["id"].dataType.simpleString()
        common, weight = self._order()
        sketches = self._sketched = _table(
            self.texts.mapInArrow(
                _sketch_mapper(token, n, threshold, common, weight, prepare), f"id {self.id_type}, n int, c long, g long, prefix array<long>, sig binary"
            ),
            "sketches",
        )
        # Classes of equal sets.
        heads = sketches.groupBy("c", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        copied = heads.where("copies > 1").select("c", "n", "rep")
        self.copies = _table(
            sketches.select("id", "c", "n").join(copied, ["c", "n"]).where("id <> rep").select("rep", "id"), "copies"
        )
        self.sketches = sketches.join(self.copies.select("id"), "id", "left_anti")
        self._links: DataFrame | None = None

    def _order(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequent runs of the sample and how many of its records have them."""
        every = max(1, self.total // max(ORDER_SAMPLE, min(self.total // ORDER_SHARE, ORDER_MOST)))
        sample = self.texts.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("text")
        counted = sample.mapInArrow(_run_mapper(self.token, self.n, self.prepare), "run long").groupBy("run").count().where("count > 1")
        counts = counted.orderBy(F.desc("count"), "run").limit(ORDER_RUNS).toPandas()
        runs = counts["run"].to_numpy(np.int64).view(np.uint64)
        self.hot = [(int(r), -(-int(n) * every // HOT_RUN)) for r, n in zip(counts["run"], counts["count"]) if int(n) * every > HOT_RUN]
        order = np.argsort(runs)
        return runs[order], counts["count"].to_numpy(np.int32)[order]

    def links(self) -> DataFrame:
        """``a``, ``b``, ``common``, ``total``: similar pairs of representatives, a before b."""
        if self._links is None:
            self._links = self._compare(self._candidates())
        return self._links

    def _candidates(self) -> DataFrame:
        spare = F.lit(1) + F.floor(F.col("n") / 32).cast("int")
        # Sizes of similar records differ by the threshold at most, so their levels by one.
        level = F.floor(F.log(F.col("n")) / F.log(F.lit(1 / self.threshold + 1e-9))).cast("int")
        sketches = self.sketches
        # As a table its size is known when the join is planned, so a short list doesn't make the sketches travel.
        crowded = _table(sketches.groupBy("g").agg(F.count("*").alias("size")).where(F.col("size") > GROUP_SIZE), "crowded")
        placed = sketches.join(crowded, "g", "left").select(
            "id",
            "n",
            "prefix",
            "sig",
            # Of one level, so the least of these has the least spare.
            (spare.cast("long") * 65536 + level).alias("k"),
            F.when(F.col("size").isNull(), F.hash("g", level))
            .otherwise(F.hash("g", level, F.expr(f"pmod(xxhash64(id), cast(ceil(size / {GROUP_SIZE}) as int))")))
            .alias("grp"),
        )
        rows = placed.select(F.explode("prefix").alias("run"), "grp", "k")
        if not self.hot:
            met = self._meet(rows, placed, ["run"])
        else:
            # At most ``ORDER_RUNS`` rows.
            hot = _table(self.texts.sparkSession.createDataFrame(self.hot, "run long, blocks int"), "hot-runs")
            met = self._meet(rows.join(hot.select("run"), "run", "left_anti"), placed, ["run"]).union(self._meet(rows.join(hot, "run"), placed, ["run", "left", "right"]))
        bound = met.groupBy("both").agg(F.count("*").alias("shared"), F.min("least").alias("least"))
        open_groups = _table(bound.where(F.col("shared") >= F.col("least")).selectExpr("cast(shiftright(both, 32) as int) AS ga", "cast(shiftright(shiftleft(both, 32), 32) as int) AS gb"), "open-groups")
        members = _table(placed.select("id", "n", "sig", "grp"), "members")
        discard(self._sketched, crowded)
        a = members.select(F.col("grp").alias("ga"), *[F.col(c).alias(d) for c, d in (("id", "a"), ("n", "na"), ("sig", "sa"))])
        b = members.select(F.col("grp").alias("gb"), *[F.col(c).alias(d) for c, d in (("id", "b"), ("n", "nb"), ("sig", "sb"))])
        columns = ["a", "na", "sa", "b", "nb", "sb"]
        fits = F.least("na", "nb") >= F.lit(self.threshold) * F.greatest("na", "nb") - 1e-9
        opened = open_groups.join(a, "ga").join(b, "gb").where(fits).select(*columns)
        inside = a.join(b.withColumnRenamed("gb", "ga"), "ga").where("a < b").where(fits).select(*columns)
        near = opened.union(inside).mapInArrow(_near_mapper(self.threshold), f"a {self.id_type}, b {self.id_type}")
        pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = _table(pairs if self.probes is None else pairs.distinct(), "candidates")
        discard(open_groups, members)
        return pairs

    def _meet(self, rows: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
        """``both`` (two groups in one number, half the bytes to move), ``least``: groups that have a run in common, once for each run; with blocks in the keys by block of the one and the other."""
        blocked = len(keys) > 1
        more = [F.min("blocks").alias("blocks")] if blocked else []
        matrix = rows.repartition("run").groupBy("run", "grp", F.col("k").bitwiseAND(65535).alias("level")).agg(F.min("k").alias("k"), *more)
        sides = []
        for x, own, other in (("a", "left", "right"), ("b", "right", "left")):
            columns = ["run", F.col("grp").alias(f"g{x}"), F.shiftright("k", 16).alias(f"k{x}"), F.col("level").alias(f"v{x}")]
            if blocked:
                columns += [F.pmod(F.xxhash64("grp"), F.col("blocks")).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(other)]
            sides.append(matrix.select(*columns))
        left, right = sides
        if self.probes is not None:
            left = left.join(self._probed(placed).select(F.col("grp").alias("ga")), "ga", "left_semi")
        order = ("ga < gb" if self.probes is None else "ga <> gb") + " AND abs(va - vb) <= 1"
        both = F.shiftleft(F.col("ga").cast("long"), 32).bitwiseOR(F.col("gb").cast("long").bitwiseAND(0xFFFFFFFF))
        return left.join(right, keys).where(order).select(both.alias("both"), F.least("ka", "kb").alias("least"))

    def _probed(self, placed: DataFrame) -> DataFrame:
        """Groups that hold a probe, or a copy of one."""
        stand_ins = self.copies.join(self.probes, "id", "left_semi").select(F.col("rep").alias("id")).union(self.probes)
        return placed.select("id", "grp").join(stand_ins, "id", "left_semi").select("grp").distinct()

    def _compare(self, pairs: DataFrame) -> DataFrame:
        involved = _table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "involved")
        sets = self.texts.join(involved, "id", "left_semi").mapInArrow(_set_mapper(self.token, self.n, self.prepare), f"id {self.id_type}, runs binary")
        sets = _table(sets, "sets")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("runs").alias("x")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("runs").alias("y")), "b"
        )
        compared = both.select("a", "b", "x", "y").mapInArrow(
            _compare_mapper, f"a {self.id_type}, b {self.id_type}, common int, total int"
        )
        links = _table(compared.where(F.col("common") >= F.lit(self.threshold) * F.col("total") - 1e-9), "links")
        discard(pairs, involved, sets)
        return links

    def pairs(self) -> DataFrame:
        """``id_a``, ``id_b`` (a before b): all similar pairs, copies written out."""
        copies = _table(
            self.copies.union(self.copies.select("rep", F.col("rep").alias("id"))).distinct(), "class-members"
        )
        same = copies.select("rep", F.col("id").alias("a")).join(copies.select("rep", F.col("id").alias("b")), "rep").where("a < b")
        links = self.links()
        left = links.join(copies.select(F.col("rep").alias("a"), F.col("id").alias("ma")), "a", "left")
        both = left.join(copies.select(F.col("rep").alias("b"), F.col("id").alias("mb")), "b", "left")
        spread = both.select(F.coalesce("ma", "a").alias("a"), F.coalesce("mb", "b").alias("b"))
        return same.select("a", "b").union(spread).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()

    def partners(self) -> DataFrame:
        """``id``, ``other``: for each record the similar ones, with ``probes`` only those among them."""
        both = self.pairs()
        rows = both.select(F.col("id_a").alias("id"), F.col("id_b").alias("other")).union(both.select("id_b", "id_a"))
        return rows if self.probes is None else rows.join(self.probes.select(F.col("id").alias("other")), "other", "left_semi").select("id", "other")

    def groups(self) -> DataFrame:
        """``id``, ``group_id`` (its least id), ``n_links`` (its partners): one row for each record with a partner."""
        links = _table(self.links().select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "links")
        edges = links.union(self.copies.select("rep", "id"))
        sizes = self.copies.groupBy("rep").agg((F.count("*") + 1).alias("size"))
        both = links.union(links.select("dst", "src"))
        linked = both.join(sizes.withColumnRenamed("rep", "dst"), "dst", "left").groupBy(F.col("src").alias("rep")).agg(F.sum(F.coalesce("size", F.lit(1))).alias("linked"))
        members = connected_components(edges).join(self.copies.select("id", "rep"), "id", "left").withColumn("rep", F.coalesce("rep", "id"))
        partners = F.coalesce("size", F.lit(1)) - 1 + F.coalesce("linked", F.lit(0))
        return members.join(sizes, "rep", "left").join(linked, "rep", "left").select("id", F.col("component").alias("group_id"), partners.alias("n_links"))
