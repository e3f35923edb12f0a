"""Fixpoints over edge tables: components, reachability, dead nodes, dominators.

Rounds are materialised in the shared folder, so the plan of a round never
contains the rounds before it. Graphs that stand in one row each, as the call graph of a
program does, are worked on where they are: one pass, no rounds, no exchange (``small_graphs``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semantide.sources.shared import materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``id``, ``component``: least node of each node's component.

    ``edges`` has ``src`` and ``dst``; direction, repeats and self-loops don't matter. Rounds
    alternate between linking every node's larger neighbours and its smaller ones to the least
    one around, which halves paths; a round that changes nothing ends it. Nodes with a
    null end are ignored. An empty table gives an empty table.
    """
    work = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    nodes = materialise(work.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "cc-nodes")
    work = materialise(work.where("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct(), "cc-edges")
    for _ in range(max_rounds):
        # Large star: each node's larger neighbours point to its least neighbour.
        both = work.union(work.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("id", "other")
        least = both.groupBy("id").agg(F.least(F.min("other"), F.first("id")).alias("least"))
        large = both.where("other > id").join(least, "id").select(F.col("other").alias("hi"), F.col("least").alias("lo")).distinct()
        # Small star: each node and its smaller neighbours point to the least of them.
        floor = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(floor, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        merged = small.union(floor).where("hi <> lo").distinct()
        after = materialise(merged, "cc-edges")
        changed = after.exceptAll(work).limit(1).count() + work.exceptAll(after).limit(1).count()
        work = after
        if not changed:
            break
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return nodes.join(work.select(F.col("hi").alias("id"), "lo"), "id", "left").select("id", F.coalesce("lo", "id").alias("component"))


def closure(edges: DataFrame, keys: list[str], max_rounds: int = 40) -> DataFrame:
    """``keys``, ``src``, ``dst``: all pairs with a path of one or more edges, within each graph named by ``keys``.

    Paths are doubled in each round, so the rounds are the logarithm of the longest shortest path; a round only joins the pairs
    that were new with all, and only what it finds is written. Meant
    for many graphs of bounded size. Rows with a null end are ignored.
    """
    step = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(*keys, "src", "dst").distinct()
    known = fresh = materialise(step, "closure")
    for _ in range(max_rounds):
        parts = [_joined(fresh, known, keys), _joined(known, fresh, keys)]
        found = parts[0].union(parts[1]).distinct().join(known, [*keys, "src", "dst"], "left_anti")
        fresh = materialise(found, "closure")
        if fresh.isEmpty():
            return known
        known = known.union(fresh)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def _joined(first: DataFrame, then: DataFrame, keys: list[str]) -> DataFrame:
    ahead = then.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("far"))
    return first.join(ahead, [*keys, "dst"]).select(*keys, "src", F.col("far").alias("dst"))


#: Rounds after which the tables of a long walk are written as one.
COMPACT = 16


def reachable(edges: DataFrame, sources: DataFrame, keys: list[str], max_rounds: int = 10_000) -> DataFrame:
    """``keys``, ``node``: the sources and all they reach, semi-naively: each round only follows the nodes that were new, and only writes those.

    ``sources`` has ``keys`` and ``node``.
    """
    step = materialise(edges.where("src IS NOT NULL AND dst IS NOT NULL").select(*keys, "src", "dst").distinct(), "edges")
    seen = fresh = materialise(sources.select(*keys, "node").distinct(), "seen")
    for turn in range(1, max_rounds + 1):
        found = fresh.join(step.withColumnRenamed("src", "node"), [*keys, "node"]).select(*keys, F.col("dst").alias("node")).distinct()
        fresh = materialise(found.join(seen, [*keys, "node"], "left_anti"), "fresh")
        if fresh.isEmpty():
            return seen
        seen = seen.union(fresh)
        if turn % COMPACT == 0:
            seen = materialise(seen, "seen")
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def dead_nodes(nodes: DataFrame, edges: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``node``: nodes no entry reaches."""
    return nodes.select(*keys, "node").distinct().join(reachable(edges, entries, keys), [*keys, "node"], "left_anti")


def strict_dominators(edges: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``a``, ``b``: a is on every path from the entry to b, a is neither b nor the entry.

    By the definition: b is reachable, but not once a is removed. One reachability runs over all removed
    nodes at once, its state being (removed, node). ``entries`` has ``keys`` and ``node``, one row a graph.
    """
    live = materialise(reachable(edges, entries, keys), "live")
    inner = live.join(entries, [*keys, "node"], "left_anti")
    removed = inner.withColumnRenamed("node", "removed")
    step = edges.select(*keys, "src", "dst").distinct().join(removed, keys).where("src <> removed AND dst <> removed")
    start = removed.join(entries, keys).select(*keys, "removed", "node")
    around = reachable(step, start, [*keys, "removed"])
    pairs = removed.join(inner, keys).where("removed <> node")
    return pairs.join(around, [*keys, "removed", "node"], "left_anti").select(*keys, F.col("removed").alias("a"), F.col("node").alias("b"))


def call_edges(functions: DataFrame, known_only: bool = True) -> DataFrame:
    """``program``, ``src``, ``dst`` from rows of ``program`` and ``functions``; with ``known_only`` calls of outside functions are left out."""
    each = functions.select("program", F.explode("functions").alias("f")).select("program", F.col("f.name").alias("src"), F.col("f.calls").alias("calls"))
    edges = each.select("program", "src", F.explode("calls").alias("dst")).distinct()
    if known_only:
        edges = edges.join(each.select("program", F.col("src").alias("dst")).distinct(), ["program", "dst"], "left_semi")
    return edges.select("program", "src", "dst")


# --- graphs of one row each ------------------------------------------------------------------------------


def call_graphs(functions: DataFrame) -> DataFrame:
    """``program``, ``nodes``, ``edges``, ``entry`` from rows of ``program`` and ``functions``.

    Calls of outside functions are left out; the entry is the last function by line, null without functions.
    """
    named = functions.select("program", F.filter("functions", lambda f: f["name"].isNotNull()).alias("fs")).where("fs IS NOT NULL")
    names = F.array_distinct(F.transform("fs", lambda f: f["name"]))
    rows = named.withColumn("nodes", names)
    none = F.array().cast("array<string>")
    edges = F.array_distinct(F.flatten(F.transform("fs", lambda f: F.transform(F.array_intersect(F.coalesce(f["calls"], none), F.col("nodes")), lambda c: F.struct(f["name"].alias("src"), c.alias("dst"))))))
    last = F.array_max(F.transform("fs", lambda f: F.struct(f["lineno"].alias("line"), f["name"].alias("name"))))
    return rows.select("program", "nodes", edges.alias("edges"), last["name"].alias("entry"))


def small_graphs(graphs: DataFrame, work: Callable[[list[str], list[tuple[str, str]], str | None], list[tuple]], columns: list[str], key: str = "program") -> DataFrame:
    """``key`` and ``columns``: what ``work`` finds in each graph of ``graphs`` (``key``, ``nodes``, ``edges``, ``entry``)."""
    kind = graphs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            nodes, edges, entries = (batch.column(i).to_pylist() for i in range(1, 4))
            for row, (ns, es, entry) in enumerate(zip(nodes, edges, entries)):
                rows = work(ns or [], [(e["src"], e["dst"]) for e in es or []], entry)
                at += [row] * len(rows)
                found += rows
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), *[pa.array(c, pa.string()) for c in zip(*found)]], [key, *columns])

    return graphs.select(key, "nodes", "edges", "entry").mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c} string" for c in columns))


def _after(edges: list[tuple[str, str]]) -> dict[str, list[str]]:
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    return after


def _reach(after: dict[str, list[str]], starts: list[str], without: str | None = None) -> set[str]:
    seen, todo = set(starts) - {without}, [s for s in starts if s != without]
    while todo:
        for n in after.get(todo.pop(), ()):
            if n not in seen and n != without:
                seen.add(n)
                todo.append(n)
    return seen


def paths_of(nodes: list[str], edges: list[tuple[str, str]], entry: str | None) -> list[tuple[str, str]]:
    """(src, dst) with a path of one edge or more."""
    after = _after(edges)
    return [(a, b) for a in after for b in _reach(after, after[a])]


def unreached_of(nodes: list[str], edges: list[tuple[str, str]], entry: str | None) -> list[tuple[str]]:
    """Nodes that the entry doesn't reach."""
    live = _reach(_after(edges), [entry] if entry is not None else [])
    return [(n,) for n in dict.fromkeys(nodes) if n not in live]


def dominators_of(nodes: list[str], edges: list[tuple[str, str]], entry: str | None) -> list[tuple[str, str]]:
    """(a, b): a, neither b nor the entry, is on every path from the entry to b."""
    if entry is None:
        return []
    after = _after(edges)
    live = _reach(after, [entry])
    out = []
    for a in live - {entry}:
        left = _reach(after, [entry], a)
        out += [(a, b) for b in live - {entry, a} if b not in left]
    return out
