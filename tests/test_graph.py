import random

from pyspark.sql import functions as F

from semantide.operators import graph


def closure_slowly(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in out if b == c} - out
        if not more:
            return out
        out |= more


def table(spark, edges, g=1):
    return spark.createDataFrame([(g, a, b) for a, b in edges], "g int, src int, dst int")


def test_closure_dead_nodes_and_dominators(spark):
    rng = random.Random(3)
    rows, nodes, entries, want, dead, doms = [], [], [], set(), set(), set()
    for g in range(8):
        n = 9
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(14)}
        rows += [(g, a, b) for a, b in edges]
        nodes += [(g, k) for k in range(n)]
        entries.append((g, 0))
        paths = closure_slowly(edges)
        want |= {(g, a, b) for a, b in paths}
        live = {0} | {b for a, b in paths if a == 0}
        dead |= {(g, k) for k in range(n) if k not in live}
        for a in live - {0}:
            rest = closure_slowly({(x, y) for x, y in edges if a not in (x, y)})
            around = {0} | {y for x, y in rest if x == 0}
            doms |= {(g, a, b) for b in live - {0, a} if b not in around}
    edges = spark.createDataFrame(rows + [(0, None, 1), (0, 1, None)] + rows[:3], "g int, src int, dst int")
    starts = spark.createDataFrame(entries, "g int, node int")
    assert {tuple(r) for r in graph.closure(edges, ["g"]).collect()} == want
    assert {tuple(r) for r in graph.dead_nodes(spark.createDataFrame(nodes, "g int, node int"), edges, starts, ["g"]).collect()} == dead
    assert {tuple(r) for r in graph.strict_dominators(edges.where("src IS NOT NULL AND dst IS NOT NULL"), starts, ["g"]).collect()} == doms


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 420)] + [(500, 500)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame([(a, b, "x") for a, b in edges] + [(None, 3, "y")], "src int, dst int, id string")
    assert {r["id"]: r["component"] for r in graph.connected_components(df).collect()} == {k: find(k) for k in list(parent)}
    assert graph.connected_components(df.where("src < 0")).count() == 0


def test_call_edges(spark):
    df = spark.createDataFrame([("p", [("f", ["g", "out"]), ("g", None)]), ("q", None), ("r", [])], "program string, functions array<struct<name string, calls array<string>>>")
    assert [tuple(r) for r in graph.call_edges(df).collect()] == [("p", "f", "g")]
    assert {tuple(r) for r in graph.call_edges(df, known_only=False).collect()} == {("p", "f", "g"), ("p", "f", "out")}


def test_small_graphs_agree_with_the_rounds(spark):
    import random

    rng = random.Random(5)
    rows = []
    for g in range(12):
        names = [f"f{k}" for k in range(rng.randint(0, 7))]
        rows.append((f"p{g}", [(n, k, [rng.choice([*names, "out"]) for _ in range(rng.randint(0, 3))] if rng.random() < 0.9 else None) for k, n in enumerate(names)]))
    rows += [("none", None), ("empty", [])]
    df = spark.createDataFrame(rows, "program string, functions array<struct<name:string,lineno:int,calls:array<string>>>")
    edges = graph.call_edges(df)
    entries = df.select("program", F.explode("functions").alias("f")).groupBy("program").agg(F.max_by("f.name", F.struct("f.lineno", "f.name")).alias("node"))
    nodes = df.select("program", F.explode("functions.name").alias("node"))
    graphs = graph.call_graphs(df)
    for work, columns, want in (
        (graph.paths_of, ["src", "dst"], graph.closure(edges, ["program"])), (graph.unreached_of, ["node"], graph.dead_nodes(nodes, edges, entries, ["program"])),
        (graph.dominators_of, ["a", "b"], graph.strict_dominators(edges, entries, ["program"])),
    ):
        assert sorted(map(tuple, graph.small_graphs(graphs, work, columns).collect())) == sorted(map(tuple, want.collect()))
