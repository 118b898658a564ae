import random

from tessera.operators.components import connected_components
from tessera.plans.scratch import Scratch
from tessera.queries import QUERIES


def union_find(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_random_graphs_and_paths(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(7, 7), (None, 3), *edges[:5]]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    assert got == union_find(edges)


def test_keys_separate_graphs_and_empty(spark):
    df = spark.createDataFrame([("x", 1, 2), ("y", 2, 3), ("x", 5, 2)], "seq string, a int, b int")
    got = {(r.seq, r.node): r.component for r in connected_components(df, "a", "b", keys=["seq"]).collect()}
    assert got == {("x", 1): 1, ("x", 2): 1, ("x", 5): 1, ("y", 2): 2, ("y", 3): 2}
    assert connected_components(df.limit(0), "a", "b", keys=["seq"]).count() == 0


def test_query_of_all_rows_equals_union_find(spark, tmp_path):
    rng = random.Random(6)
    orders = [(i, rng.randrange(60)) for i in range(80)]
    items = [(rng.randrange(90), rng.randrange(50), rng.randrange(1, 8), float(rng.randrange(1, 51))) for _ in range(70)]
    items += [(i, 99, 2, 3.0) for i in range(30)]  # a hub whose rows are of small quantities
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    of = dict(orders)
    want = union_find([(of[o], 1000000 + s) for o, s, *_ in items if o in of])
    assert {r.node: r.component for r in QUERIES["connected_components"](spark, str(tmp_path)).collect()} == want


def test_later_tables_have_a_row_for_a_node_at_most(spark, monkeypatch):
    """Edges are saved once; what the rounds save grows with the nodes, not with the edges of a dense graph."""
    rng = random.Random(7)
    edges = [(rng.randrange(100), 1000 + rng.randrange(100)) for _ in range(4000)] + [(500, 1500), (500, 1501)]
    df, sizes = spark.createDataFrame(edges, "a long, b long"), []
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, *a, **k: (out := save(self, *a, **k), sizes.append(out.count()))[0])
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    assert got == union_find(edges)
    assert sizes[0] > 3000 and max(sizes[1:]) <= len(got)


def test_paths_in_any_order_take_several_rounds(spark):
    """Trees of trees: the least node of all is found whatever the order of ids, ends and keys, and for ids that are texts."""
    rng = random.Random(8)
    path = rng.sample(range(-200, 200), 300)
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in zip(path, path[1:])]
    edges += edges[:20] + [(b, a) for a, b in edges[20:40]]
    rows = [("x", a, b) for a, b in edges] + [("y", a, b) for a, b in edges[:100]] + [(None, 1, 2)]
    df = spark.createDataFrame(rows, "seq string, a long, b long")
    got = {(r.seq, r.node): r.component for r in connected_components(df, "a", "b", keys=["seq"]).collect()}
    assert got == {("x", n): c for n, c in union_find(edges).items()} | {("y", n): c for n, c in union_find(edges[:100]).items()}
    texts = [(f"n{a:04d}", f"n{b:04d}") for a, b in edges]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(texts, "a string, b string"), "a", "b").collect()}
    assert found == union_find(texts)
