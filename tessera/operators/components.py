"""Connected components of an edge table by contraction.

Every node takes its least neighbour, which makes trees; each tree becomes one node, its least, and the
edges between trees are those of the next round. A round at least halves the nodes that have edges, and
of a graph with many edges a node it leaves few. Edges are dealt three times a round: for the least
neighbours, and for the roots of either end, the second after equal edges are gone. All else has a row
for a node. The state of a round is a table in the shared folder; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch


def _named(trees: DataFrame, keys: Sequence[str], node: str, root: str) -> DataFrame:
    return trees.select(*keys, F.col("node").alias(node), F.col("root").alias(root))


def _trees(ends: DataFrame, keys: Sequence[str], scratch: Scratch, rows: int) -> DataFrame:
    """Columns ``keys + (node, root)``, root being the least node of the tree that the least neighbours make.

    ends: node, m (a neighbour). Two steps to the least neighbour never lead to a greater node, and back to
    the same one only where two nodes are each other's least: the lesser of these is the root.
    """

    def upper(df: DataFrame) -> DataFrame:
        return df.join(_named(df, keys, "root", "top"), [*keys, "root"])

    saved = scratch.save(ends.groupBy(*keys, "node").agg(F.min("m").alias("root")), "near", rows)
    trees = upper(saved).select(*keys, "node", F.least("root", "top").alias("root"))
    while True:
        after = scratch.save(upper(trees).select(*keys, "node", F.col("top").alias("root"), (F.col("root") != F.col("top")).alias("moved")), "trees", rows)
        scratch.drop(saved)
        trees = saved = after
        if not trees.where("moved").count():
            return trees.drop("moved")


def connected_components(
    edges: DataFrame,
    src: str | Column,
    dst: str | Column,
    keys: Sequence[str] = (),
    scratch: Scratch | None = None,
    max_rounds: int = 60,
) -> DataFrame:
    """Columns ``keys + (node, component)``: component is the smallest node id reachable.

    edges: undirected; direction, repeated edges and loops are irrelevant; rows with a null end or a
    null key are ignored. keys: columns that separate independent graphs. Nodes without an edge to
    another node have no row. An empty edge table gives an empty result. Where one end has far more
    different nodes than the other, it is best ``src``.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark, "components")
    s, d = (F.col(x) if isinstance(x, str) else x for x in (src, dst))
    keys = list(keys)
    now = scratch.save(edges.select(*keys, s.alias("a"), d.alias("b")).dropna().where("a <> b"), "edges")

    def ends() -> DataFrame:
        return now.select(*keys, F.col("a").alias("node"), F.col("b").alias("m")).unionByName(now.select(*keys, F.col("b").alias("node"), F.col("a").alias("m")))

    rounds: list[DataFrame] = []
    while rows := now.count():
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components did not converge in {max_rounds} rounds")
        trees = _trees(ends(), keys, scratch, 2 * rows)
        rounds.append(trees)
        half = now.join(_named(trees, keys, "a", "i"), [*keys, "a"]).select(*keys, "i", "b").distinct()
        whole = half.join(_named(trees, keys, "b", "j"), [*keys, "b"]).where("i <> j")
        after = scratch.save(whole.select(*keys, F.greatest("i", "j").alias("a"), F.least("i", "j").alias("b")).distinct(), "edges", rows)
        scratch.drop(now)
        now = after
    if not rounds:
        return ends().withColumnRenamed("m", "component")
    found = rounds.pop().withColumnRenamed("root", "component")
    while rounds:
        trees, of = rounds.pop(), found.withColumnRenamed("node", "root")
        found = trees.join(of, [*keys, "root"], "left").select(*keys, "node", F.coalesce("component", "root").alias("component"))
        if rounds:
            found = scratch.save(found, "found")
    return found
