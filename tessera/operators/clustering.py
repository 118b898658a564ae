"""Iterative clustering of masks into nodes, confident links first.

A node is named by its least mask number, which keeps the order of nodes. Two engines give the same
nodes: ``grouped`` solves each scene in one task with sparse sets, for scenes of up to GROUPED_MASKS
masks; ``joined`` runs every round as joins over all scenes, for scenes of any size.

Whether enough of two nodes' observers support them does not depend on the round, so both engines
keep the pairs that agree, with their observers, and a round only reads off those at its threshold.
After a merge they form the pairs of the merged nodes again and of no others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import consensus
from tessera.operators.components import connected_components
from tessera.operators.containment import containment, visible_frames
from tessera.operators.incidence import masks as number_masks
from tessera.plans.config import Params
from tessera.plans.scratch import Scratch

#: A scene of so many masks, each held by or seen in a hundred others, takes some 100 MB and a minute in one task.
GROUPED_MASKS = 6_000


def start(valid: DataFrame) -> DataFrame:
    """Columns seq, node, gid: each valid mask as a node of its own."""
    return valid.where("valid").select("seq", F.col("gid").alias("node"), "gid")


def merge(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """Nodes of one component become one."""
    return nodes.join(components, ["seq", "node"], "left").select("seq", F.coalesce("component", "node").alias("node"), "gid")


def node_rows(nodes: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Distinct (seq, node, column) over the masks of each node: the union of what they see or are held by."""
    return nodes.join(rows, ["seq", "gid"]).select("seq", "node", column).distinct()


def one_round(nodes: DataFrame, contained: DataFrame, visible: DataFrame, least: DataFrame, connect: float, scratch: Scratch) -> DataFrame:
    """The nodes after linking and merging once at the thresholds ``least`` (seq, threshold)."""
    pairs = consensus.agreeing(node_rows(nodes, contained, "by_gid"), node_rows(nodes, visible, "frame_id"), connect)
    return merge(nodes, connected_components(consensus.links_at(pairs, least), "i", "j", keys=["seq"], scratch=scratch))


def joined(nodes: DataFrame, contained: DataFrame, visible: DataFrame, least: DataFrame, connect: float, rounds: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """All rounds as joins; a round without links costs one look at the pairs that agree."""
    scratch = scratch or Scratch(nodes.sparkSession, "clustering")
    depth = (least.agg(F.max("round")).first()[0] or 0) + 1
    now = scratch.save(nodes, "nodes")
    agree = lambda changed=None: consensus.agreeing(node_rows(now, contained, "by_gid"), node_rows(now, visible, "frame_id"), connect, changed)
    pairs = scratch.save(agree(), "pairs")
    for k in range(min(depth, rounds if rounds is not None else depth)):
        linked = consensus.links_at(pairs, least.where(F.col("round") == k))
        if not linked.take(1):
            continue
        found = scratch.save(connected_components(linked, "i", "j", keys=["seq"], scratch=scratch), "components")
        before, now = now, scratch.save(merge(now, found), "nodes")
        gone = lambda end: found.select("seq", F.col("node").alias(end))
        same = pairs.join(gone("i"), ["seq", "i"], "left_anti").join(gone("j"), ["seq", "j"], "left_anti")
        fresh = agree(found.select("seq", F.col("component").alias("node")).distinct())
        was, pairs = pairs, scratch.save(same.unionByName(fresh), "pairs")
        for done in (before, was, found):
            scratch.drop(done)
    return now


def _grouped_rows(keys: np.ndarray, values: np.ndarray, n: int) -> list[np.ndarray]:
    """The values of each key from 0 to n - 1."""
    order = np.argsort(keys, kind="stable")
    return np.split(values[order], np.searchsorted(keys[order], np.arange(1, n)))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of numbers."""
    width = int(b.max()) + 1 if len(b) else 1
    both = np.unique(a.astype(np.int64) * width + b)
    return both // width, both % width


def _agreeing(held: tuple[np.ndarray, np.ndarray], seen: tuple[np.ndarray, np.ndarray], n: int, of: np.ndarray, connect: float) -> list[np.ndarray]:
    """(i, j, observers) with one node among ``of``: counts of a node with all others from lists by value, so no matrix is held."""
    by_node = [_grouped_rows(k, v, n) for k, v in (held, seen)]
    by_value = [_grouped_rows(v, k, int(v.max()) + 1 if len(v) else 1) for k, v in (held, seen)]
    chosen = np.zeros(n, bool)
    chosen[of] = True
    rate, none, out = np.float32(connect), [np.zeros(0, np.int64)], [(np.zeros(0, np.int64),) * 3]
    for x in of.tolist():
        supporters, observers = (np.bincount(np.concatenate([lists[v] for v in mine[x]] or none), minlength=n) for mine, lists in zip(by_node, by_value))
        other = np.flatnonzero((supporters > 0) & (observers > 0))
        other = other[(other != x) & ~(chosen[other] & (other < x))]
        o = observers[other]
        fits = supporters[other].astype(np.float32) / (o.astype(np.float32) + np.float32(1e-7)) >= rate
        out.append((np.minimum(x, other[fits]), np.maximum(x, other[fits]), o[fits]))
    return [np.concatenate(c) for c in zip(*out)]


def _scene(connect: float, rounds: int | None):
    """All rounds of one scene: rows (kind, a, b) with kind 0: node gid, 1: gid held by b, 2: gid seen in b, 3: threshold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seq = pdf["seq"].iloc[0]
        part = {k: pdf[pdf["kind"] == k] for k in range(4)}
        gids = np.sort(part[0]["a"].to_numpy()).astype(np.int64)
        n = len(gids)

        def incidence(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            rows = rows[rows["a"].isin(gids)]
            return np.searchsorted(gids, rows["a"].to_numpy(np.int64)), pd.factorize(rows["b"])[0].astype(np.int64)

        held, seen = incidence(part[1]), incidence(part[2])
        least = part[3].sort_values("a")["v"].to_numpy()
        root = np.arange(n)
        i, j, o = _agreeing(held, seen, n, root, connect) if n else [np.zeros(0, np.int64)] * 3
        for threshold in least[: len(least) if rounds is None else rounds]:
            linked = o >= threshold
            if not linked.any():
                continue
            label = np.arange(n)
            for a, b in zip(i[linked].tolist(), j[linked].tolist()):
                while label[a] != a:
                    label[a] = label[label[a]]
                    a = label[a]
                while label[b] != b:
                    label[b] = label[label[b]]
                    b = label[b]
                label[max(a, b)] = min(a, b)
            for k in range(n):
                label[k] = label[label[k]]
            heads = np.unique(label[label != np.arange(n)])
            merged = np.isin(label, heads)
            root = label[root]
            held, seen = _distinct(label[held[0]], held[1]), _distinct(label[seen[0]], seen[1])
            same = ~(merged[i] | merged[j])
            i, j, o = (np.concatenate([old[same], new]) for old, new in zip((i, j, o), _agreeing(held, seen, n, heads, connect)))
        return pd.DataFrame({"seq": seq, "node": gids[root].astype(np.int32), "gid": gids.astype(np.int32)})

    return run


def grouped(nodes: DataFrame, contained: DataFrame, visible: DataFrame, least: DataFrame, connect: float, rounds: int | None = None) -> DataFrame:
    """All rounds of each scene in one task."""
    void = F.lit(None).cast("double")
    rows = (
        nodes.select("seq", F.lit(0).alias("kind"), F.col("gid").cast("long").alias("a"), F.lit("").alias("b"), void.alias("v"))
        .unionByName(contained.select("seq", F.lit(1).alias("kind"), F.col("gid").cast("long").alias("a"), F.col("by_gid").cast("string").alias("b"), void.alias("v")))
        .unionByName(visible.select("seq", F.lit(2).alias("kind"), F.col("gid").cast("long").alias("a"), F.col("frame_id").cast("string").alias("b"), void.alias("v")))
        .unionByName(least.select("seq", F.lit(3).alias("kind"), F.col("round").cast("long").alias("a"), F.lit("").alias("b"), F.col("threshold").alias("v")))
    )
    kind = dict(nodes.dtypes)["seq"]
    return rows.groupBy("seq").applyInPandas(_scene(connect, rounds), f"seq {kind}, node int, gid int")


def cluster(inc: DataFrame, p: Params, frames: DataFrame | None = None, rounds: int | None = None, engine: str | None = None, scratch: Scratch | None = None):
    """(nodes, masks, contained, validity, visible) of all scenes of an incidence table.

    engine: grouped or joined; by default joined only if a scene has more masks than GROUPED_MASKS.
    Scenes without masks, or without valid ones, have no nodes.
    """
    scratch = scratch or Scratch(inc.sparkSession, "cluster")
    inc = scratch.save(inc, "incidence")
    masks = scratch.save(number_masks(inc, frames), "masks")
    contained, valid = containment(inc, masks, p, scratch)
    valid = scratch.save(valid, "valid")
    contained = scratch.save(contained, "contained")
    visible = visible_frames(contained, masks)
    least = consensus.thresholds(visible)
    if engine is None:
        most = masks.groupBy("seq").count().agg(F.max("count")).first()[0] or 0
        engine = "joined" if most > GROUPED_MASKS else "grouped"
    nodes = start(valid)
    if engine == "joined":
        visible, least = scratch.save(visible, "visible"), scratch.save(least, "thresholds")
        nodes = joined(nodes, contained, visible, least, p.view_consensus_threshold, rounds, scratch)
    else:
        nodes = grouped(nodes, contained, visible, least, p.view_consensus_threshold, rounds)
    return scratch.save(nodes, "nodes"), masks, contained, valid, visible
