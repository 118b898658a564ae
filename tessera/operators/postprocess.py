"""From nodes of masks to objects: split by density, filtered by detection ratio, freed of overlapping ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.incidence import point_frame, with_gid
from tessera.operators.spatial import GROUPED_POINTS, dbscan, dbscan_joined
from tessera.plans.config import Params
from tessera.plans.scratch import Scratch

OBJECT = ["seq", "node", "component"]
#: Pairs of objects that one task judges in order.
GROUPED_PAIRS = 1_000_000


def merged_nodes(nodes: DataFrame, least: int = 2) -> DataFrame:
    """Nodes of at least so many masks."""
    return nodes.join(nodes.groupBy("seq", "node").count().where(F.col("count") >= least).select("seq", "node"), ["seq", "node"], "left_semi")


def node_points(nodes: DataFrame, inc: DataFrame, masks: DataFrame) -> DataFrame:
    """Columns seq, node, point_id: the points of a node's masks, boundary points included."""
    return with_gid(inc, masks).join(nodes, ["seq", "gid"]).select("seq", "node", "point_id").distinct()


def split(points: DataFrame, scene: DataFrame, p: Params, scratch: Scratch | None = None, most: int = GROUPED_POINTS) -> DataFrame:
    """Columns seq, node, component, point_id: density clusters of each node; its noise is component 0.

    A node of at most ``most`` points is one task's; larger ones are split by joins, with the same numbers.
    """
    scratch = scratch or Scratch(points.sparkSession, "split")
    placed = scratch.save(points.join(scene, ["seq", "point_id"]).select("seq", "node", "point_id", "x", "y", "z"), "placed")
    large = scratch.save(placed.groupBy("seq", "node").count().where(F.col("count") > most).select("seq", "node"), "large")

    def grouped(rows: DataFrame) -> DataFrame:
        return dbscan(rows, p.split_eps, p.split_min_points, ["seq", "node"]).select(*OBJECT, "point_id")

    if not large.take(1):
        return grouped(placed)
    keys = ["seq", "of"]  # node is a column of the components' own
    rows = placed.join(large, ["seq", "node"], "left_semi").withColumnRenamed("node", "of")
    found = scratch.save(dbscan_joined(rows, p.split_eps, p.split_min_points, keys, scratch), "joined")
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("component")).alias("nth")
    numbers = found.where("component is not null").select(*keys, "component").distinct().select(*keys, "component", nth)
    far = found.join(numbers, [*keys, "component"], "left").select("seq", F.col("of").alias("node"), F.coalesce("nth", F.lit(0)).alias("component"), "point_id")
    return grouped(placed.join(large, ["seq", "node"], "left_anti")).unionByName(far)


def passes_ratio(in_node: Column, in_video: Column, least: float) -> Column:
    return in_node / (in_video + F.lit(1e-6)) > F.lit(least)


def detection(objects: DataFrame, nodes: DataFrame, inc: DataFrame, masks: DataFrame, visible: DataFrame) -> DataFrame:
    """Columns of objects (seq, node, component, point_id) + in_node, in_video.

    Both count frames among those that see the node: in_video where the point is in some mask,
    in_node where it is in a mask of the node.
    """
    node_frames = nodes.join(visible, ["seq", "gid"]).select("seq", "node", "frame_id").distinct()
    seen = objects.join(node_frames, ["seq", "node"]).join(point_frame(inc), ["seq", "point_id", "frame_id"])
    video = seen.groupBy(*OBJECT, "point_id").agg(F.count("*").alias("in_video"))
    mine = with_gid(inc, masks).join(nodes, ["seq", "gid"]).select("seq", "node", "frame_id", "point_id").distinct().join(node_frames, ["seq", "node", "frame_id"])
    own = objects.join(mine, ["seq", "node", "point_id"]).groupBy(*OBJECT, "point_id").agg(F.count("*").alias("in_node"))
    out = objects.join(video, [*OBJECT, "point_id"], "left").join(own, [*OBJECT, "point_id"], "left")
    return out.fillna(0, ["in_video", "in_node"])


def assign_masks(objects: DataFrame, nodes: DataFrame, inc: DataFrame, masks: DataFrame) -> DataFrame:
    """Columns seq, node, component, gid, frame_id, mask_id, coverage: each mask of a node goes to the object it shares most points with.

    The first object of equal ones; coverage: the share of the object's points, before any are filtered.
    """
    size = objects.groupBy(*OBJECT).agg(F.count("*").alias("n"))
    mine = with_gid(inc, masks).join(nodes, ["seq", "gid"]).select("seq", "node", "gid", "point_id")
    shared = mine.join(objects, ["seq", "node", "point_id"]).groupBy(*OBJECT, "gid").agg(F.count("*").alias("k"))
    best = shared.groupBy("seq", "node", "gid").agg(F.max(F.struct("k", (-F.col("component")).alias("c"))).alias("b"))
    best = best.select("seq", "node", (-F.col("b.c")).alias("component"), "gid", F.col("b.k").alias("k"))
    return best.join(size, OBJECT).join(masks, ["seq", "gid"]).select(*OBJECT, "gid", "frame_id", "mask_id", (F.col("k") / F.col("n")).alias("coverage"))


def object_overlaps(points: DataFrame) -> DataFrame:
    """Columns seq, i, j, k, n_i, n_j: points that objects i < j share. points: seq, object_id, point_id."""
    size = points.groupBy("seq", "object_id").agg(F.count("*").alias("n"))
    a = points.select("seq", F.col("object_id").alias("i"), "point_id")
    b = points.select("seq", F.col("object_id").alias("j"), "point_id")
    both = a.join(b, ["seq", "point_id"]).where("i < j").groupBy("seq", "i", "j").agg(F.count("*").alias("k"))
    return both.join(size.select("seq", F.col("object_id").alias("i"), F.col("n").alias("n_i")), ["seq", "i"]).join(
        size.select("seq", F.col("object_id").alias("j"), F.col("n").alias("n_j")), ["seq", "j"]
    )


def overlapped(pairs: DataFrame, ratio: float = 0.8, most: int = GROUPED_PAIRS, scratch: Scratch | None = None) -> DataFrame:
    """Columns seq, object_id: objects that go because another holds nearly all of them.

    Pairs are judged in order: of two objects that both stand, the first goes if it lies in the
    second, else the second if it lies in the first. An object that goes while its pairs are being
    judged still meets the rest of them. Scenes with more than ``most`` pairs of which one holds the
    other are judged by rounds of joins (``overlapped_joined``), the others in a task each.
    """
    scratch = scratch or Scratch(pairs.sparkSession, "overlapped")
    kind = dict(pairs.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        pdf = pdf.sort_values(["i", "j"])
        for i, mine in pdf.groupby("i", sort=True):
            if i in gone:
                continue
            for j, first_goes in zip(mine["j"], mine["inner"]):
                if j not in gone:
                    gone.add(i if first_goes else j)
        return pd.DataFrame({"seq": [pdf["seq"].iloc[0]] * len(gone), "object_id": sorted(gone)})

    # only pairs of which one lies in the other can matter; inner: whether that is the first
    first, second = F.col("k") / F.col("n_i") > ratio, F.col("k") / F.col("n_j") > ratio
    near = scratch.save(pairs.where(first | second).select("seq", "i", "j", first.alias("inner")), "near")
    large = scratch.save(near.groupBy("seq").count().where(F.col("count") > most).select("seq"), "large")
    grouped = lambda rows: rows.groupBy("seq").applyInPandas(run, f"seq {kind['seq']}, object_id {kind['i']}")
    if not large.take(1):
        return grouped(near)
    far = overlapped_joined(scratch.save(near.join(large, "seq", "left_semi"), "large_pairs"), scratch)
    return grouped(near.join(large, "seq", "left_anti")).unionByName(far)


def overlapped_joined(near: DataFrame, scratch: Scratch) -> DataFrame:
    """The same by rounds. near: seq, i, j, inner with i < j.

    Whether an object still stands when its own turn comes depends on earlier objects alone: it does
    unless one that stood at its turn held it. All objects whose possible holders are settled are
    settled at once, so the rounds are as many as the longest chain of objects that wait for each other.
    An object that stood falls in its own turn if it lies in a later one that no earlier object took away.
    """
    held = near.where("NOT inner").select("seq", F.col("i").alias("by"), F.col("j").alias("object"))
    waiting = scratch.save(near.select("seq", F.explode(F.array("i", "j")).alias("object")).distinct(), "waiting")
    open_, stood = scratch.save(held, "held"), []
    while waiting.take(1):
        free = scratch.save(waiting.join(open_, ["seq", "object"], "left_anti"), "free")  # no holder left: they stand
        by = free.select("seq", F.col("object").alias("by"))
        fell = scratch.save(open_.join(by, ["seq", "by"], "left_semi").select("seq", "object").distinct(), "fell")
        settled = fell.select("seq", F.col("object").alias("by"))
        left = open_.join(by, ["seq", "by"], "left_anti").join(fell, ["seq", "object"], "left_anti").join(settled, ["seq", "by"], "left_anti")
        waiting = scratch.save(waiting.join(free, ["seq", "object"], "left_anti").join(fell, ["seq", "object"], "left_anti"), "waiting")
        open_ = scratch.save(left, "held")
        stood.append(free)
    stands = stood[0] if stood else waiting
    for more in stood[1:]:
        stands = stands.unionByName(more)
    stands = scratch.save(stands, "stands")
    taken = held.join(stands.withColumnRenamed("object", "by"), ["seq", "by"], "left_semi").groupBy("seq", "object").agg(F.min("by").alias("first"))
    taken = scratch.save(taken, "taken")
    own = near.where("inner").join(stands.withColumnRenamed("object", "i"), ["seq", "i"], "left_semi").join(taken.withColumnRenamed("object", "j"), ["seq", "j"], "left")
    falls = own.where("first IS NULL OR first > i").select("seq", F.col("i").alias("object_id"))
    return falls.unionByName(taken.select("seq", F.col("object").alias("object_id"))).distinct()


def representatives(mask_rows: DataFrame, k: int = 5) -> DataFrame:
    """The first k masks of each object by coverage; equal ones in the order of their numbers. + rank from 1."""
    keys = [c for c in ("seq", "object_id") if c in mask_rows.columns] if "object_id" in mask_rows.columns else OBJECT
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("coverage"), "gid"))
    return mask_rows.withColumn("rank", nth).where(F.col("rank") <= k)


def objects(nodes: DataFrame, inc: DataFrame, masks: DataFrame, visible: DataFrame, scene: DataFrame, p: Params, scratch: Scratch | None = None) -> DataFrame:
    """Columns seq, object_id, point_ids, mask_list, repre_mask_list (structs of frame_id, mask_id, coverage).

    Objects are numbered in each scene in the order of node and component, without those that go.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "objects")
    nodes = scratch.save(merged_nodes(nodes, p.min_masks), "nodes")
    parts = scratch.save(split(node_points(nodes, inc, masks), scene, p, scratch), "parts")
    held = scratch.save(assign_masks(parts, nodes, inc, masks), "masks")
    kept = detection(parts, nodes, inc, masks, visible).where(passes_ratio(F.col("in_node"), F.col("in_video"), p.point_filter_threshold))
    enough = held.groupBy(*OBJECT).count().where(F.col("count") >= p.min_masks).select(OBJECT)
    kept = scratch.save(kept.join(enough, OBJECT, "left_semi").select(*OBJECT, "point_id"), "kept")
    nth = F.row_number().over(Window.partitionBy("seq").orderBy("node", "component")) - 1
    ids = kept.select(OBJECT).distinct().select(*OBJECT, nth.alias("object_id"))
    ids = scratch.save(ids, "ids")
    points = scratch.save(kept.join(ids, OBJECT).select("seq", "object_id", "point_id"), "points")
    gone = overlapped(object_overlaps(points), p.overlap_ratio)
    left = ids.join(gone, ["seq", "object_id"], "left_anti")
    last = F.row_number().over(Window.partitionBy("seq").orderBy("object_id")) - 1
    left = scratch.save(left.select(*OBJECT, F.col("object_id").alias("was"), last.cast("int").alias("object_id")), "left")
    final = points.withColumnRenamed("object_id", "was").join(left, ["seq", "was"]).groupBy("seq", "object_id").agg(F.sort_array(F.collect_list("point_id")).alias("point_ids"))
    mine = held.join(left.drop("was"), OBJECT)
    row = F.struct("frame_id", "mask_id", "coverage")
    listed = mine.groupBy("seq", "object_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("gid", row.alias("m")))), lambda s: s["m"]).alias("mask_list"))
    best = representatives(mine, p.representatives).groupBy("seq", "object_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", row.alias("m")))), lambda s: s["m"]).alias("repre_mask_list")
    )
    return final.join(listed, ["seq", "object_id"]).join(best, ["seq", "object_id"])
