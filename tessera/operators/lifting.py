"""From pixels with mask numbers, depth and poses to incidences of masks and scene points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import backproject, valid_depth, valid_pose
from tessera.operators.spatial import denoise, first_within, voxel_downsample
from tessera.plans.config import Params

MASK = ["seq", "frame_id", "mask_id"]


def mask_points(pixels: DataFrame, cameras: DataFrame, p: Params = Params()) -> DataFrame:
    """Columns seq, frame_id, mask_id, point_id, x, y, z: world points of the labelled pixels of usable frames.

    Masks of fewer than few_points points are left out.
    """
    usable = cameras.where(valid_pose(F.col("pose")))
    seen = pixels.where((F.col("mask_id") != 0) & valid_depth(F.col("depth"), p.depth_trunc)).join(usable, ["seq", "frame_id"])
    x, y, z = backproject(F.col("u"), F.col("v"), F.col("depth").cast("double"), F.col("intr"), F.col("pose"))
    nth = F.row_number().over(Window.partitionBy(*MASK).orderBy("v", "u"))
    points = seen.select(*MASK, nth.cast("long").alias("point_id"), x.alias("x"), y.alias("y"), z.alias("z"))
    return large_masks(points, p.few_points)


def large_masks(points: DataFrame, least: int) -> DataFrame:
    return points.join(points.groupBy(*MASK).count().where(F.col("count") >= least).select(MASK), MASK, "left_semi")


def lift(pixels: DataFrame, cameras: DataFrame, scene: DataFrame, p: Params = Params()) -> DataFrame:
    """Incidences (seq, frame_id, mask_id, point_id) of scene points near the points of each mask.

    Mask points are thinned to voxels and freed of noise; each takes the first neighbours of the
    scene within the distance; masks of which too few points have any are left out.
    """
    raw = mask_points(pixels, cameras, p)
    thin = voxel_downsample(raw, p.distance, MASK)
    nth = F.row_number().over(Window.partitionBy(*MASK).orderBy("x", "y", "z"))
    thin = thin.select(*MASK, nth.cast("long").alias("point_id"), "x", "y", "z")
    clean = large_masks(denoise(thin, MASK), p.few_points)
    return near_points(clean, scene, p)


def near_points(points: DataFrame, scene: DataFrame, p: Params = Params()) -> DataFrame:
    """Incidences of the scene points among the first neighbours of each mask's points (seq, frame_id, mask_id, point_id, x, y, z).

    Masks with neighbours for a smaller share of their points than ``coverage`` are left out.
    """
    left = points.select("seq", F.struct("frame_id", "mask_id", "point_id").alias("id"), "x", "y", "z")
    right = scene.select("seq", F.col("point_id").alias("id"), "x", "y", "z")
    near = first_within(left, right, p.distance, p.neighbours)
    found = near.select("seq", "l_id.frame_id", "l_id.mask_id", F.col("l_id.point_id").alias("mp"), F.col("r_id").alias("point_id"))
    total = points.groupBy(*MASK).agg(F.count("*").alias("n"))
    covered = found.groupBy(*MASK).agg(F.count_distinct("mp").alias("hit")).join(total, MASK).where(F.col("hit") / F.col("n") >= p.coverage)
    return found.join(covered.select(MASK), MASK, "left_semi").select(*MASK, "point_id").distinct()


def paint(candidates: DataFrame, p: Params = Params()) -> DataFrame:
    """Columns seq, frame_id, v, u, mask_id: label image of overlapping scored masks.

    candidates: seq, frame_id, cand, score, v, u. Candidates of too little confidence or too few
    pixels go; the others are painted by rising score, so a pixel belongs to the surest mask over it,
    and are numbered from 1 in that order, even those that others cover wholly.
    """
    sure = candidates.where(F.col("score") >= p.confidence)
    one = sure.groupBy("seq", "frame_id", "cand").agg(F.max("score").alias("score"), F.count("*").alias("n")).where(F.col("n") >= p.min_pixels)
    nth = F.row_number().over(Window.partitionBy("seq", "frame_id").orderBy("score", "cand"))
    numbered = one.select("seq", "frame_id", "cand", nth.alias("mask_id"))
    return sure.join(numbered, ["seq", "frame_id", "cand"]).groupBy("seq", "frame_id", "v", "u").agg(F.max("mask_id").alias("mask_id"))


def without_depth_edges(pixels: DataFrame, delta: float = 0.05) -> DataFrame:
    """pixels (seq, frame_id, v, u, depth) with depth 0 where a pixel beside, above or below differs by more than delta."""
    jump = F.lit(False)
    for across, along in (("u", "v"), ("v", "u")):
        w = Window.partitionBy("seq", "frame_id", across).orderBy(along)
        for near in (F.lag, F.lead):
            adjacent = F.abs(near(along).over(w) - F.col(along)) == 1
            jump = jump | F.coalesce(adjacent & (F.abs(near("depth").over(w) - F.col("depth")) > delta), F.lit(False))
    return pixels.withColumn("_jump", jump).withColumn("depth", F.when(F.col("_jump"), F.lit(0).cast(dict(pixels.dtypes)["depth"])).otherwise(F.col("depth"))).drop("_jump")
