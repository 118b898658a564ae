"""Tables behind pictures: crops of masks, centroids for captions, colours of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import gamma, levels, square_padding


def mask_boxes(image: DataFrame, width: Column, height: Column, n_levels: int = 3, expansion: float = 0.1) -> DataFrame:
    """Columns seq, frame_id, mask_id, level, u0, v0, u1, v1, side, pad_left, pad_top: crops around each mask, level by level wider.

    image: seq, frame_id, v, u, mask_id; the right and lower bounds are exclusive.
    """
    box = image.where("mask_id <> 0").groupBy("seq", "frame_id", "mask_id").agg(F.min("u").alias("a"), F.min("v").alias("b"), F.max("u").alias("c"), F.max("v").alias("d"))
    each = box.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(n_levels - 1))))
    (u0, u1), (v0, v1) = levels(F.col("a"), F.col("c"), width, F.col("level"), expansion), levels(F.col("b"), F.col("d"), height, F.col("level"), expansion)
    out = each.select("seq", "frame_id", "mask_id", "level", u0.alias("u0"), v0.alias("v0"), u1.alias("u1"), v1.alias("v1"))
    side, left, top = square_padding(F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0"))
    return out.withColumns({"side": side, "pad_left": left, "pad_top": top})


def mask_centroids(image: DataFrame) -> DataFrame:
    """Columns seq, frame_id, mask_id, u, v: mean pixel of each mask, cut to whole numbers."""
    return image.where("mask_id <> 0").groupBy("seq", "frame_id", "mask_id").agg(F.avg("u").cast("int").alias("u"), F.avg("v").cast("int").alias("v"))


def scene_colours(scene: DataFrame, pred: DataFrame, seed: int = 0) -> DataFrame:
    """scene (seq, point_id, x, y, z, r, g, b in 0..1) centred, with gamma, and + ir, ig, ib: one colour per instance, the last instance of a point.

    Points of no instance are black.
    """
    mean = scene.groupBy("seq").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
    last = pred.groupBy("seq", "point_id").agg(F.max("inst").alias("inst"))
    met = scene.join(mean, "seq").join(last, ["seq", "point_id"], "left")
    # an odd step through the 256 shades of each channel: 256 instances in a row differ in all three
    shade = {f"i{c}": F.coalesce(F.pmod((F.col("inst").cast("long") + 1 + seed) * step, F.lit(256)) / 255, F.lit(0.0)) for c, step in zip("rgb", (97, 57, 151))}
    return met.select("seq", "point_id", *((F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"), *(gamma(F.col(c)).alias(c) for c in "rgb"), *(v.alias(k) for k, v in shade.items()))
