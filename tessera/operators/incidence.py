"""The incidence relation (seq, frame_id, mask_id, point_id) and what is derived from it directly.

A scene is one ``seq``; every operator works on all scenes at once, keyed by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["seq", "frame_id", "mask_id", "point_id"]


def incidence(df: DataFrame, seq, frame, mask, point) -> DataFrame:
    """Distinct incidences from any table that can be read as frame, mask and point; rows with nulls are dropped."""
    return df.select(*(F.lit(c).alias(k) if not isinstance(c, F.Column) else c.alias(k) for c, k in zip((seq, frame, mask, point), KEYS))).dropna().distinct()


def point_frame(inc: DataFrame) -> DataFrame:
    """Frames in which each point appears in some mask."""
    return inc.select("seq", "point_id", "frame_id").distinct()


def boundary(inc: DataFrame) -> DataFrame:
    """Points that lie in two masks or more of one frame; they are unreliable in every frame."""
    return inc.groupBy("seq", "point_id", "frame_id").count().where("count > 1").select("seq", "point_id").distinct()


def masks(inc: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """Columns seq, gid, frame_id, mask_id: masks numbered from 0 in each scene, by frame order and mask id.

    frames: seq, frame_id, frame_idx, where the order of frames is not that of their ids.
    """
    found = inc.select("seq", "frame_id", "mask_id").distinct()
    order = "frame_id"
    if frames is not None:
        found, order = found.join(frames.select("seq", "frame_id", "frame_idx"), ["seq", "frame_id"]), "frame_idx"
    nth = F.row_number().over(Window.partitionBy("seq").orderBy(order, "mask_id")) - 1
    return found.select("seq", nth.cast("int").alias("gid"), "frame_id", "mask_id")


def with_gid(inc: DataFrame, of: DataFrame) -> DataFrame:
    """Incidences with the number of their mask."""
    return inc.join(of, ["seq", "frame_id", "mask_id"])


def interior(inc: DataFrame) -> DataFrame:
    """Incidences without boundary points."""
    return inc.join(boundary(inc), ["seq", "point_id"], "left_anti").select(KEYS)
