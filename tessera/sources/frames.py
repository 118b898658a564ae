"""Frame lists and paths of the scene layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seq string, frame_id int, frame_idx int"


def strided(found: DataFrame, stride: int) -> DataFrame:
    """Columns seq, frame_id, frame_idx: 0, stride, 2 stride .. up to the largest id found, whether those files exist or not."""
    top = found.groupBy("seq").agg(F.max("frame_id").alias("top"))
    return top.select("seq", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long"), F.lit(stride).cast("long"))).alias("frame_idx", "frame_id")).select("seq", "frame_id", "frame_idx")


def every(found: DataFrame, stride: int) -> DataFrame:
    """Each stride-th frame in the order of their place (seq, frame_id, pos)."""
    return found.where(F.col("pos") % stride == 0).select("seq", "frame_id", (F.col("pos") / stride).cast("int").alias("frame_idx"))


def scan_frames(spark: SparkSession, pattern: str, stride: int, seq: str) -> DataFrame:
    """Frames of the image files that match a glob, by the number that their names consist of."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    ids = files.select(F.lit(seq).alias("seq"), F.regexp_extract("path", r"([^/]*?)(\d+)[^/0-9]*$", 2).cast("int").alias("frame_id")).dropna()
    return strided(ids, stride)


#: Layouts by name: colour and segmentation paths with {seq} and {frame}, scale of depth, and how frames are chosen.
LAYOUTS = {
    "scannet": {"rgb": "{seq}/color/{frame}.jpg", "depth": "{seq}/depth/{frame}.png", "seg": "{seq}/output/mask/{frame}.png", "pad": 0, "scale": 1000.0, "frames": strided, "resize": (480, 640)},
    "demo": {"rgb": "{seq}/color_640/{frame}.jpg", "depth": "{seq}/depth/{frame}.png", "seg": "{seq}/output/mask/{frame}.png", "pad": 0, "scale": 1000.0, "frames": strided, "resize": None},
    "scannetpp": {"rgb": "{seq}/iphone/rgb/frame_{frame}.jpg", "depth": "{seq}/iphone/render_depth/frame_{frame}.png", "seg": "{seq}/output/mask/frame_{frame}.png", "pad": 6, "scale": 1000.0, "frames": every, "resize": None},
    "matterport3d": {"rgb": "{seq}/undistorted_color_images/{frame}.jpg", "depth": "{seq}/undistorted_depth_images/{frame}.png", "seg": "{seq}/output/mask/{frame}.png", "pad": 0, "scale": 4000.0, "frames": strided, "resize": None},
}


def layout(name: str) -> dict:
    """The layout of a dataset; an unknown name is an error."""
    if name not in LAYOUTS:
        raise NotImplementedError(f"unknown dataset {name!r}; known: {', '.join(LAYOUTS)}")
    return LAYOUTS[name]


def frame_paths(frames: DataFrame, dataset: str, root: str) -> DataFrame:
    """frames + rgb_path, depth_path, seg_path."""
    of = layout(dataset)
    frame = F.col("frame_id").cast("string")
    if of["pad"]:
        frame = F.lpad(frame, of["pad"], "0")
    path = lambda kind: F.replace(F.replace(F.lit(f"{root.rstrip('/')}/{of[kind]}"), F.lit("{seq}"), F.col("seq")), F.lit("{frame}"), frame)
    return frames.withColumns({f"{kind}_path": path(kind) for kind in ("rgb", "depth", "seg")})
