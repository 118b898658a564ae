"""Text layouts of scene datasets, parsed by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import gl_to_cv, intrinsics, quaternion_rotation, rigid_inverse


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Columns path, n, line of text files, in file order; whole small files are read at once."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split(F.regexp_replace("value", "\\r?\\n$", ""), "\\r?\\n", -1)).alias("n", "line"))


def numbers(line: Column, kind: str = "double") -> Column:
    """The numbers of a line as an array."""
    return F.transform(F.filter(F.split(line, "\\s+"), lambda x: x != ""), lambda x: x.cast(kind))


def paired_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Columns keys, pos, head, body: lines (keys, n, line) two by two; a last odd line has a null body."""
    pos = F.floor(F.col("n") / 2).cast("int")
    return lines.groupBy(*keys, pos.alias("pos")).agg(F.max(F.when(F.col("n") % 2 == 0, F.col("line"))).alias("head"), F.max(F.when(F.col("n") % 2 == 1, F.col("line"))).alias("body"))


def scan_split(spark: SparkSession, path: str) -> DataFrame:
    """Column seq: the scene names of a split list, in order of n."""
    return numbered_lines(spark, path).select("n", F.trim("line").alias("seq")).where("seq <> ''")


def scan_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Columns path, pose: the 4x4 matrix of each file, row-major."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), numbers(F.col("value")).alias("pose"))


def scan_intrinsics(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Columns path, intr: focal lengths and centre of a 4x4 camera matrix."""
    m = F.col("pose")
    intr = F.struct(m[0].alias("fx"), m[5].alias("fy"), m[2].alias("cx"), m[6].alias("cy"), F.lit(width).alias("w"), F.lit(height).alias("h"))
    return scan_matrix(spark, path).select("path", intr.alias("intr"))


def scan_conf(spark: SparkSession, path: str, views: int = 6) -> DataFrame:
    """Columns path, idx, depth, rgb, intr, pose of a camera configuration.

    An ``intrinsics_matrix`` line holds for the next ``views`` scans; a ``scan`` line has a depth file,
    a colour file and a 4x4 pose whose axes are turned to those of the other layouts.
    """
    lines = numbered_lines(spark, path).select("path", "n", F.filter(F.split("line", "\\s+"), lambda x: x != "").alias("w"))
    lines = lines.where(F.size("w") > 0).withColumn("kind", F.col("w")[0])
    order = Window.partitionBy("path").orderBy("n")
    scans = lines.where("kind = 'scan'").withColumn("idx", F.row_number().over(order) - 1)
    cameras = lines.where("kind = 'intrinsics_matrix'").withColumn("at", F.row_number().over(order) - 1)
    k = F.transform(F.slice("w", 2, 9), lambda x: x.cast("double"))
    cameras = cameras.select("path", "at", k.alias("k")).select("path", F.explode(F.sequence(F.col("at") * views, F.col("at") * views + views - 1)).alias("idx"), "k")
    pose = gl_to_cv(F.transform(F.slice("w", 4, 16), lambda x: x.cast("double")))
    met = scans.select("path", "idx", F.col("w")[1].alias("depth"), F.col("w")[2].alias("rgb"), pose.alias("pose")).join(cameras, ["path", "idx"])
    m = F.col("k")
    return met.select("path", "idx", "depth", "rgb", F.struct(m[0].alias("fx"), m[4].alias("fy"), m[2].alias("cx"), m[5].alias("cy")).alias("intr"), "pose")


def scan_colmap_cameras(spark: SparkSession, path: str) -> DataFrame:
    """Columns path, camera_id, model, width, height, params, intr."""
    rows = numbered_lines(spark, path).where(~F.startswith("line", F.lit("#")) & (F.trim("line") != "")).select("path", F.split(F.trim("line"), "\\s+").alias("w"))
    params = F.transform(F.slice("w", 5, F.greatest(F.size("w") - 4, F.lit(0))), lambda x: x.cast("double"))
    out = rows.select("path", F.col("w")[0].cast("int").alias("camera_id"), F.col("w")[1].alias("model"), F.col("w")[2].cast("int").alias("width"), F.col("w")[3].cast("int").alias("height"), params.alias("params"))
    return out.withColumn("intr", intrinsics(F.col("model"), F.col("params")))


def scan_colmap_images(spark: SparkSession, path: str) -> DataFrame:
    """Columns path, pos, image_id, qvec, tvec, camera_id, name, xys, point3d_ids: two lines an image, in file order."""
    rows = numbered_lines(spark, path).where(~F.startswith("line", F.lit("#")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1)
    w, x = F.split(F.trim("head"), "\\s+"), numbers(F.coalesce("body", F.lit("")))
    pairs = paired_lines(rows, ["path"]).where(F.trim("head") != "").select("path", "pos", w.alias("w"), x.alias("x"))
    double = lambda a, b: F.transform(F.slice("w", a, b), lambda v: v.cast("double"))
    triples = F.sequence(F.lit(0), F.floor(F.size("x") / 3).cast("int") - 1)
    some = F.size("x") >= 3
    return pairs.select(
        "path", "pos", F.col("w")[0].cast("int").alias("image_id"), double(2, 4).alias("qvec"), double(6, 3).alias("tvec"), F.col("w")[8].cast("int").alias("camera_id"), F.col("w")[9].alias("name"),
        F.when(some, F.transform(triples, lambda i: F.array(F.get("x", 3 * i), F.get("x", 3 * i + 1)))).alias("xys"),
        F.when(some, F.transform(triples, lambda i: F.get("x", 3 * i + 2).cast("long"))).alias("point3d_ids"),
    )


def colmap_poses(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Columns path, pos, frame_id, intr, pose: camera-to-world poses; the first camera serves all images.

    The frame number is what stands between the first underscore and the dot of the file name.
    """
    first = cameras.orderBy("camera_id").limit(1).select("intr")
    q, t = F.col("qvec"), F.col("tvec")
    pose = rigid_inverse(quaternion_rotation(*(q[i] for i in range(4))), t)
    frame = F.element_at(F.split(F.element_at(F.split("name", "\\."), 1), "_"), 2).cast("int")
    return images.select("path", "pos", frame.alias("frame_id"), pose.alias("pose")).crossJoin(F.broadcast(first))  # one row


def scan_gt(spark: SparkSession, path: str) -> DataFrame:
    """Columns path, point_id, gt_id: one number a line, in the order of the points."""
    return numbered_lines(spark, path).where(F.trim("line") != "").select("path", F.col("n").cast("long").alias("point_id"), F.trim("line").cast("double").cast("int").alias("gt_id"))


def scan_segments(spark: SparkSession, path: str) -> DataFrame:
    """Columns path, point_id, segment of a JSON file with segIndices."""
    rows = spark.read.schema("segIndices array<int>").json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), "segIndices")
    return rows.select("path", F.posexplode("segIndices").alias("point_id", "segment")).withColumn("point_id", F.col("point_id").cast("long"))


def scan_groups(spark: SparkSession, path: str) -> DataFrame:
    """Columns path, pos, id, label, segments of a JSON file with segGroups."""
    rows = spark.read.schema("segGroups array<struct<id:int,label:string,segments:array<int>>>").json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), "segGroups")
    return rows.select("path", F.posexplode("segGroups").alias("pos", "g")).select("path", "pos", "g.id", "g.label", "g.segments")


def scan_tsv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The named columns of a tab-separated table with a header, + row: the place of each line of the one file."""
    lines = numbered_lines(spark, path)
    header = lines.where("n = 0").select("path", F.split("line", "\t").alias("header"))
    body = lines.where("n > 0").where(F.trim("line") != "").select("path", (F.col("n") - 1).alias("row"), F.split("line", "\t", -1).alias("w"))
    met = body.join(header, "path")
    fields = [c.strip().rsplit(" ", 1) for c in columns.split(",")]
    return met.select("row", *(F.get("w", F.array_position("header", n).cast("int") - 1).cast(k).alias(n) for n, k in fields))


def vocabulary(spark: SparkSession, dataset: str, labels: list[str], ids: list[int]) -> DataFrame:
    """Columns dataset, idx, label, label_id: a label list and its ids, one to one."""
    if len(labels) != len(ids):
        raise ValueError("labels and ids differ in number")
    return spark.createDataFrame([(dataset, i, n, k) for i, (n, k) in enumerate(zip(labels, ids))], "dataset string, idx int, label string, label_id int")
