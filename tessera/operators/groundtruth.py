"""Ground truth: instance numbers of scene points from segment annotations of two layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode(label: Column, instance: Column) -> Column:
    """label * 1000 + instance + 1."""
    return label * 1000 + instance + 1


def decode(gt: Column) -> Column:
    return F.floor(gt / 1000).cast("int")


def agnostic(gt: Column, label: int) -> Column:
    """The number with its class replaced by one; unlabelled points become an instance too."""
    return gt % 1000 + F.lit(label * 1000)


def first_label(label_map: DataFrame) -> DataFrame:
    """Columns raw_category, id: the first row of each category."""
    return label_map.groupBy("raw_category").agg(F.min_by("id", "row").alias("id"))


def last_wins(rows: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """The value of the last row of each key."""
    return rows.groupBy(*keys).agg(F.max_by(value, position).alias(value))


def from_segments(segs: DataFrame, groups: DataFrame, label_map: DataFrame, valid: DataFrame) -> DataFrame:
    """Columns seq, point_id, gt_id. segs: seq, point_id, segment; groups: seq, pos, id, label, segments.

    The last group that holds a point's segment names it. A label outside the map or outside
    ``valid`` (label_id) counts as 0; points of no group have number 1.
    """
    ids = first_label(label_map).select(F.col("raw_category").alias("label"), F.col("id").alias("label_id"))
    ids = ids.join(valid.select("label_id").distinct(), "label_id", "left_semi")
    named = groups.join(ids, "label", "left").fillna(0, ["label_id"])
    each = named.select("seq", "pos", "label_id", F.col("id").alias("group"), F.explode("segments").alias("segment"))
    last = each.groupBy("seq", "segment").agg(F.max(F.struct("pos", "label_id", "group")).alias("g"))
    met = segs.join(last, ["seq", "segment"], "left")
    return met.select("seq", "point_id", F.coalesce(encode(F.col("g.label_id"), F.col("g.group") + 1), F.lit(1)).cast("int").alias("gt_id"))


def face_values(faces: DataFrame, value: str) -> DataFrame:
    """Columns seq, point_id, value: each vertex has the value of the last face that touches it. faces: seq, face_pos, verts."""
    each = faces.select("seq", "face_pos", F.explode("verts").alias("point_id"), value)
    return last_wins(each, ["seq", "point_id"], value, "face_pos")


def from_faces(faces: DataFrame, groups: DataFrame, category_map: DataFrame, valid: DataFrame) -> DataFrame:
    """Columns seq, point_id, gt_id. faces: seq, face_pos, verts, category_id, segment; category_map: row, nyuId.

    Classes come from the face's category by its row in the map, 0 if that is not ``valid``; instances
    from the last group of the face's segment. A segment of no group is an error.
    """
    segment = face_values(faces, "segment")
    category = face_values(faces, "category_id")
    member = groups.select("seq", "pos", "id", F.explode("segments").alias("segment"))
    instance = last_wins(member, ["seq", "segment"], "id", "pos")
    ids = category_map.select(F.col("row").alias("category_id"), F.col("nyuId").alias("label_id"))
    ok = valid.select("label_id").distinct().withColumn("ok", F.lit(True))
    met = segment.join(category, ["seq", "point_id"]).join(instance, ["seq", "segment"], "left").join(ids, "category_id", "left").join(ok, "label_id", "left")
    inst = F.coalesce(F.col("id"), F.raise_error(F.concat_ws(" ", F.lit("segment of no instance"), "seq", "segment")).cast("int"))
    label = F.when(F.col("ok"), F.col("label_id")).otherwise(0)
    return met.select("seq", "point_id", encode(label, inst).cast("int").alias("gt_id"))


def instances(gt: DataFrame, valid: DataFrame) -> DataFrame:
    """Columns seq, instance_id, label_id, vert_count, med_dist, dist_conf of the instances of valid classes; number 0 is none."""
    counts = gt.where("gt_id <> 0").groupBy("seq", F.col("gt_id").alias("instance_id")).agg(F.count("*").alias("vert_count"))
    counts = counts.withColumn("label_id", decode(F.col("instance_id"))).join(valid.select("label_id").distinct(), "label_id", "left_semi")
    return counts.select("seq", "instance_id", "label_id", "vert_count", F.lit(-1.0).alias("med_dist"), F.lit(0.0).alias("dist_conf"))


def class_counts(gt: DataFrame) -> DataFrame:
    """Columns seq, classes, numbers: how many different classes and instance numbers a scene has."""
    return gt.groupBy("seq").agg(F.count_distinct(decode(F.col("gt_id"))).alias("classes"), F.count_distinct("gt_id").alias("numbers"))
