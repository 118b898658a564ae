"""Open-vocabulary labels: mean features of an object's masks against features of label texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, l2_normalize, mean_vector, softmax


def mask_features(crops: DataFrame) -> DataFrame:
    """Columns seq, frame_id, mask_id, v: mean of the unit vectors of a mask's crops (seq, frame_id, mask_id, v)."""
    return mean_vector(crops.withColumn("v", l2_normalize(F.col("v"))), ["seq", "frame_id", "mask_id"], "v")


def object_features(objects: DataFrame, features: DataFrame) -> DataFrame:
    """Columns seq, object_id, v: mean over an object's representative masks; a mask without features is an error."""
    each = objects.select("seq", "object_id", F.explode("repre_mask_list").alias("m")).select("seq", "object_id", "m.frame_id", "m.mask_id")
    met = each.join(features.select("seq", "frame_id", "mask_id", "v"), ["seq", "frame_id", "mask_id"], "left")
    absent = F.raise_error(F.concat_ws(" ", F.lit("no features of mask"), "frame_id", "mask_id")).cast("array<double>")
    met = met.withColumn("v", F.coalesce(F.col("v").cast("array<double>"), absent))
    return mean_vector(met, ["seq", "object_id"], "v")


#: Labels that go to every task; a larger vocabulary meets the objects block by block.
LABELS = 8_192


def similarity(objects: DataFrame, labels: DataFrame, keys: list[str], most: int = LABELS) -> DataFrame:
    """Columns keys, idx, label, similarity: dot products with all labels (label, idx, v)."""
    vocabulary = labels.select("idx", "label", F.col("v").alias("_t"))
    out = (*keys, "idx", "label", dot(F.col("v"), F.col("_t")).alias("similarity"))
    blocks = -(-vocabulary.limit(most + 1).count() // most)
    if blocks < 2:
        return objects.crossJoin(F.broadcast(vocabulary)).select(*out)  # no more than ``most`` rows
    blocks = -(-vocabulary.count() // most)
    each = objects.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return each.join(vocabulary.withColumn("_block", F.pmod(F.xxhash64("idx"), F.lit(blocks)).cast("int")), "_block").select(*out)


def probabilities(similar: DataFrame, keys: list[str], temperature: float = 100.0) -> DataFrame:
    return softmax(similar, keys, "similarity", temperature)


def best_label(similar: DataFrame, keys: list[str]) -> DataFrame:
    """Columns keys, label, idx, similarity: the largest dot product, which has the largest probability; the first of equal labels."""
    best = similar.groupBy(*keys).agg(F.max(F.struct("similarity", (-F.col("idx")).alias("i"), "label")).alias("b"))
    return best.select(*keys, F.col("b.label").alias("label"), (-F.col("b.i")).alias("idx"), F.col("b.similarity").alias("similarity"))


def classify(objects: DataFrame, features: DataFrame, labels: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Columns seq, object_id, class_id: the id of the best label; 0 for objects without representative masks.

    vocabulary: label, label_id.
    """
    found = best_label(similarity(object_features(objects, features), labels, ["seq", "object_id"]), ["seq", "object_id"])
    named = found.join(vocabulary.select("label", "label_id"), "label")
    out = objects.select("seq", "object_id").join(named, ["seq", "object_id"], "left")
    return out.select("seq", "object_id", F.coalesce("label_id", F.lit(0)).cast("int").alias("class_id"))
