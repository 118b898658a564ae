"""Vectors as array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """v at unit length; the null vector gives nulls."""
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm(v)))


def mean_vector(df: DataFrame, keys: list[str], v: str, name: str = "v") -> DataFrame:
    """The mean of the vectors of each group, place by place; it is not normalised again."""
    each = df.select(*keys, F.posexplode(v).alias("_i", "_x"))
    means = each.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(name))


def softmax(df: DataFrame, keys: list[str], score: str, temperature: float = 100.0, name: str = "probability") -> DataFrame:
    """df + the softmax of temperature * score within each group, safe from overflow."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("_e", F.exp(F.lit(temperature) * (F.col(score) - F.max(score).over(w))))
    return df.withColumn(name, F.col("_e") / F.sum("_e").over(w)).drop("_e")
