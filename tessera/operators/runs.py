"""Sets of places (pixels of an image, points of a scene) as runs of consecutive numbers: (start, length) instead of a row a place.

A table of runs has its keys, ``start`` and ``length``; runs of one key are disjoint where a function
says so. Runs meet by joins on stretches of SPAN places, which no run is longer than once it is cut,
so a long run spreads over tasks and no row is written for a place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.evaluation import iou

#: Places of a stretch.
SPAN = 4096


def _end() -> Column:
    return F.col("start") + F.col("length")


def merged(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The union of each key's runs, which may overlap or touch, as disjoint runs with gaps between them; empty runs go."""
    order = Window.partitionBy(*keys).orderBy("start", "length")
    before = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    some = runs.where("length > 0").select(*keys, "start", "length", _end().alias("_end"))
    first = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    numbered = some.withColumn("_first", first).withColumn("_n", F.sum("_first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_n").agg(F.min("start").alias("start"), (F.max("_end") - F.min("start")).alias("length")).drop("_n")


def encode(rows: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """Runs of the different places (a number) that each key has a row for."""
    return merged(rows.select(*keys, place.cast("long").alias("start"), F.lit(1).cast("long").alias("length")), keys)


def decode(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Columns keys, place: a row for each place of each run."""
    return runs.where("length > 0").select(*keys, F.explode(F.sequence("start", _end() - 1)).alias("place"))


def packed(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Columns keys, runs: the runs of a key as an array in order, for storage."""
    return runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("runs"))


def unpacked(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, F.explode("runs").alias("_r")).select(*keys, "_r.start", "_r.length")


def sizes(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Columns keys, n: places of disjoint runs."""
    return runs.groupBy(*keys).agg(F.sum("length").alias("n"))


def cut(runs: DataFrame, span: int = SPAN) -> DataFrame:
    """The runs cut where stretches begin, + _span: the number of the stretch."""
    each = runs.where("length > 0").withColumn("_to", _end()).withColumn("_span", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((_end() - 1) / span))))
    start = F.greatest(F.col("start"), F.col("_span") * span)
    return each.withColumn("length", F.least(F.col("_to"), (F.col("_span") + 1) * span) - start).withColumn("start", start).drop("_to")


def intersections(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], on: list[str], span: int = SPAN) -> DataFrame:
    """Columns on, left_keys, right_keys, start, length: the places that runs of both sides have, within equal ``on``.

    Key names differ between the sides. Runs of each key are disjoint, and so are those that come out.
    """
    a = cut(left.select(*on, *left_keys, "start", "length"), span).withColumnsRenamed({"start": "_a", "length": "_m"})
    b = cut(right.select(*on, *right_keys, "start", "length"), span).withColumnsRenamed({"start": "_b", "length": "_n"})
    start = F.greatest("_a", "_b")
    met = a.join(b, [*on, "_span"]).where("_a < _b + _n AND _b < _a + _m")
    found = met.select(*on, *left_keys, *right_keys, start.alias("start"), (F.least(F.col("_a") + F.col("_m"), F.col("_b") + F.col("_n")) - start).alias("length"))
    return merged(found, [*on, *left_keys, *right_keys])  # what was cut is one run again


def overlaps(left: DataFrame, left_keys: list[str], right: DataFrame, right_keys: list[str], on: list[str], span: int = SPAN) -> DataFrame:
    """Columns on, left_keys, right_keys, k, iou of every two keys that share a place."""
    shared = sizes(intersections(left, left_keys, right, right_keys, on, span), [*on, *left_keys, *right_keys]).withColumnRenamed("n", "k")
    a, b = sizes(left, [*on, *left_keys]).withColumnRenamed("n", "_a"), sizes(right, [*on, *right_keys]).withColumnRenamed("n", "_b")
    return shared.join(a, [*on, *left_keys]).join(b, [*on, *right_keys]).select(*on, *left_keys, *right_keys, "k", iou(F.col("k"), F.col("_a"), F.col("_b")).alias("iou"))


def painted(runs: DataFrame, keys: list[str], mask: str, span: int = SPAN) -> DataFrame:
    """Columns keys, mask, start, length: at each place the largest ``mask`` of the runs over it, as disjoint runs.

    A stretch is cut at the ends of its runs; each piece goes to the largest mask that covers it.
    """
    pieces = cut(runs.select(*keys, mask, "start", "length"), span)
    at = [*keys, "_span"]
    ends = pieces.select(*at, F.explode(F.array("start", _end())).alias("_from")).distinct()
    ends = ends.withColumn("_to", F.lead("_from").over(Window.partitionBy(*at).orderBy("_from"))).where("_to IS NOT NULL")
    met = ends.join(pieces, at).where((F.col("start") <= F.col("_from")) & (F.col("_to") <= _end()))
    best = met.groupBy(*at, "_from", "_to").agg(F.max(mask).alias(mask))
    return merged(best.select(*keys, mask, F.col("_from").alias("start"), (F.col("_to") - F.col("_from")).alias("length")), [*keys, mask])


def paint(candidates: DataFrame, confidence: float, min_pixels: int, span: int = SPAN) -> DataFrame:
    """Columns seq, frame_id, mask_id, start, length: the label image of overlapping scored masks, as runs.

    candidates: seq, frame_id, cand, score, start, length. As ``lifting.paint``: candidates of too little
    confidence or too few pixels go, the others are painted by rising score and numbered from 1 in that order.
    """
    one = ["seq", "frame_id", "cand"]
    sure = candidates.where(F.col("score") >= confidence)
    large = sizes(merged(sure, one), one).where(F.col("n") >= min_pixels)
    score = sure.groupBy(*one).agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("seq", "frame_id").orderBy("score", "cand"))
    numbered = score.join(large, one, "left_semi").select(*one, nth.alias("mask_id"))
    return painted(sure.select(*one, "start", "length").join(numbered, one), ["seq", "frame_id"], "mask_id", span)
