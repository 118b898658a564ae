"""Average precision of predicted instances against ground truth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import groundtruth
from tessera.plans.config import OVERLAPS


def iou(shared: Column, a: Column, b: Column) -> Column:
    return shared.cast("double") / (a + b - shared)


def require_pairs(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """The scenes of pred; a scene without ground truth is an error."""
    have = gt.select("seq").distinct().withColumn("has", F.lit(True))
    met = pred.select("seq").distinct().join(have, "seq", "left")
    return met.where(F.when(F.col("has"), True).otherwise(F.raise_error(F.concat(F.lit("no ground truth of "), F.col("seq"))).cast("boolean"))).select("seq")


def predictions(pred: DataFrame, meta: DataFrame, gt: DataFrame, valid: DataFrame, min_region: int = 100) -> DataFrame:
    """Columns seq, inst, label_id, score, vert_count, void: predictions of valid classes and enough points.

    void: points whose ground truth has no valid class.
    """
    void = ~F.col("ok")
    ok = valid.select("label_id").distinct().withColumn("ok", F.lit(True))
    labelled = gt.select("seq", "point_id", groundtruth.decode(F.col("gt_id")).alias("label_id")).join(ok, "label_id", "left").select("seq", "point_id", F.coalesce("ok", F.lit(False)).alias("ok"))
    counts = pred.join(labelled, ["seq", "point_id"], "left").groupBy("seq", "inst").agg(F.count("*").alias("vert_count"), F.count_if(void).alias("void"))
    mine = meta.select("seq", "inst", F.col("class_id").alias("label_id"), "score").join(valid.select("label_id").distinct(), "label_id", "left_semi")
    return mine.join(counts, ["seq", "inst"]).where(F.col("vert_count") >= min_region).select("seq", "inst", "label_id", "score", "vert_count", "void")


def intersections(pred: DataFrame, preds: DataFrame, gt: DataFrame, gts: DataFrame) -> DataFrame:
    """Columns seq, label_id, inst, instance_id, k: points that a prediction shares with an instance of its class."""
    a = pred.join(preds.select("seq", "inst", "label_id"), ["seq", "inst"])
    b = gt.select("seq", "point_id", F.col("gt_id").alias("instance_id")).join(gts.select("seq", "instance_id", "label_id"), ["seq", "instance_id"])
    return a.join(b, ["seq", "point_id", "label_id"]).groupBy("seq", "label_id", "inst", "instance_id").agg(F.count("*").alias("k"))


def _match(min_region: int, overlaps: tuple[float, ...]):
    """One scene and class: rows of kind 0 (prediction), 1 (instance) and 2 (shared points)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seq, label = pdf["seq"].iloc[0], pdf["label_id"].iloc[0]
        preds = pdf[pdf["kind"] == 0].sort_values("inst")
        gts = pdf[pdf["kind"] == 1].sort_values("instance_id")
        size = dict(zip(gts["instance_id"], gts["n"]))
        shared = pdf[pdf["kind"] == 2].sort_values("inst")
        counted = {g for g, n in size.items() if g >= 1000 and n >= min_region}
        p_size, score = dict(zip(preds["inst"], preds["n"])), dict(zip(preds["inst"], preds["score"]))
        by_gt: dict[int, list] = {}
        by_pred: dict[int, list] = {}
        for i, g, k in zip(shared["inst"], shared["instance_id"], shared["k"]):
            by_gt.setdefault(g, []).append((i, k))
            by_pred.setdefault(i, []).append((g, k))
        ratio = lambda i, g, k: k / (size[g] + p_size[i] - k)
        rows = []
        for overlap in overlaps:
            used: set = set()
            missed = 0
            for g in gts["instance_id"]:
                if g not in counted:
                    continue
                best = None
                for i, k in by_gt.get(g, ()):
                    if i in used or ratio(i, g, k) <= overlap:
                        continue
                    if best is None:
                        best = score[i]
                        used.add(i)
                    else:  # a second match is a false positive, of the lower score
                        rows.append((overlap, 0, min(best, score[i]), 0))
                        best = max(best, score[i])
                if best is None:
                    missed += 1
                else:
                    rows.append((overlap, 1, best, 0))
            for i, void in zip(preds["inst"], preds["void"]):
                if any(ratio(i, g, k) > overlap for g, k in by_pred.get(i, ())):
                    continue
                ignored = void
                for g, k in by_pred.get(i, ()):
                    ignored += k * (g < 1000) + k * (size[g] < min_region)
                if ignored / p_size[i] <= overlap:
                    rows.append((overlap, 0, score[i], 0))
            rows.append((overlap, None, None, missed))
        out = pd.DataFrame(rows, columns=["overlap", "hit", "score", "missed"])
        out.insert(0, "seq", seq)
        out.insert(1, "label_id", label)
        return out.astype({"hit": "Int32", "score": "Float64", "missed": "int32"})

    return run


def matches(preds: DataFrame, gts: DataFrame, shared: DataFrame, min_region: int = 100, overlaps: tuple[float, ...] = OVERLAPS) -> DataFrame:
    """Columns seq, label_id, overlap, hit, score, missed: greedy matches of each scene and class.

    A row with hit 1 is a matched instance, with 0 a false positive, with null the count of instances missed.
    """
    long, double = (lambda: F.lit(None).cast("long")), (lambda: F.lit(None).cast("double"))
    rows = (
        preds.select("seq", "label_id", F.lit(0).alias("kind"), F.col("inst").cast("long").alias("inst"), long().alias("instance_id"), F.col("vert_count").alias("n"), F.col("score").cast("double").alias("score"), "void", long().alias("k"))
        .unionByName(gts.select("seq", "label_id", F.lit(1).alias("kind"), long().alias("inst"), F.col("instance_id").cast("long").alias("instance_id"), F.col("vert_count").alias("n"), double().alias("score"), long().alias("void"), long().alias("k")))
        .unionByName(shared.select("seq", "label_id", F.lit(2).alias("kind"), F.col("inst").cast("long").alias("inst"), F.col("instance_id").cast("long").alias("instance_id"), long().alias("n"), double().alias("score"), long().alias("void"), "k"))
    )
    kind = dict(preds.dtypes)["seq"]
    return rows.groupBy("seq", "label_id").applyInPandas(_match(min_region, overlaps), f"seq {kind}, label_id int, overlap double, hit int, score double, missed int")


def counts_unambiguous(preds: DataFrame, gts: DataFrame, shared: DataFrame, overlap: float, min_region: int = 100) -> DataFrame:
    """Columns label_id, tp, fp, fn at an overlap of a half or more, by joins and counts alone.

    There a prediction matches one instance at most, so the order of matching is without effect.
    """
    if overlap < 0.5:
        raise ValueError("below a half, matches depend on their order")
    p = preds.select("seq", "label_id", "inst", F.col("vert_count").alias("np"), "void")
    g = gts.select("seq", "label_id", "instance_id", F.col("vert_count").alias("ng"))
    met = shared.join(p.drop("void"), ["seq", "label_id", "inst"]).join(g, ["seq", "label_id", "instance_id"])
    met = met.withColumn("over", iou(F.col("k"), F.col("ng"), F.col("np")) > overlap).withColumn("counted", (F.col("instance_id") >= 1000) & (F.col("ng") >= min_region))
    per_gt = met.where("over and counted").groupBy("label_id", "seq", "instance_id").count().groupBy("label_id").agg(F.count("*").alias("tp"), F.sum(F.col("count") - 1).alias("extra"))
    ignored = F.when(F.col("instance_id") < 1000, F.col("k")).otherwise(0) + F.when(F.col("ng") < min_region, F.col("k")).otherwise(0)
    per_pred = met.groupBy("seq", "label_id", "inst").agg(F.max("over").alias("over"), F.sum(ignored).alias("ignored"))
    lone = p.join(per_pred, ["seq", "label_id", "inst"], "left").where(~F.coalesce("over", F.lit(False)))
    lone = lone.where((F.col("void") + F.coalesce("ignored", F.lit(0))) / F.col("np") <= overlap).groupBy("label_id").agg(F.count("*").alias("lone"))
    total = g.where((F.col("instance_id") >= 1000) & (F.col("ng") >= min_region)).groupBy("label_id").agg(F.count("*").alias("total"))
    out = total.join(per_gt, "label_id", "full").join(lone, "label_id", "full").fillna(0)
    return out.select("label_id", "tp", (F.col("extra") + F.col("lone")).alias("fp"), (F.col("total") - F.col("tp")).alias("fn"))


def pr_curve(found: DataFrame) -> DataFrame:
    """Columns label_id, overlap, nth, score, precision, recall: one point per different score, by rising score, then (1, 0)."""
    keys = ["label_id", "overlap"]
    groups = found.where("hit is not null").groupBy(*keys, "score").agg(F.count("*").alias("n"), F.sum("hit").alias("tp"))
    missed = found.groupBy(*keys).agg(F.sum("missed").alias("missed"), F.sum(F.coalesce("hit", F.lit(0))).alias("all_tp"))
    above = Window.partitionBy(*keys).orderBy(F.desc("score"))
    curve = groups.select(*keys, "score", F.sum("n").over(above).alias("n"), F.sum("tp").over(above).alias("tp")).join(missed, keys)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("score")) - 1
    points = curve.select(
        *keys, nth.alias("nth"), "score", (F.col("tp") / F.col("n")).alias("precision"), F.try_divide(F.col("tp"), F.col("all_tp") + F.col("missed")).alias("recall")
    )
    end = points.groupBy(*keys).agg((F.max("nth") + 1).alias("nth")).select(*keys, "nth", F.lit(None).cast("double").alias("score"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def average_precision(curve: DataFrame) -> DataFrame:
    """Columns label_id, overlap, ap: precision summed over half the distance of the recalls on either side."""
    w = Window.partitionBy("label_id", "overlap").orderBy("nth")
    step = (F.coalesce(F.lag("recall").over(w), F.col("recall")) - F.coalesce(F.lead("recall").over(w), F.lit(0.0))) / 2
    return curve.withColumn("_a", step * F.col("precision")).groupBy("label_id", "overlap").agg(F.sum("_a").alias("ap"))


def ap_table(found: DataFrame, preds: DataFrame, gts: DataFrame, valid: DataFrame, min_region: int = 100, overlaps: tuple[float, ...] = OVERLAPS) -> DataFrame:
    """Columns label_id, overlap, ap for every valid class: NaN without instances, 0 without predictions or matches."""
    has_gt = gts.where((F.col("instance_id") >= 1000) & (F.col("vert_count") >= min_region)).select("label_id").distinct().withColumn("has_gt", F.lit(True))
    has_pred = preds.select("label_id").distinct().withColumn("has_pred", F.lit(True))
    grid = valid.select("label_id").distinct().withColumn("overlap", F.explode(F.array(*(F.lit(float(o)) for o in overlaps))))
    met = grid.join(average_precision(pr_curve(found)), ["label_id", "overlap"], "left").join(has_gt, "label_id", "left").join(has_pred, "label_id", "left")
    value = F.when(F.col("has_gt").isNull(), F.lit(float("nan"))).when(F.col("has_pred").isNull(), F.lit(0.0)).otherwise(F.coalesce("ap", F.lit(0.0)))
    return met.select("label_id", "overlap", value.alias("ap"))


def summary(aps: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Columns class, class_id, ap, ap50, ap25 per class, and a last row of averages over the classes that have instances.

    ap: mean over all overlaps but 0.25. vocabulary: label, label_id.
    """
    at = lambda o: F.max(F.when(F.abs(F.col("overlap") - o) < 1e-9, F.col("ap")))
    per = aps.groupBy("label_id").agg(F.avg(F.when(F.abs(F.col("overlap") - 0.25) > 1e-9, F.col("ap"))).alias("ap"), at(0.5).alias("ap50"), at(0.25).alias("ap25"))
    named = vocabulary.select("label", "label_id").join(per, "label_id").select(F.col("label").alias("class"), F.col("label_id").cast("int").alias("class_id"), "ap", "ap50", "ap25")
    mean = lambda c: F.avg(F.when(~F.isnan(c), F.col(c))).alias(c)
    total = named.agg(mean("ap"), mean("ap50"), mean("ap25")).select(F.lit("").alias("class"), F.lit(None).cast("int").alias("class_id"), "ap", "ap50", "ap25")
    return named.unionByName(total)


def evaluate(pred: DataFrame, meta: DataFrame, gt: DataFrame, vocabulary: DataFrame, class_agnostic: bool = False, min_region: int = 100) -> DataFrame:
    """The summary of predictions (seq, inst, point_id; seq, inst, class_id, score) against gt (seq, point_id, gt_id).

    class_agnostic: everything is one class, the first of the vocabulary (idx, label, label_id).
    """
    if class_agnostic:
        first = vocabulary.orderBy("idx").limit(1)
        one = first.first()["label_id"]
        gt = gt.withColumn("gt_id", groundtruth.agnostic(F.col("gt_id"), one))
        meta, vocabulary = meta.withColumn("class_id", F.lit(one)), first
    preds = predictions(pred, meta, gt, vocabulary, min_region)
    gts = groundtruth.instances(gt, vocabulary)
    found = matches(preds, gts, intersections(pred, preds, gt, gts), min_region)
    return summary(ap_table(found, preds, gts, vocabulary, min_region), vocabulary)
