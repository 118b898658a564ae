"""Whole runs: from incidences to scored, labelled objects."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators import clustering, evaluation, openvoc, postprocess
from tessera.plans.config import Params
from tessera.plans.scratch import Scratch
from tessera.sources import sinks


def find_objects(inc: DataFrame, scene: DataFrame, p: Params = Params(), frames: DataFrame | None = None) -> DataFrame:
    """Objects of all scenes of an incidence table; scene: seq, point_id, x, y, z."""
    scratch = Scratch(inc.sparkSession, "objects")
    inc = scratch.save(inc, "incidence")
    nodes, masks, _, _, visible = clustering.cluster(inc, p, frames, scratch=scratch)
    return postprocess.objects(nodes, inc, masks, visible, scene, p, scratch)


def label_objects(objects: DataFrame, features: DataFrame, labels: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, meta) of predictions with classes from features of masks and of label texts."""
    return sinks.predictions(objects, openvoc.classify(objects, features, labels, vocabulary))


def score_objects(objects: DataFrame, gt: DataFrame, vocabulary: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """The score table, without classes where none are given."""
    pred, meta = sinks.predictions(objects, classes)
    evaluation.require_pairs(pred, gt).count()
    return evaluation.evaluate(pred, meta, gt, vocabulary, class_agnostic=classes is None)
