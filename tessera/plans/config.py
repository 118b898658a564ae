"""Parameters of the clustering, named presets, and JSON configurations that override them."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Params:
    mask_visible_threshold: float = 0.3
    undersegment_filter_threshold: float = 0.3
    view_consensus_threshold: float = 0.9
    contained_threshold: float = 0.8
    point_filter_threshold: float = 0.5
    step: int = 10
    #: A mask with so many visible points in a frame is visible there whatever its share.
    visible_points: int = 500
    coverage: float = 0.3
    distance: float = 0.03
    few_points: int = 25
    depth_trunc: float = 20.0
    neighbours: int = 20
    split_eps: float = 0.1
    split_min_points: int = 4
    overlap_ratio: float = 0.8
    min_masks: int = 2
    representatives: int = 5
    confidence: float = 0.5
    min_pixels: int = 400
    temperature: float = 100.0
    min_region: int = 100


PRESETS = {
    "scannet": Params(),
    "demo": Params(),
    "matterport3d": Params(step=1),
    "scannetpp": Params(0.4, 0.2, 1.0, 0.9, 0.7, 2),
}

#: IoU thresholds of the score: these average into AP; 0.25 is reported apart.
OVERLAPS = tuple(round(0.5 + 0.05 * i, 2) for i in range(9)) + (0.25,)


def load(source: str | dict, base: Params = Params()) -> Params:
    """Params from a JSON text or a dict; keys that are not parameters are ignored, the rest override ``base``."""
    values = json.loads(source) if isinstance(source, str) else source
    names = {f.name for f in fields(Params)}
    return replace(base, **{k: v for k, v in values.items() if k in names})


def scan_config(spark: SparkSession, path: str, base: Params = Params()) -> Params:
    """Params from one JSON file, read by Spark so that any store will do."""
    return load("\n".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect()), base)
