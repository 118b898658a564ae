"""python -m tessera COMMAND ..: runs over Parquet tables and files.

run       --incidence DIR --scene DIR --output DIR [--features DIR --labels DIR] [--gt_path DIR] --vocabulary DIR ..: cluster, label, evaluate
cluster   --incidence DIR --scene DIR --output DIR [--config JSON | --preset NAME] [--seq_name A+B ..]
label     --objects DIR --features DIR --labels DIR --vocabulary DIR --pred_path DIR
evaluate  --pred_path DIR --gt_path DIR --vocabulary DIR --output_file DIR [--no_class]
truth     --segments GLOB --groups GLOB --label_map TSV --vocabulary DIR --output DIR [--raw NAME] [--id NAME]
streams   --sens GLOB --output DIR [--skip N]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser("tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    needs = {
        "run": ("incidence", "scene", "output", "vocabulary"), "cluster": ("incidence", "scene", "output"), "label": ("objects", "features", "labels", "vocabulary", "pred_path"),
        "evaluate": ("pred_path", "gt_path", "vocabulary", "output_file"), "truth": ("segments", "groups", "label_map", "vocabulary", "output"), "streams": ("sens", "output"),
    }
    made = {name: sub.add_parser(name) for name in needs}
    for name, each in needs.items():
        for n in each:
            made[name].add_argument(f"--{n}", required=True)
    for name in ("run", "cluster"):
        made[name].add_argument("--config", help="JSON file whose keys override the preset")
        made[name].add_argument("--preset", default="scannet")
        made[name].add_argument("--seq_name", "--seq_name_list", dest="seqs", help="scenes, joined by +; all by default")
    for n in ("features", "labels", "gt_path"):
        made["run"].add_argument(f"--{n}")
    made["evaluate"].add_argument("--no_class", action="store_true")
    made["truth"].add_argument("--raw", default="raw_category", help="column of the label map with the names of annotations")
    made["truth"].add_argument("--id", default="id", help="its column with their numbers")
    made["streams"].add_argument("--skip", type=int, default=10)
    return parser.parse_args(argv)


def cluster(spark: SparkSession, a: argparse.Namespace, output: str) -> None:
    """Objects of the scenes, a folder of Parquet a scene."""
    from tessera.plans.config import PRESETS, scan_config
    from tessera.plans.pipelines import find_objects
    from tessera.sources import sinks

    if a.preset not in PRESETS:
        raise NotImplementedError(f"unknown preset {a.preset!r}; known: {', '.join(PRESETS)}")
    p = scan_config(spark, a.config, PRESETS[a.preset]) if a.config else PRESETS[a.preset]
    inc, scene = spark.read.parquet(a.incidence), spark.read.parquet(a.scene)
    if a.seqs:
        inc = inc.where(F.col("seq").isin(a.seqs.split("+")))
    sinks.write_scenes(find_objects(inc, scene, p), output)


def label(spark: SparkSession, objects: str, features: str | None, labels: str | None, vocabulary: str, pred_path: str) -> None:
    """Predictions of objects, with the classes of their features where there are any."""
    from tessera.plans.pipelines import label_objects
    from tessera.sources import sinks

    found = spark.read.parquet(objects)
    if features and labels:
        pred, meta = label_objects(found, *(spark.read.parquet(x) for x in (features, labels, vocabulary)))
    else:
        pred, meta = sinks.predictions(found)
    sinks.write_scenes(pred, f"{pred_path}/points")
    sinks.write_scenes(meta, f"{pred_path}/meta")


def evaluate(spark: SparkSession, pred_path: str, gt_path: str, vocabulary: str, output_file: str, no_class: bool) -> None:
    """The score table as CSV and on the screen."""
    from tessera.operators import evaluation
    from tessera.sources import sinks

    pred, meta = spark.read.parquet(f"{pred_path}/points"), spark.read.parquet(f"{pred_path}/meta")
    gt = spark.read.parquet(gt_path)
    evaluation.require_pairs(pred, gt).count()
    found = evaluation.evaluate(pred, meta, gt, spark.read.parquet(vocabulary), class_agnostic=no_class)
    sinks.write_ap_csv(found, output_file)
    print(sinks.ap_text(found))


def truth(spark: SparkSession, a: argparse.Namespace) -> None:
    """Ground truth files, a number a line, from annotations; a scene is named by the folder of its files."""
    from tessera.operators import groundtruth
    from tessera.sources import layouts, sinks

    seq = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    segs, groups = (f(spark, path).withColumn("seq", seq) for f, path in ((layouts.scan_segments, a.segments), (layouts.scan_groups, a.groups)))
    names = layouts.scan_tsv(spark, a.label_map, f"{a.raw} string, {a.id} int").withColumnsRenamed({a.raw: "raw_category", a.id: "id"})
    sinks.write_gt_text(groundtruth.from_segments(segs, groups, names, spark.read.parquet(a.vocabulary)), a.output)


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if a.command == "cluster":
        cluster(spark, a, a.output)
    elif a.command == "label":
        label(spark, a.objects, a.features, a.labels, a.vocabulary, a.pred_path)
    elif a.command == "evaluate":
        evaluate(spark, a.pred_path, a.gt_path, a.vocabulary, a.output_file, a.no_class)
    elif a.command == "truth":
        truth(spark, a)
    elif a.command == "streams":
        from tessera.sources.binary import export_sens

        export_sens(spark, a.sens, a.output, a.skip)
    else:
        cluster(spark, a, f"{a.output}/objects")
        label(spark, f"{a.output}/objects", a.features, a.labels, a.vocabulary, f"{a.output}/predictions")
        if a.gt_path:
            evaluate(spark, f"{a.output}/predictions", a.gt_path, a.vocabulary, f"{a.output}/scores", not (a.features and a.labels))


if __name__ == "__main__":
    main()
