import json

import pytest

from tessera.__main__ import arguments, main


def test_cluster_then_evaluate(spark, tmp_path, capsys):
    rows = [(s, f, m, 200 * m + x) for s in "ab" for f in range(4) for m in (1, 2) for x in range(150)]
    spark.createDataFrame(rows, "seq string, frame_id int, mask_id int, point_id long").write.parquet(f"{tmp_path}/inc")
    points = [(s, p, 0.02 * (p % 200) + 50.0 * (p // 200), 0.0, 0.0) for s in "ab" for p in range(600)]
    spark.createDataFrame(points, "seq string, point_id long, x double, y double, z double").write.parquet(f"{tmp_path}/scene")
    (tmp_path / "c.json").write_text(json.dumps({"dataset": "demo", "step": 1, "point_filter_threshold": 0.4}))
    main(["cluster", "--incidence", f"{tmp_path}/inc", "--scene", f"{tmp_path}/scene", "--output", f"{tmp_path}/out", "--config", f"{tmp_path}/c.json", "--seq_name", "a+b"])
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.seq, r.object_id, len(r.point_ids)) for r in found.collect()) == [("a", 0, 150), ("a", 1, 150), ("b", 0, 150), ("b", 1, 150)]

    from tessera.sources.sinks import predictions

    pred, meta = predictions(found)
    pred.write.parquet(f"{tmp_path}/pred/points")
    meta.write.parquet(f"{tmp_path}/pred/meta")
    gt = [(s, p, 1000 + p // 200 if p % 200 < 150 and p >= 200 else 0) for s in "ab" for p in range(600)]
    spark.createDataFrame(gt, "seq string, point_id long, gt_id int").write.parquet(f"{tmp_path}/gt")
    spark.createDataFrame([(0, "thing", 1)], "idx int, label string, label_id int").write.parquet(f"{tmp_path}/labels")
    main(["evaluate", "--pred_path", f"{tmp_path}/pred", "--gt_path", f"{tmp_path}/gt", "--vocabulary", f"{tmp_path}/labels", "--output_file", f"{tmp_path}/ap", "--no_class"])
    out = capsys.readouterr().out.split("\n")
    assert out[0].split() == ["what", "AP", "AP_50%", "AP_25%"] and out[1].split()[0] == "thing"
    # two objects and, without classes, the unlabelled points of each scene as a third instance that is missed
    assert float(out[1].split()[2]) == pytest.approx(2 / 3, abs=1e-3)


def test_whole_run(spark, tmp_path, capsys):
    """Objects, their classes from features, and their scores in one command; labelling alone gives the same predictions."""
    rows = [("a", f, m, 200 * m + x) for f in range(4) for m in (1, 2) for x in range(150)]
    spark.createDataFrame(rows, "seq string, frame_id int, mask_id int, point_id long").write.parquet(f"{tmp_path}/inc")
    points = [("a", p, 0.02 * (p % 200) + 50.0 * (p // 200), 0.0, 0.0) for p in range(600)]
    spark.createDataFrame(points, "seq string, point_id long, x double, y double, z double").write.parquet(f"{tmp_path}/scene")
    features = [("a", f, m, [1.0, 0.1] if m == 1 else [0.1, 1.0]) for f in range(4) for m in (1, 2)]
    spark.createDataFrame(features, "seq string, frame_id int, mask_id int, v array<double>").write.parquet(f"{tmp_path}/features")
    spark.createDataFrame([(0, "chair", [1.0, 0.0]), (1, "table", [0.0, 1.0])], "idx int, label string, v array<double>").write.parquet(f"{tmp_path}/labels")
    spark.createDataFrame([(0, "chair", 3), (1, "table", 8)], "idx int, label string, label_id int").write.parquet(f"{tmp_path}/vocabulary")
    gt = [("a", p, {1: 3001, 2: 8001}.get(p // 200, 0) if p % 200 < 150 else 0) for p in range(600)]
    spark.createDataFrame(gt, "seq string, point_id long, gt_id int").write.parquet(f"{tmp_path}/gt")
    main(["run", *(x for n in ("scene", "features", "labels", "vocabulary") for x in (f"--{n}", f"{tmp_path}/{n}")), "--incidence", f"{tmp_path}/inc", "--gt_path", f"{tmp_path}/gt", "--output", f"{tmp_path}/out"])
    out = capsys.readouterr().out.split("\n")
    assert [line.split() for line in out[1:4]] == [[n, "1.000", "1.000", "1.000"] for n in ("chair", "table", "average")]
    meta = lambda at: sorted(map(tuple, spark.read.parquet(f"{at}/meta").select("seq", "inst", "class_id").collect()))
    assert meta(f"{tmp_path}/out/predictions") == [("a", 0, 3), ("a", 1, 8)]
    main(["label", "--objects", f"{tmp_path}/out/objects", *(x for n in ("features", "labels", "vocabulary") for x in (f"--{n}", f"{tmp_path}/{n}")), "--pred_path", f"{tmp_path}/again"])
    assert meta(f"{tmp_path}/again") == meta(f"{tmp_path}/out/predictions")


def test_truth_and_streams(spark, tmp_path):
    for seq, k in (("s1", 0), ("s2", 1)):
        (tmp_path / seq).mkdir()
        (tmp_path / seq / "x.segs.json").write_text(json.dumps({"segIndices": [4, 5, 6 + k]}))
        (tmp_path / seq / "x.agg.json").write_text(json.dumps({"segGroups": [{"id": 0, "label": "chair", "segments": [4]}, {"id": 1, "label": "odd", "segments": [5 + k]}]}))
    (tmp_path / "map.tsv").write_text("nr\tname\n3\tchair\n9\todd\n")
    spark.createDataFrame([(0, "chair", 3)], "idx int, label string, label_id int").write.parquet(f"{tmp_path}/vocabulary")
    main(["truth", "--segments", f"{tmp_path}/s*/*.segs.json", "--groups", f"{tmp_path}/s*/*.agg.json", "--label_map", f"{tmp_path}/map.tsv", "--vocabulary", f"{tmp_path}/vocabulary", "--output", f"{tmp_path}/gt", "--raw", "name", "--id", "nr"])
    read = lambda seq: next((tmp_path / f"gt/seq={seq}").glob("*.txt")).read_text().split()
    assert read("s1") == ["3002", "3", "1"] and read("s2") == ["3002", "1", "1"]

    from tests.test_datasets import stream

    stream(tmp_path / "z.sens", [(b"jpg%d" % i, [i, 7]) for i in range(5)])
    main(["streams", "--sens", f"{tmp_path}/*.sens", "--output", f"{tmp_path}/out", "--skip", "2"])
    assert sorted(f.name for f in (tmp_path / "out/z/color").glob("*.jpg")) == ["0.jpg", "2.jpg", "4.jpg"] and (tmp_path / "out/z/color/4.jpg").read_bytes() == b"jpg4"


def test_unknown_preset():
    with pytest.raises(NotImplementedError):
        main(["cluster", "--incidence", "x", "--scene", "x", "--output", "x", "--preset", "other"])
    assert arguments(["evaluate", "--pred_path", "p", "--gt_path", "g", "--vocabulary", "v", "--output_file", "o"]).no_class is False
