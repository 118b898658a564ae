from types import SimpleNamespace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.file_queries import as_text
from tessera.operators import groundtruth
from tessera.plans import scratch
from tessera.sources import binary, sinks


def test_files_are_written_copied_and_read(spark, tmp_path):
    rows = [("a/x.bin", b"one"), ("b.bin", b"")]
    files = spark.createDataFrame(rows, "name string, content binary")
    assert sinks.write_files(files, str(tmp_path / "out")) == 2
    assert (tmp_path / "out/a/x.bin").read_bytes() == b"one" and (tmp_path / "out/b.bin").read_bytes() == b""
    assert sinks.copy_files(spark, str(tmp_path / "out/a/*"), f"file://{tmp_path}/copy") == 1
    assert (tmp_path / "copy/x.bin").read_bytes() == b"one"
    assert sinks.write_files(files.limit(0), str(tmp_path / "none")) == 0


def test_unknown_layouts_are_errors(spark):
    with pytest.raises(NotImplementedError):
        binary.scan(spark, "torch", "x")


def test_streams_are_read_as_written(spark, tmp_path):
    header = {"sensor": "s", **{k: [float(i) for i in range(16)] for k in ("intrinsic_color", "extrinsic_color", "intrinsic_depth", "extrinsic_depth")}}
    header |= {"color_codec": "jpeg", "depth_codec": "raw_ushort", "color_width": 3, "color_height": 2, "depth_width": 1, "depth_height": 1, "depth_shift": 1000.0}
    frames = [{"pose": [float(i)] * 16, "ts_color": i, "ts_depth": 2 * i, "color": b"c" * i, "depth": b"\x01\x00"} for i in range(3)]
    (tmp_path / "s.sens").write_bytes(binary.encode_sens(header, frames))
    found = binary.scan_sens_header(spark, f"{tmp_path}/s.sens").drop("path", "frames").first().asDict()
    assert found == header
    rows = binary.scan_sens(spark, f"{tmp_path}/s.sens").orderBy("idx").collect()
    assert [{k: bytes(r[k]) if k == "color" else r[k] for k in ("pose", "ts_color", "ts_depth", "color")} for r in rows] == [{k: v for k, v in f.items() if k != "depth"} for f in frames]


def test_class_counts(spark):
    gt = spark.createDataFrame([("a", 0, 1001), ("a", 1, 1002), ("a", 2, 2001), ("b", 0, 0)], "seq string, point_id long, gt_id int")
    assert {tuple(r) for r in groundtruth.class_counts(gt).collect()} == {("a", 2, 3), ("b", 1, 1)}


def test_a_cluster_without_a_shared_folder_is_an_error():
    def session(master):
        conf = SimpleNamespace(get=lambda *_: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master=master, applicationId=f"app of {master}"))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            scratch.shared_dir(session(master))
    for master in ("local", "local[8]", "local[*]"):
        assert scratch.shared_dir(session(master))


def test_scratch_tables_hold_settings_and_can_be_cleared(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    made = scratch.Scratch(spark, "test", {key: "7"})
    sizes = made.save(spark.range(20).repartition(1).mapInPandas(lambda parts: (p.agg(["size"]).rename(columns={"id": "n"}) for p in parts), "n long"), "sizes")
    assert sorted(r.n for r in sizes.collect()) == [6, 7, 7] and spark.conf.get(key) == before
    few = made.save(spark.range(1000).repartition(16), "few", 1000)
    assert few.rdd.getNumPartitions() == 1 and few.count() == 1000
    scratch.clear(spark)
    assert made.root not in scratch._roots
    again = scratch.Scratch(spark, "test")
    assert again.save(spark.range(3), "more").count() == 3


def test_text_of_a_scene_is_one_file(spark):
    """A union whose sides are dealt by scene already, each in its own number of tasks; a scene's lines still meet in one file, in their order."""
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        nth = F.row_number().over(Window.partitionBy("seq").orderBy("id"))

        def side(t: str, n: int, start: int):
            rows = spark.range(0, 8 * n, 1, 3).select((F.col("id") % 8).alias("seq"), "id")
            return rows.select("seq", (nth + start).cast("long").alias("n")).select("seq", "n", F.concat(F.lit(t), F.lit(" "), "n").alias("line"))

        made = spark.read.text(as_text(spark, "one", side("v", 2, 0).unionByName(side("f", 2000, 10)))).select("value", F.input_file_name().alias("path"))
        found = made.groupBy("path").agg(F.collect_list("value").alias("lines")).collect()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert len(found) == 8 and all(r.lines == ["v 1", "v 2"] + [f"f {i}" for i in range(11, 2011)] for r in found)


def test_many_small_files_share_folders(spark, monkeypatch):
    """A file for each text, in a few folders, so that a listing does not look into a folder for each."""
    from tessera import file_queries

    monkeypatch.setattr(file_queries, "FOLDERS", 3)
    glob = file_queries.as_texts(spark, "many", spark.range(40).selectExpr("CAST(id AS string) AS seq", "CAST(id * 2 AS string) AS value"))
    found = [(r.value, r.path) for r in spark.read.text(glob, wholetext=True).select("value", F.input_file_name().alias("path")).collect()]
    assert sorted(int(v) for v, _ in found) == list(range(0, 80, 2))
    assert all(int(p.rsplit("/", 1)[1].split(".")[0]) * 2 == int(v) for v, p in found) and len({p.rsplit("/", 1)[0] for _, p in found}) == 3
