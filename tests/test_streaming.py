import numpy as np
from pyspark.sql import functions as F

from tessera.operators import containment, incidence
from tessera.streaming import points
from tessera.streaming.ingest import ingest, observed_points


def test_ingest_adds_each_incidence_once(spark, tmp_path):
    schema = "seq string, frame_id int, mask_id int, point_id long"
    src, seen = str(tmp_path / "in"), []
    for rows in ([("a", 0, 1, 1), ("a", 0, 1, 2)], [("a", 0, 1, 2), ("b", 0, 1, 9), ("a", 1, 1, 1)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        query = ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda t, s: seen.append((sorted(s), t.count())))
        query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("seq", "frame_id", "mask_id", "point_id").collect())
    assert got == [("a", 0, 1, 1), ("a", 0, 1, 2), ("a", 1, 1, 1), ("b", 0, 1, 9)]
    assert seen == [(["a"], 2), (["a", "b"], 4)]


def test_running_view(spark, tmp_path):
    schema = "ts timestamp, seq string, frame_id int, mask_id int, point_id long"
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a", 0, 1, k % 3) for k in range(6)] + [("2024-01-01 02:00:00", "a", 0, 1, 1)], schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = observed_points(stream, "ts").writeStream.outputMode("update").format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.points for r in spark.sql("select * from seen").collect()) == [1, 3]


def test_points_follow_the_batch_result_however_the_stream_is_cut(spark, tmp_path):
    """Boundary points and shared points after each of three arrivals, the last of which brings masks of early frames and rows seen before."""
    rng = np.random.default_rng(1)
    schema = "seq string, frame_id int, mask_id long, point_id string"
    rows = sorted({(str(rng.choice(["a", "b"])), int(rng.integers(4)), int(rng.integers(3)), f"p{rng.integers(25)}") for _ in range(160)})
    rng.shuffle(rows)
    cuts = [rows[100:], rows[:50], [*rows[50:100], *rows[120:]]]
    arrived = []
    for n, part in enumerate(cuts):
        part = [(s, int(f), int(m), p) for s, f, m, p in part]
        arrived += part
        spark.createDataFrame([*part, (None, 1, 1, "x")], schema).repartition(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        points.follow(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        changes = spark.read.parquet(str(tmp_path / "out"))
        inc = spark.createDataFrame(arrived, schema).distinct()
        masks = incidence.masks(inc)
        assert {tuple(r) for r in points.boundary(changes).collect()} == {(r.seq, r.point_id) for r in incidence.boundary(inc).select("seq", "point_id").collect()}
        place = {(r.seq, r.gid): (r.frame_id, r.mask_id) for r in masks.collect()}
        want = {(r.seq, *place[r.seq, r.gid], *place[r.seq, r.by_gid]): r.k for r in containment.overlaps(inc, masks).collect()}
        found = {tuple(r)[:-1]: r.k for r in points.overlaps(changes).select("seq", "frame_a", "mask_a", "frame_b", "mask_b", "k").collect()}
        assert found == want


def test_rows_that_a_repeated_batch_writes_again_change_nothing(spark, tmp_path):
    """A point of two masks in each of two frames, one that is no boundary point; the changes twice over."""
    schema = "seq string, frame_id int, mask_id long, point_id string"
    spark.createDataFrame([("a", f, m, "x") for f in (0, 1) for m in (1, 2)] + [("a", 0, 1, "y"), ("a", 1, 2, "y")], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    points.follow(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    once = spark.read.parquet(str(tmp_path / "out"))
    for changes in (once, once.unionByName(once)):
        assert [tuple(r) for r in points.boundary(changes).collect()] == [("a", "x")]
        found = points.overlaps(changes).select("frame_a", "mask_a", "frame_b", "mask_b", "k").collect()
        assert sorted(map(tuple, found)) == [(0, 1, 0, 1, 1), (0, 1, 1, 2, 1), (1, 2, 0, 1, 1), (1, 2, 1, 2, 1)]
