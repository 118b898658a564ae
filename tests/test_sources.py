import io
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.functions import geometry
from tessera.operators import groundtruth
from tessera.sources import adapters, binary, frames, images, layouts, sinks


def png(rows: np.ndarray, filters: list[int]) -> bytes:
    """A PNG of 8 or 16 bit grey rows, each with a given filter."""
    h, w = rows.shape
    depth = 8 * rows.dtype.itemsize
    raw = rows.astype(f">u{rows.dtype.itemsize}").view(np.uint8).reshape(h, -1).astype(int)
    step, out = depth // 8, b""
    for y in range(h):
        up = raw[y - 1] if y else np.zeros_like(raw[0])
        left, corner = np.roll(raw[y], step), np.roll(up, step)
        left[:step] = corner[:step] = 0
        p = left + up - corner
        pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
        guess = [0 * up, left, up, (left + up) // 2, paeth][filters[y % len(filters)]]
        out += bytes([filters[y % len(filters)]]) + ((raw[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_png(kind):
    image = np.random.default_rng(0).integers(0, np.iinfo(kind).max, (11, 7)).astype(kind)
    assert (images.decode_png(png(image, [0, 1, 2, 3, 4])) == image).all()
    assert (images.decode_png(images.encode_png(image)) == image).all()
    colour = np.random.default_rng(1).integers(0, 255, (5, 4, 3)).astype(np.uint8)
    assert (images.decode_png(images.encode_png(colour)) == colour).all()
    with pytest.raises(ValueError):
        images.decode_png(b"no image")
    assert images.nearest(np.arange(12).reshape(3, 4), 6, 2).tolist() == [[0, 2], [0, 2], [4, 6], [4, 6], [8, 10], [8, 10]]


def test_depth_and_segmentation_files(spark, tmp_path):
    depth = np.array([[0, 1000, 2500]], np.uint16)
    (tmp_path / "4.png").write_bytes(images.encode_png(depth))
    got = {(r.v, r.u): r.depth for r in images.scan_depth(spark, f"{tmp_path}/*.png").collect()}
    assert got == {(0, 0): 0.0, (0, 1): 1.0, (0, 2): 2.5}
    label = spark.createDataFrame([("s", 0, 0, 1, 300), ("s", 0, 1, 0, 2)], "seq string, frame_id int, v int, u int, mask_id int")
    out = images.masks_as_png(label, 2, 2).first()
    assert images.decode_png(out.content).tolist() == [[0, 300], [2, 0]]


def test_ply(spark, tmp_path):
    head = "ply\nformat {} 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nproperty int category_id\nend_header\n"
    (tmp_path / "a.ply").write_text(head.format("ascii") + "0 1 2\n3 4 5\n2 0 1 7\n")
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian").encode() + struct.pack("<6f", 0, 1, 2, 3, 4, 5) + struct.pack("<B3i", 2, 0, 1, 7))
    for name in "ab":
        path = f"{tmp_path}/{name}.ply"
        assert [(r.point_id, r.x, r.y, r.z) for r in binary.scan_ply_points(spark, path).collect()] == [(0, 0.0, 1.0, 2.0), (1, 3.0, 4.0, 5.0)]
        assert [(r.face_pos, r.verts, r.category_id) for r in binary.scan_ply_faces(spark, path).collect()] == [(0, [0, 1], 7)]


def sens(frames_, depth_codec=1, colour=2):
    out = struct.pack("<IQ", 4, 4) + b"cam0" + struct.pack("<64f", *range(64)) + struct.pack("<2i4If", colour, depth_codec, 8, 6, 2, 1, 1000.0) + struct.pack("<Q", len(frames_))
    for pose, rgb, depth in frames_:
        packed = zlib.compress(np.array(depth, "<u2").tobytes())
        out += struct.pack("<16f", *pose) + struct.pack("<4Q", 11, 12, len(rgb), len(packed)) + rgb + packed
    return out


def test_sens(spark, tmp_path):
    data = [([float(i)] * 16, b"jpg%d" % i, [i, 2 * i]) for i in range(5)]
    (tmp_path / "x.sens").write_bytes(sens(data))
    rows = binary.scan_sens(spark, f"{tmp_path}/x.sens", skip=2).orderBy("idx").collect()
    assert [(r.idx, r.color, r.ts_color, r.pose[0]) for r in rows] == [(0, b"jpg0", 11, 0.0), (2, b"jpg2", 11, 2.0), (4, b"jpg4", 11, 4.0)]
    assert images.decode_png(rows[2].depth).tolist() == [[4, 8]]
    header = binary.scan_sens_header(spark, f"{tmp_path}/x.sens").first()
    assert (header.sensor, header.depth_width, header.extrinsic_depth[15], header.depth_codec) == ("cam0", 2, 63.0, "zlib_ushort")
    with pytest.raises(ValueError):
        binary.decode_depth(b"", "occi_ushort", 1, 1)
    with pytest.raises(ValueError):
        binary.sens_header(io.BytesIO(struct.pack("<IQ", 3, 0)))


def test_predictions_round_trip(spark, tmp_path):
    pred = spark.createDataFrame([("a", 0, 1), ("a", 0, 3), ("a", 1, 0)], "seq string, inst int, point_id long")
    meta = spark.createDataFrame([("a", 0, 5, 1.0), ("a", 1, 6, 0.5)], "seq string, inst int, class_id int, score double")
    scene = spark.createDataFrame([(s, i) for s in "ab" for i in range(4)], "seq string, point_id long")
    for r in binary.prediction_archive(pred, meta, scene).collect():
        (tmp_path / f"{r.seq}.npz").write_bytes(r.content)
    (tmp_path / "semantic_instance_evaluation.npz").write_bytes(b"")
    assert np.load(io.BytesIO((tmp_path / "b.npz").read_bytes()))["pred_masks"].shape == (4, 0)
    p, m = binary.scan_predictions(spark, f"{tmp_path}/*.npz")
    assert sorted(map(tuple, p.collect())) == sorted(map(tuple, pred.collect()))
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, meta.collect()))


def test_predictions_in_parts(spark, tmp_path):
    """A scene whose masks take several archives, one of them without points, beside one that takes one."""
    pred = spark.createDataFrame([("a", 0, 1), ("a", 0, 9), ("a", 1, 2), ("b", 0, 0)], "seq string, inst int, point_id long")
    meta = spark.createDataFrame([("a", 0, 5, 1.0), ("a", 1, 6, 0.5), ("b", 0, 7, 0.25)], "seq string, inst int, class_id int, score double")
    scene = spark.createDataFrame([("a", i) for i in range(11)] + [("b", 0)], "seq string, point_id long")
    for r in binary.prediction_archive(pred, meta, scene, cells=6).collect():
        (tmp_path / r.name).write_bytes(r.content)
    assert sorted(f.name for f in tmp_path.iterdir()) == ["a.npz", "a.part1.npz", "a.part2.npz", "a.part3.npz", "b.npz"]
    assert [np.load(tmp_path / n)["pred_masks"].shape for n in ("a.part1.npz", "a.part3.npz")] == [(3, 2), (2, 2)]
    p, m = binary.scan_predictions(spark, f"{tmp_path}/*.npz")
    assert sorted(map(tuple, p.collect())) == sorted(map(tuple, pred.collect()))
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, meta.collect()))


def test_text_layouts(spark, tmp_path):
    (tmp_path / "split.txt").write_text("scene1 \nscene2\n\n")
    assert [r.seq for r in layouts.scan_split(spark, f"{tmp_path}/split.txt").orderBy("n").collect()] == ["scene1", "scene2"]
    (tmp_path / "intr.txt").write_text("500 0 320 0\n0 510 240 0\n0 0 1 0\n0 0 0 1\n")
    intr = layouts.scan_intrinsics(spark, f"{tmp_path}/intr.txt", 640, 480).first().intr
    assert tuple(intr) == (500.0, 510.0, 320.0, 240.0, 640, 480)
    pose = " ".join(str(i) for i in range(16))
    (tmp_path / "x.conf").write_text("dataset m\nintrinsics_matrix 1 0 3  0 5 6  0 0 1\n" + "".join(f"scan d{i}.png c{i}.jpg {pose}\n" for i in range(2)) + "intrinsics_matrix 9 0 3 0 5 6 0 0 1\n" + f"scan d2.png c2.jpg {pose}\n")
    rows = layouts.scan_conf(spark, f"{tmp_path}/x.conf", views=2).orderBy("idx").collect()
    assert [(r.idx, r.depth, r.rgb, r.intr.fx, r.intr.cy) for r in rows] == [(0, "d0.png", "c0.jpg", 1.0, 6.0), (1, "d1.png", "c1.jpg", 1.0, 6.0), (2, "d2.png", "c2.jpg", 9.0, 6.0)]
    assert rows[0].pose == [0, -1, -2, 3, 4, -5, -6, 7, 8, -9, -10, 11, 12, 13, 14, 15]
    (tmp_path / "gt.txt").write_text("1001\n0\n2002\n")
    assert [(r.point_id, r.gt_id) for r in layouts.scan_gt(spark, f"{tmp_path}/gt.txt").orderBy("point_id").collect()] == [(0, 1001), (1, 0), (2, 2002)]


def test_colmap(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# comment\n1 OPENCV 640 480 500 510 320 240 0 0 0 0\n")
    (tmp_path / "images.txt").write_text("# c\n# d\n3 1 0 0 0 1 2 3 1 frame_000010.jpg\n1 2 -1 4 5 7\n9 0.5 0.5 0.5 0.5 1 2 3 1 frame_000020.jpg\n\n")
    cameras = layouts.scan_colmap_cameras(spark, f"{tmp_path}/cameras.txt")
    found = layouts.scan_colmap_images(spark, f"{tmp_path}/images.txt").orderBy("pos")
    rows = found.collect()
    assert [(r.image_id, r.name, r.xys, r.point3d_ids) for r in rows] == [(3, "frame_000010.jpg", [[1.0, 2.0], [4.0, 5.0]], [-1, 7]), (9, "frame_000020.jpg", None, None)]
    poses = {r.frame_id: r for r in layouts.colmap_poses(found, cameras).collect()}
    assert poses[10].pose == [1, 0, 0, -1, 0, 1, 0, -2, 0, 0, 1, -3, 0, 0, 0, 1] and poses[10].intr.fy == 510
    w = np.linalg.inv(np.array(poses[20].pose).reshape(4, 4))
    assert np.allclose(w[:3, 3], [1, 2, 3]) and np.allclose(w[:3, :3] @ w[:3, :3].T, np.eye(3))
    (tmp_path / "bad.txt").write_text("1 ODD 1 1 1\n")
    with pytest.raises(PySparkException):
        layouts.scan_colmap_cameras(spark, f"{tmp_path}/bad.txt").collect()


def test_frames(spark):
    found = spark.createDataFrame([("s", 0), ("s", 25)], "seq string, frame_id int")
    assert [(r.frame_idx, r.frame_id) for r in frames.strided(found, 10).collect()] == [(0, 0), (1, 10), (2, 20)]
    placed = spark.createDataFrame([("s", 9, 0), ("s", 4, 1), ("s", 7, 2)], "seq string, frame_id int, pos int")
    assert [(r.frame_idx, r.frame_id) for r in frames.every(placed, 2).collect()] == [(0, 9), (1, 7)]
    paths = frames.frame_paths(frames.every(placed, 2), "scannetpp", "/d").orderBy("frame_idx").first()
    assert paths.rgb_path == "/d/s/iphone/rgb/frame_000009.jpg" and paths.seg_path == "/d/s/output/mask/frame_000009.png"
    with pytest.raises(NotImplementedError):
        frames.layout("other")


def test_ground_truth_layouts(spark, tmp_path):
    (tmp_path / "segs.json").write_text(json.dumps({"segIndices": [4, 4, 5, 6]}))
    (tmp_path / "agg.json").write_text(json.dumps({"segGroups": [{"id": 0, "label": "chair", "segments": [4]}, {"id": 1, "label": "odd", "segments": [4, 5]}, {"id": 2, "label": "chair", "segments": [5]}]}))
    (tmp_path / "map.tsv").write_text("id\traw_category\tx\n3\tchair\t\n4\tchair\t\n9\todd\t\n")
    segs, groups = (f(spark, f"{tmp_path}/{n}.json").withColumn("seq", F.lit("s")) for f, n in ((layouts.scan_segments, "segs"), (layouts.scan_groups, "agg")))
    label_map = layouts.scan_tsv(spark, f"{tmp_path}/map.tsv", "id int, raw_category string")
    valid = layouts.vocabulary(spark, "d", ["chair"], [3])
    got = {r.point_id: r.gt_id for r in groundtruth.from_segments(segs, groups, label_map, valid).collect()}
    assert got == {0: 3, 1: 3, 2: 3004, 3: 1}  # the last group wins; its label is not valid; no group
    faces = spark.createDataFrame([("s", 0, [0, 1], 0, 4), ("s", 1, [1, 2], 1, 5)], "seq string, face_pos int, verts array<int>, category_id int, segment int")
    categories = spark.createDataFrame([(0, 3), (1, 8)], "row int, nyuId int")
    got = {r.point_id: r.gt_id for r in groundtruth.from_faces(faces, groups, categories, valid).collect()}
    assert got == {0: 3002, 1: 3, 2: 3}
    with pytest.raises(PySparkException):
        groundtruth.from_faces(faces, groups.where("pos = 0"), categories, valid).collect()
    with pytest.raises(ValueError):
        layouts.vocabulary(spark, "d", ["a"], [])


def test_sinks(spark, tmp_path):
    gt = spark.createDataFrame([("a", 2, 7), ("a", 0, 5), ("a", 1, 6), ("b", 0, 1)], "seq string, point_id long, gt_id int")
    sinks.write_gt_text(gt, f"{tmp_path}/gt")
    assert (next((tmp_path / "gt/seq=a").glob("*.txt"))).read_text() == "5\n6\n7\n"
    sinks.write_scenes(gt, f"{tmp_path}/p")
    sinks.write_scenes(gt.where("seq = 'b'").withColumn("gt_id", F.lit(9)), f"{tmp_path}/p")
    assert sorted(r.gt_id for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [5, 6, 7, 9]
    sinks.write_scenes(gt.limit(0), f"{tmp_path}/empty")
    objects = spark.createDataFrame([("a", 0, [1, 2])], "seq string, object_id int, point_ids array<long>")
    pred, meta = sinks.predictions(objects)
    assert pred.count() == 2 and tuple(meta.first()) == ("a", 0, 0, 1.0)
    table = spark.createDataFrame([("", None, 0.5, 0.5, 0.5), ("x", 1, 0.5, 0.5, 0.5), ("y", 2, float("nan"), 0.0, 0.0)], "class string, class_id int, ap double, ap50 double, ap25 double")
    assert [x.split()[0] for x in sinks.ap_text(table).split("\n")] == ["what", "x", "average"]
    sinks.write_ap_csv(table, f"{tmp_path}/csv")
    assert next((tmp_path / "csv").glob("*.csv")).read_text().split("\n")[0] == "class,class id,ap,ap50,ap25"


def test_poses(spark):
    df = spark.createDataFrame([([1.0] * 16,), ([float("inf")] + [0.0] * 15,), ([float("-inf")] * 16,)], "pose array<double>")
    assert df.where(geometry.valid_pose(F.col("pose"))).count() == 1


def test_adapters_skip_nulls(spark):
    df = spark.createDataFrame([(1, 2, 3), (1, 2, 3), (None, 1, 1)], "a int, b int, c int")
    assert adapters.incidence(df, "q", F.col("a"), F.col("b"), F.col("c")).count() == 1
