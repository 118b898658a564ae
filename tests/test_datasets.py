"""Data sources: ranges of files, filters that leave files unread, columns that are not wanted."""

import io
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.sources import binary, datasets, images, stores

LITTLE, BIG = "binary_little_endian", "binary_big_endian"


def stream(path, frames, color_codec=2, depth_codec=1, holes=0):
    """A sensor stream written by hand; holes: bytes of nothing as the colour of every frame but the last."""
    with open(path, "wb") as f:
        f.write(struct.pack("<IQ", 4, 4) + b"cam0" + struct.pack("<64f", *range(64)) + struct.pack("<2i4If", color_codec, depth_codec, 8, 6, 2, 1, 1000.0) + struct.pack("<Q", len(frames)))
        for i, (rgb, depth) in enumerate(frames):
            packed = zlib.compress(np.array(depth, "<u2").tobytes())
            skip = holes if i < len(frames) - 1 else 0
            f.write(struct.pack("<16f", *[float(i)] * 16) + struct.pack("<4Q", 10 + i, 20 + i, skip or len(rgb), len(packed)))
            if skip:
                f.seek(skip, os.SEEK_CUR)
            else:
                f.write(rgb)
            f.write(packed)


def test_streams_are_planned_by_frames(spark, tmp_path):
    for name, n in (("a", 9), ("b", 4), ("c", 0)):
        stream(tmp_path / f"{name}.sens", [(b"%s%d" % (name.encode(), i) * 50, [i, 7]) for i in range(n)])
    found = binary.scan_sens(spark, f"{tmp_path}/*.sens", bytes=600)
    assert found.rdd.getNumPartitions() > 4
    rows = sorted((r.path[-6], r.idx, r.color, r.pose[0], r.ts_color, r.ts_depth, images.decode_png(r.depth).tolist()) for r in found.collect())
    assert rows == [(n, i, b"%s%d" % (n.encode(), i) * 50, float(i), 10 + i, 20 + i, [[i, 7]]) for n, k in (("a", 9), ("b", 4)) for i in range(k)]
    assert sorted((r.path[-6], r.idx) for r in binary.scan_sens(spark, f"{tmp_path}/[ab].sens", skip=3).collect()) == [("a", 0), ("a", 3), ("a", 6), ("b", 0), ("b", 3)]
    assert {r.path[-6]: (r.frames, r.sensor, r.extrinsic_depth[15]) for r in binary.scan_sens_header(spark, f"{tmp_path}/*.sens").collect()} == {"a": (9, "cam0", 63.0), "b": (4, "cam0", 63.0), "c": (0, "cam0", 63.0)}


def test_a_stream_beyond_two_gigabytes(spark, tmp_path):
    """Only headers of frames and the bytes that are asked for are read; the file's middle is a hole."""
    stream(tmp_path / "x.sens", [(b"", [1, 2])] * 6 + [(b"last", [3, 4])], holes=500 << 20)
    assert (tmp_path / "x.sens").stat().st_size > 3 * 10**9
    whole = binary.scan_sens(spark, f"{tmp_path}/x.sens")
    assert whole.rdd.getNumPartitions() == 7
    last = whole.where("idx = 6")
    assert last.rdd.getNumPartitions() == 1 and [(r.color, images.decode_png(r.depth).tolist()) for r in last.collect()] == [(b"last", [[3, 4]])]
    narrow = binary.scan_sens(spark, f"{tmp_path}/x.sens", schema="idx int, ts_depth long, depth binary")
    assert [(r.idx, r.ts_depth) for r in narrow.orderBy("idx").collect()] == [(i, 20 + i) for i in range(7)]


def test_stream_errors(spark, tmp_path):
    stream(tmp_path / "raw.sens", [(b"x", [1, 2])], color_codec=0)
    with pytest.raises(PySparkException, match="unknown color codec raw"):
        binary.scan_sens(spark, f"{tmp_path}/raw.sens").collect()
    assert binary.scan_sens(spark, f"{tmp_path}/raw.sens", schema="idx int").count() == 1
    with pytest.raises(ValueError):
        binary.sens_header(io.BytesIO(struct.pack("<IQ", 3, 0)))
    assert binary.scan_sens(spark, f"{tmp_path}/none*.sens").count() == 0


def mesh(form, n, faces, extra=False, size="uchar"):
    """A mesh of n vertices and faces ([vertices], category), written by hand."""
    head = f"ply\nformat {form} 1.0\ncomment made by hand\nelement vertex {n}\nproperty float x\nproperty double y\nproperty float z\nproperty uchar red\n"
    head += f"element face {len(faces)}\nproperty list {size} int vertex_indices\nproperty int category_id\n" + ("element edge 1\nproperty int a\n" if extra else "") + "end_header\n"
    v = [(i + 0.5, i * 2.0, -float(i), i % 256) for i in range(n)]
    if form == "ascii":
        lines = [" ".join(map(str, r)) for r in v] + [" ".join(map(str, [len(x), *x, c])) for x, c in faces] + ["5"] * extra
        return (head + "\n".join(lines) + "\n").encode()
    e, k = "<>"[form == BIG], {"uchar": "B", "int": "i"}[size]
    body = b"".join(struct.pack(f"{e}fdfB", *r) for r in v) + b"".join(struct.pack(f"{e}{k}{len(x)}ii", len(x), *x, c) for x, c in faces)
    return head.encode() + body + struct.pack(f"{e}i", 5) * extra


TRIANGLES = [([i % 300, (i * 7) % 300, (i * 11) % 300], i % 40) for i in range(500)]
MIXED = [([(i * j) % 300 for j in range(2 + i % 3)], i % 40) for i in range(500)]
#: As many bytes as triangles would take.
EVEN = [([1, 2] if i % 2 else [1, 2, 3, 4], i) for i in range(500)]


@pytest.mark.parametrize("form", ["ascii", LITTLE, BIG])
@pytest.mark.parametrize("faces", [TRIANGLES, MIXED, EVEN, []])
@pytest.mark.parametrize("extra", [False, True])
def test_meshes_are_read_by_ranges(spark, tmp_path, monkeypatch, form, faces, extra):
    (tmp_path / "m.ply").write_bytes(mesh(form, 300, faces, extra, "int" if extra else "uchar"))
    monkeypatch.setattr(datasets, "READ", 700)
    points = binary.scan_ply_points(spark, f"{tmp_path}/m.ply", bytes=1000)
    assert points.rdd.getNumPartitions() >= 3
    assert sorted((r.point_id, r.x, r.y, r.z) for r in points.collect()) == [(i, i + 0.5, i * 2.0, -float(i)) for i in range(300)]
    found = binary.scan_ply_faces(spark, f"{tmp_path}/m.ply", bytes=1000)
    assert not faces or found.rdd.getNumPartitions() >= 3
    assert sorted((r.face_pos, r.verts, r.category_id) for r in found.collect()) == [(i, v, c) for i, (v, c) in enumerate(faces)]


def test_mesh_options(spark, tmp_path):
    (tmp_path / "a.ply").write_bytes(mesh(LITTLE, 3, [([0, 1, 2], 4)]))
    (tmp_path / "b.ply").write_bytes(b"no mesh")
    other = binary.scan_ply_faces(spark, f"{tmp_path}/a.ply", value="segment_id").first()
    assert (other.verts, other.segment_id) == ([0, 1, 2], None)
    with pytest.raises(PySparkException, match="not a PLY file"):
        binary.scan_ply_points(spark, f"{tmp_path}/*.ply").collect()
    # the filter on the path leaves the other file unread
    assert binary.scan_ply_points(spark, f"{tmp_path}/*.ply").where(F.col("path").endswith("a.ply")).count() == 3
    assert [r.z for r in datasets.load(spark, "tessera_ply", f"{tmp_path}/a.ply", schema="z double").collect()] == [0.0, -1.0, -2.0]


@pytest.fixture
def scenes(tmp_path):
    for seq in ("s1", "s2"):
        os.makedirs(tmp_path / seq / "depth")
        for frame in (0, 5, 20):
            (tmp_path / seq / "depth" / f"{frame}.png").write_bytes(images.encode_png(np.array([[frame, 2], [3, 4]], np.uint16)) if (seq, frame) != ("s2", 5) else b"broken")
        (tmp_path / seq / "depth" / "notes.txt").write_text("x")
    return tmp_path


def frames_of(spark, root):
    datasets.register(spark)
    return spark.read.format("tessera_frames").option("dataset", "scannet").option("root", str(root)).option("bytes", 1).load()


def test_frames_of_a_dataset_by_name(spark, scenes):
    found = frames_of(spark, scenes)
    assert found.rdd.getNumPartitions() == 6
    with pytest.raises(PySparkException, match="not a PNG"):
        found.collect()
    for wanted, n in (("seq = 's1'", 3), ("seq = 's2' and frame_id > 5", 1), ("frame_id in (0, 20)", 4), ("seq = 's1' and frame_id <= 5 and value > 2", 2)):
        few = found.where(wanted)
        assert few.rdd.getNumPartitions() == n
        assert few.count() == (4 * n if "value" not in wanted else 5)
    assert [(r.v, r.u, r.value) for r in found.where("seq = 's1' and frame_id = 20").orderBy("v", "u").collect()] == [(0, 0, 20), (0, 1, 2), (1, 0, 3), (1, 1, 4)]


def test_filters_are_decided_by_the_source(spark, scenes):
    plan = frames_of(spark, scenes).where("seq = 's1' and frame_id < 9")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and not any(line.lstrip("+-*( 0123456789:)").startswith("Filter ") for line in plan.split("\n"))


def test_columns_of_names_alone_open_no_file(spark, scenes):
    datasets.register(spark)
    read = spark.read.format("tessera_frames").option("dataset", "scannet").option("root", str(scenes))
    names = read.schema("seq string, frame_id int, bytes long").load()
    assert sorted((r.seq, r.frame_id) for r in names.collect()) == [(s, f) for s in ("s1", "s2") for f in (0, 5, 20)]


def test_unknown_names_are_errors(spark, scenes):
    datasets.register(spark)
    with pytest.raises(PySparkException, match="unknown dataset"):
        spark.read.format("tessera_frames").option("dataset", "other").option("root", str(scenes)).load()


def test_listing(tmp_path):
    for name in ("a/x.ply", "a/y.txt", "b/x.ply", "b/deep/x.ply", "_c/x.ply"):
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    at = f"file:{tmp_path}"
    assert list(stores.listed(f"{tmp_path}/*/x.ply")) == [(f"{at}/a/x.ply", 5), (f"{at}/b/x.ply", 5)]
    assert list(stores.listed(f"file://{tmp_path}/[a]/*")) == [(f"{at}/a/x.ply", 5), (f"{at}/a/y.txt", 5)]
    assert list(stores.listed(f"{tmp_path}/b")) == [(f"{at}/b/x.ply", 5)] and list(stores.listed(f"{at}/b/x.ply")) == [(f"{at}/b/x.ply", 5)]
    with pytest.raises(FileNotFoundError):
        list(stores.listed(f"{tmp_path}/none"))
