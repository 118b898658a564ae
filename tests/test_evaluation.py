import random

import numpy as np
import pytest

from tessera.functions import vectors
from tessera.operators import evaluation, groundtruth, lifting, openvoc, postprocess, spatial
from tessera.plans.config import OVERLAPS, Params
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def truth(preds, gts, overlap, least):
    """Greedy matching over sets of points of one class: (hits with scores, false positives with scores, missed)."""
    ratio = lambda p, g: len(p & g) / len(p | g)
    used, hits, extra, missed = set(), [], [], 0
    for g in gts:
        if len(g) < least:
            continue
        best = None
        for i, (p, s) in enumerate(preds):
            if p & g and i not in used and ratio(p, g) > overlap:
                if best is None:
                    best = s
                    used.add(i)
                else:
                    extra.append(min(best, s))
                    best = max(best, s)
        if best is None:
            missed += 1
        else:
            hits.append(best)
    for p, s in preds:
        if any(p & g and ratio(p, g) > overlap for g in gts):
            continue
        ignored = len(p - set().union(*gts)) + sum(len(p & g) for g in gts if len(g) < least)
        if ignored / len(p) <= overlap:
            extra.append(s)
    return hits, extra, missed


def ap_of(hits, extra, missed):
    score = np.array(hits + extra)
    hit = np.array([1.0] * len(hits) + [0.0] * len(extra))
    points = []
    for t in np.unique(score):
        tp = hit[score >= t].sum()
        points.append((tp / (score >= t).sum(), tp / (len(hits) + missed)))
    points.append((1.0, 0.0))
    r = [points[0][1], *(x for _, x in points), 0.0]
    return sum(p * (r[k] - r[k + 2]) / 2 for k, (p, _) in enumerate(points))


@pytest.mark.parametrize("seed", range(2))
def test_matches_and_ap_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    gts = [set(range(20 * k, 20 * k + rng.randrange(4, 20))) for k in range(12)]
    preds = []
    for _ in range(25):
        g = rng.choice(gts)
        p = {x for x in g if rng.random() < 0.7} | {rng.randrange(240) for _ in range(rng.randrange(8))}
        if len(p) >= 6:
            preds.append((p, rng.choice([0.3, 0.6, 1.0])))
    gt = spark.createDataFrame([("s", x, next((1001 + k for k, g in enumerate(gts) if x in g), 0)) for x in range(260)], "seq string, point_id long, gt_id int")
    pred = spark.createDataFrame([("s", i, x) for i, (p, _) in enumerate(preds) for x in sorted(p)], "seq string, inst int, point_id long")
    meta = spark.createDataFrame([("s", i, 1, s) for i, (_, s) in enumerate(preds)], "seq string, inst int, class_id int, score double")
    classes = spark.createDataFrame([(0, "one", 1), (1, "none", 2)], "idx int, label string, label_id int")
    ps, gs = evaluation.predictions(pred, meta, gt, classes, 6), groundtruth.instances(gt, classes)
    shared = evaluation.intersections(pred, ps, gt, gs)
    rows = evaluation.matches(ps, gs, shared, 6).collect()
    aps = {(r.label_id, r.overlap): r.ap for r in evaluation.ap_table(evaluation.matches(ps, gs, shared, 6), ps, gs, classes, 6).collect()}
    for o in OVERLAPS:
        hits, extra, missed = truth(preds, gts, o, 6)
        mine = [r for r in rows if r.overlap == o]
        assert sorted(r.score for r in mine if r.hit == 1) == sorted(hits)
        assert sorted(r.score for r in mine if r.hit == 0) == sorted(extra)
        assert sum(r.missed for r in mine) == missed
        assert np.isclose(aps[1, o], ap_of(hits, extra, missed) if hits or extra else 0.0)
        assert np.isnan(aps[2, o])
        if o >= 0.5:
            c = evaluation.counts_unambiguous(ps, gs, shared, o, 6).first()
            assert (c.tp, c.fp, c.fn) == (len(hits), len(extra), missed)


def test_constant_score(spark):
    found = spark.createDataFrame([(1, 0.5, 1, 1.0, 0)] * 8 + [(1, 0.5, 0, 1.0, 0)] * 9 + [(1, 0.5, None, None, 2)], "label_id int, overlap double, hit int, score double, missed int")
    ap = evaluation.average_precision(evaluation.pr_curve(found)).first().ap
    assert ap == pytest.approx(0.8 * (8 / 17 + 1) / 2)


def test_class_agnostic_counts_unlabelled_points_as_an_instance(spark):
    gt = spark.createDataFrame([("s", i, 0 if i < 200 else 2005) for i in range(400)], "seq string, point_id long, gt_id int")
    classes = spark.createDataFrame([(0, "a", 1), (1, "b", 2)], "idx int, label string, label_id int")
    pred = spark.createDataFrame([("s", 0, i) for i in range(200, 400)], "seq string, inst int, point_id long")
    meta = spark.createDataFrame([("s", 0, 0, 1.0)], "seq string, inst int, class_id int, score double")
    rows = {r["class"]: r for r in evaluation.evaluate(pred, meta, gt, classes, class_agnostic=True).collect()}
    assert rows["a"].ap50 == pytest.approx(0.5 * (1 + 1) / 2)
    with pytest.raises(PySparkException):
        evaluation.require_pairs(pred, gt.withColumn("seq", F.lit("t"))).collect()


def test_labels(spark):
    objects = spark.createDataFrame([("s", 0, [(1, 1), (1, 2)]), ("s", 1, [])], "seq string, object_id int, repre_mask_list array<struct<frame_id:int,mask_id:int>>")
    crops = spark.createDataFrame([("s", 1, m, v) for m in (1, 2) for v in ([3.0, 0.0], [0.0, 2.0], [0.0, 1.0])], "seq string, frame_id int, mask_id int, v array<double>")
    features = openvoc.mask_features(crops)
    assert features.first().v == pytest.approx([1 / 3, 2 / 3])
    labels = spark.createDataFrame([(0, "x", [1.0, 0.0]), (1, "y", [0.0, 1.0]), (2, "z", [0.0, 1.0])], "idx int, label string, v array<double>")
    vocabulary = spark.createDataFrame([("x", 7), ("y", 8), ("z", 9)], "label string, label_id int")
    assert {r.object_id: r.class_id for r in openvoc.classify(objects, features, labels, vocabulary).collect()} == {0: 8, 1: 0}
    with pytest.raises(PySparkException):
        openvoc.classify(objects, features.where("mask_id = 1"), labels, vocabulary).collect()
    big = spark.createDataFrame([("a", 20.0), ("a", 19.99)], "k string, similarity double")
    total = vectors.softmax(big, ["k"], "similarity").agg(F.sum("probability")).first()[0]
    assert total == pytest.approx(1.0)


def plain_dbscan(xyz, eps, least):
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2) <= eps * eps
    core = d.sum(1) >= least
    label, n = np.full(len(xyz), -1), 0
    for i in range(len(xyz)):
        if core[i] and label[i] < 0:
            stack = [i]
            while stack:
                x = stack.pop()
                if label[x] < 0:
                    label[x] = n
                    if core[x]:
                        stack += np.flatnonzero(d[x]).tolist()
            n += 1
    return label, core


def test_density_clusters(spark):
    rng = np.random.default_rng(1)
    xyz = np.vstack([rng.normal(c, 0.05, (40, 3)) for c in (0, 0.4, 1)] + [rng.uniform(-1, 2, (30, 3))])
    label, core = plain_dbscan(xyz, 0.1, 4)
    assert (spatial.dbscan_rows(xyz, 0.1, 4) == label).all()
    points = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(xyz)], "seq string, point_id long, x double, y double, z double")
    joined = {r.point_id: r.component for r in spatial.dbscan_joined(points, 0.1, 4, ["seq"]).collect()}
    heads = {}
    for i in np.flatnonzero(core).tolist():
        heads.setdefault(label[i], i)
    assert all(joined[i] == (None if label[i] < 0 else heads[label[i]]) for i in range(len(xyz)) if core[i] or label[i] < 0)
    assert spatial.dbscan(points.limit(0), 0.1, 4, ["seq"]).count() == 0


def test_room_of_boxes_is_lifted(spark):
    """Two flat squares before a camera: their pixels find the scene points of the same squares."""
    scene, pixels = [], []
    for k, (x0, mask) in enumerate(((-0.6, 1), (0.2, 2))):
        for i in range(20):
            for j in range(20):
                scene.append(("s", k * 400 + i * 20 + j, x0 + 0.02 * i, 0.02 * j, 2.0))
                pixels.append(("s", 0, int(250 + 5 * j), int(320 + (x0 + 0.02 * i) * 250), 2.0, mask))
    pose = [float(i % 5 == 0) for i in range(16)]
    cameras = spark.createDataFrame([("s", 0, (500.0, 500.0, 320.0, 250.0), pose), ("s", 1, (1.0, 1.0, 0.0, 0.0), [float("inf")] * 16)], "seq string, frame_id int, intr struct<fx:double,fy:double,cx:double,cy:double>, pose array<double>")
    px = spark.createDataFrame(pixels + [("s", 0, 0, 0, 0.0, 1), ("s", 0, 0, 1, 2.0, 0), ("s", 1, 0, 0, 1.0, 1)], "seq string, frame_id int, v int, u int, depth float, mask_id int")
    points = spark.createDataFrame(scene, "seq string, point_id long, x double, y double, z double")
    found: dict = {}
    for r in lifting.lift(px.dropDuplicates(["frame_id", "v", "u"]), cameras, points, Params()).collect():
        found.setdefault((r.frame_id, r.mask_id), set()).add(r.point_id)
    assert set(found) == {(0, 1), (0, 2)}
    assert all(x < 400 for x in found[0, 1]) and all(x >= 400 for x in found[0, 2])
    assert min(map(len, found.values())) > 300


def test_paint(spark):
    rows = [("s", 0, 0, 0.9, 0, 0), ("s", 0, 0, 0.9, 0, 1), ("s", 0, 1, 0.6, 0, 1), ("s", 0, 1, 0.6, 0, 2), ("s", 0, 2, 0.4, 0, 3), ("s", 0, 3, 0.7, 0, 4)]
    df = spark.createDataFrame(rows, "seq string, frame_id int, cand int, score double, v int, u int")
    got = {r.u: r.mask_id for r in lifting.paint(df, Params(min_pixels=2)).collect()}
    assert got == {0: 2, 1: 2, 2: 1}


@pytest.mark.parametrize("shape", ["plane", "cloud", "few", "same", "far"])
def test_nearest_mean_equals_all_pairs(shape):
    rng = np.random.default_rng(3)
    xyz = {"plane": rng.random((900, 3)) * [4, 3, 0.01], "cloud": rng.normal(size=(500, 3)), "few": rng.random((7, 3)), "same": np.ones((30, 3)), "far": np.concatenate([rng.random((200, 3)) * 0.01, rng.random((5, 3)) * 50])}[shape]
    k = min(20, len(xyz))
    d = np.sort(np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2)), axis=1)[:, :k].mean(axis=1)
    assert np.allclose(spatial.nearest_mean(xyz, k), d)


def test_large_nodes_are_split_alike(spark):
    rng = np.random.default_rng(5)
    scene, points = [], []
    for seq in ("s", "t"):
        for i, c in enumerate(np.concatenate([rng.random((60, 3)) * 0.4 + [3 * k, 0, 0] for k in range(3)] + [rng.random((9, 3)) * 9 + 20])):
            scene.append((seq, i, *map(float, c)))
            points += [(seq, node, i) for node in (1, 2) if node == 1 or i % 3]
    scene = spark.createDataFrame(scene, "seq string, point_id long, x double, y double, z double")
    points = spark.createDataFrame(points, "seq string, node int, point_id long")
    rows = lambda most: sorted(map(tuple, postprocess.split(points, scene, Params(split_eps=0.15), most=most).collect()))
    found = rows(10**6)
    assert found == rows(1) == rows(150) and len({r[2] for r in found}) > 3


@pytest.mark.parametrize("shape", ["even", "clustered", "flat", "equal", "few"])
def test_nearest_means_by_joins(spark, shape):
    rng = np.random.default_rng(7)
    n = {"few": 6, "equal": 30}.get(shape, 700)
    xyz = rng.random((n, 3))
    if shape == "clustered":
        xyz[: n // 2] = 0.5 + rng.random((n // 2, 3)) * 1e-3
        xyz[-1] = 40.0
    elif shape == "flat":
        xyz[:, 2] = 0
    elif shape == "equal":
        xyz[:] = 1
    k = min(20, n)
    d = np.sort(np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2)), axis=1)[:, :k].mean(1)
    rows = [(s, i, *p) for s in ("s", "t") for i, p in enumerate(xyz.tolist())]
    found = spatial.nearest_means(spark.createDataFrame(rows, "seq string, point_id long, x double, y double, z double"), 20, ["seq"]).collect()
    assert len(found) == 2 * n and all(abs(r.mean - d[r.point_id]) < 1e-9 for r in found)


def test_denoise_of_large_groups(spark):
    """A group beyond the limit goes by joins, the other by its task; both as if each were alone."""
    rng = np.random.default_rng(8)
    ball = np.concatenate([rng.normal(0, 0.05, (250, 3)), rng.normal(3, 0.05, (90, 3)), rng.random((40, 3)) * 9])
    rows = [(s, i, *p) for s, n in (("large", 380), ("small", 200)) for i, p in enumerate(ball[:n].tolist())]
    frame = spark.createDataFrame(rows, "seq string, point_id long, x double, y double, z double")
    plain = {(r.seq, r.point_id) for r in spatial.denoise(frame, ["seq"], 0.1).collect()}
    assert plain == {(r.seq, r.point_id) for r in spatial.denoise(frame, ["seq"], 0.1, most=300).collect()} and 0 < len(plain) < len(rows)
    assert spatial.denoise(frame.limit(0), ["seq"], most=0).count() == 0


def test_labels_beyond_a_broadcast(spark):
    """Objects meet a large vocabulary block by block, with the same products."""
    objects = spark.createDataFrame([("s", i, [float(i), 1.0]) for i in range(4)], "seq string, object_id int, v array<double>")
    labels = spark.createDataFrame([(k, f"l{k}", [1.0, float(k)]) for k in range(7)], "idx int, label string, v array<double>")
    got = lambda **k: sorted(tuple(r) for r in openvoc.similarity(objects, labels, ["seq", "object_id"], **k).collect())
    assert got(most=2) == got() == sorted(("s", i, k, f"l{k}", i + float(k)) for i in range(4) for k in range(7))


@pytest.mark.parametrize("closed", [False, True])
def test_radius_join_of_crowded_cells(spark, closed):
    """Cells of many points, equal points and points on the edges of cells, cut into boxes and parts: the same pairs."""
    rng = np.random.default_rng(9)
    xyz = np.concatenate([rng.random((120, 3)) * 0.3, rng.random((60, 3)) * 3, np.full((40, 3), 0.25), np.round(rng.random((60, 3)) * 8) / 8])
    rows = [("s", i, *p) for i, p in enumerate(xyz.tolist())]
    frame = spark.createDataFrame(rows, "seq string, id long, x double, y double, z double")
    d2 = ((xyz[:, None] - xyz[None]) ** 2)
    d2 = d2[..., 0] + d2[..., 1] + d2[..., 2]
    want = set(zip(*np.nonzero(d2 <= 0.25**2 if closed else d2 < 0.25**2)))
    for dense in (10_000, 15, 1):
        got = spatial.epsilon_join(frame, frame, 0.25, closed=closed, dense=dense).select("l_id", "r_id").collect()
        assert len(got) == len(want) and {(r.l_id, r.r_id) for r in got} == want


def test_radius_join_of_blocks(spark, monkeypatch):
    """Crowded cells of several groups, with ids of any type, odd coordinates and small blocks; only the wanted columns are made."""
    for name, n in (("LEFT", 40), ("RIGHT", 7), ("ROWS", 5)):
        monkeypatch.setattr(spatial, name, n)
    rng = np.random.default_rng(4)
    xyz = np.concatenate([rng.normal(size=(150, 3)) * 0.1, np.full((20, 3), 0.5)])
    rows = [("ab"[i % 2], i % 3, i, *p) for i, p in enumerate(xyz.tolist())] + [("a", 0, 900, float("nan"), 0.0, 0.0), ("a", 0, 901, None, 0.0, 0.0)]
    right = spark.createDataFrame(rows, "seq string, k int, id long, x double, y double, z double")
    left = right.selectExpr("seq", "k", "struct(id, cast(id as string) as name) as id", "x", "y", "z")
    d2 = ((xyz[:, None] - xyz[None]) ** 2)
    d2 = d2[..., 0] + d2[..., 1] + d2[..., 2]
    same = lambda i, j: i % 2 == j % 2 and i % 3 == j % 3
    want = {(i, j): d2[i, j] for i, j in zip(*map(np.ndarray.tolist, np.nonzero(d2 < 0.15**2))) if same(i, j)}
    whole = spatial.epsilon_join(left, right, 0.15, ["seq", "k"], dense=3).collect()
    assert {(r.l_id.id, r.r_id): r.d2 for r in whole} == want and len(whole) == len(want)
    assert all((r.seq, r.k, r.l_id.name) == ("ab"[r.r_id % 2], r.r_id % 3, str(r.l_id.id)) for r in whole)
    pairs = spatial.epsilon_join(left, right, 0.15, ["seq", "k"], dense=3, columns=["r_id", "l_id"])
    assert pairs.columns == ["r_id", "l_id"] and sorted((r.l_id.id, r.r_id) for r in pairs.collect()) == sorted(want)


def test_masks_look_for_first_neighbours_by_ranges_of_the_scene(spark, monkeypatch):
    """A mask's points do not meet all of a crowded scene at once; the incidences are those of the first of all pairs."""
    monkeypatch.setattr(spatial, "FIRST", 2)
    rng = np.random.default_rng(6)
    xyz = rng.normal(size=(120, 3)) * 0.1
    scene = spark.createDataFrame([("s", i, *p) for i, p in enumerate(xyz.tolist())], "seq string, point_id long, x double, y double, z double")
    points = scene.selectExpr("seq", "point_id % 2 as frame_id", "point_id % 3 as mask_id", "point_id", "x", "y", "z")
    d2 = ((xyz[:, None] - xyz[None]) ** 2)
    d2 = d2[..., 0] + d2[..., 1] + d2[..., 2]
    want = {(i % 2, i % 3, int(j)) for i in range(120) for j in np.flatnonzero(d2[i] < 0.1**2)[:4]}
    looked, join = [], spatial.epsilon_join
    monkeypatch.setattr(spatial, "epsilon_join", lambda a, b, *rest, **more: looked.append(b.count()) or join(a, b, *rest, **more))
    found = lifting.near_points(points, scene, Params(distance=0.1, neighbours=4, coverage=0.0)).collect()
    assert {(r.frame_id, r.mask_id, r.point_id) for r in found} == want and len(found) == len(want)
    assert looked and looked[0] < 120 and sum(looked) == 120


def test_radius_join_works_blocks_out_in_place(spark, monkeypatch):
    """128 x 1,024 points that are all near: a block's pairs take little more than its distances and the rows that leave."""
    import tracemalloc

    import pyarrow as pa

    same = spark.range(1).selectExpr("'s' as seq", "id", "0.0D as x", "0.0D as y", "0.0D as z")
    cell = same.selectExpr("seq", "id as l_id", "x as l_x", "y as l_y", "z as l_z", "0L as _cx", "0L as _cy", "0L as _cz", "0L as _g", "1 as _parts")
    taken, kind = [], type(same)
    monkeypatch.setattr(kind, "mapInArrow", lambda self, f, schema: taken.append((self.columns, f)) or self)
    spatial._crowded_pairs(cell, cell.selectExpr(*(f"{c} as {c.replace('l_', 'r_')}" for c in cell.columns)), 0.15, ["seq"], False, ["l_id", "r_id"])
    columns, run = taken[0]
    n, m = 128, 1024
    data = {"_g": np.zeros(n + m, np.int64), "_p": np.zeros(n + m, np.int32), "_box": np.repeat(np.array([-1, 0], np.int32), [n, m]), "seq": pa.repeat("s", n + m)}
    data |= {"l_id": np.arange(n + m), "r_id": np.arange(n + m)} | {c: np.zeros(n + m) for c in "xyz"}
    batch = pa.RecordBatch.from_arrays([pa.array(data[c]) for c in columns], names=columns)
    tracemalloc.start()
    found = [(b.num_rows, tracemalloc.get_traced_memory()[1]) for b in run(iter([batch]))]
    tracemalloc.stop()
    assert [k for k, _ in found] == [n * m]
    assert found[0][1] < 6 * 8 * n * m


def test_radius_join_with_a_cell_of_all_points(spark):
    """100,000 points in eight cells, cut into boxes and parts."""
    cloud = spark.range(100_000).selectExpr("'s' as seq", "id", "rand(1) * 0.99 as x", "rand(2) * 0.99 as y", "rand(3) * 0.99 as z")
    few = cloud.where("id < 20")
    plan = spatial.epsilon_join(few, cloud, 1.0, dense=500)
    found = plan.count()
    plain = few.alias("a").crossJoin(cloud.alias("b")).where("(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 1").count()
    assert found == plain


def test_density_clusters_of_crowded_space_hold_no_list_of_pairs():
    """Points of one ball and copies of a point: neighbours are not listed, in a task of 100 MB."""
    import tracemalloc

    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.random((5_000, 3)) * 0.05, np.full((5_000, 3), 0.3)])
    tracemalloc.start()
    label = spatial.dbscan_rows(xyz, 0.1, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (label == np.repeat([0, 1], 5_000)).all() and peak < 100e6


@pytest.mark.parametrize("kind", ["spread", "grid", "copies", "odd"])
def test_density_clusters_by_joins_and_in_a_task_are_the_same(spark, kind):
    """Crowded cells beside others, places exactly a radius apart, copies, and points without a place; the joins also halve boxes."""
    rng = np.random.default_rng(7)
    xyz = rng.random((700, 3)) * 0.9 - 0.4
    if kind == "grid":
        xyz = np.round(xyz, 1)
    if kind == "copies":
        xyz = np.concatenate([np.repeat(xyz[:4], 150, 0), np.repeat(xyz[:4] + [0.1, 0, 0], 90, 0), rng.random((400, 3)) * 0.02 + 3, rng.random((400, 3)) * 0.02 + [3.1, 3, 3]])
    if kind == "odd":
        xyz[:9, 0] = [np.nan, np.inf, -np.inf] * 3
    label, core = plain_dbscan(xyz, 0.1, 4)
    points = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(xyz)], "seq string, point_id long, x double, y double, z double")
    assert (spatial.dbscan_rows(xyz, 0.1, 4) == label).all()
    want = [(i, int(n) + 1) for i, n in enumerate(label)]
    for most in (10_000, 10):
        assert sorted((r.point_id, r.component) for r in spatial.dbscan(points, 0.1, 4, ["seq"], most).collect()) == want


def test_points_that_look_for_nearest_ones_are_dealt_by_their_number(spark, monkeypatch):
    """A few bytes of points meet many: tasks hold a number of points, whatever Spark makes of their bytes."""
    monkeypatch.setattr(spatial, "LOOKING", 20)
    dealt, xyz = [], np.random.default_rng(2).random((200, 3))
    points = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(xyz)], "seq string, point_id long, x double, y double, z double")
    deal = type(points).repartition
    monkeypatch.setattr(type(points), "repartition", lambda self, n, *by: dealt.append(n) or deal(self, n, *by))
    found = {r.point_id: r.mean for r in spatial.nearest_means(points, 5, ["seq"]).collect()}
    want = np.sort(np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(2)), axis=1)[:, :5].mean(1)
    assert [found[i] for i in range(200)] == pytest.approx(want.tolist()) and dealt[0] == 11


def test_first_within_by_ranges_of_ids(spark, monkeypatch):
    """The first of all pairs, in a crowded group, a loose one and one without neighbours, over several ranges."""
    monkeypatch.setattr(spatial, "FIRST", 2)
    rng = np.random.default_rng(9)
    rows = [(s, int(i), *(float(x) for x in rng.normal(size=3) * wide)) for s, wide in (("a", 0.05), ("b", 0.4)) for i in rng.permutation(200)[:150]] + [("c", 7, 0.0, 0.0, 0.0)]
    p = spark.createDataFrame(rows, "seq string, id long, x double, y double, z double")
    plain = {tuple(r) for r in spatial.first_neighbours(spatial.epsilon_join(p, p, 0.15), 4).select("seq", "l_id", "r_id").collect()}
    looked, join = [], spatial.epsilon_join
    monkeypatch.setattr(spatial, "epsilon_join", lambda a, b, *rest, **more: looked.append((a.count(), b.count())) or join(a, b, *rest, **more))
    found = spatial.first_within(p, p, 0.15, 4).select("seq", "l_id", "r_id").collect()
    assert len(found) == len(plain) and {tuple(r) for r in found} == plain
    assert len(looked) == 3 and looked[0][1] < looked[1][1] < looked[2][1] and looked[2][0] < looked[0][0]
