"""Micro scenes, one per trap, and an independent dense model on random incidences."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import clustering, consensus, containment, incidence, postprocess
from tessera.plans.config import PRESETS, Params, load


def make(spark, rows, seq="s"):
    return spark.createDataFrame([(seq, *r) for r in rows], "seq string, frame_id int, mask_id int, point_id long").distinct()


def dense(rows, p):
    """(masks, valid, contained matrix, thresholds, clusters) by matrices over all masks and frames."""
    rows = set(rows)
    masks = sorted({(f, m) for f, m, _ in rows})
    frames = sorted({f for f, _ in masks})
    points = {k: {x for f, m, x in rows if (f, m) == k} for k in masks}
    bad = {x for f in frames for a, b in itertools.combinations([points[k] for k in masks if k[0] == f], 2) for x in a & b}
    n = len(masks)
    C, V, ok = np.zeros((n, n), np.float32), np.zeros((n, len(frames)), np.float32), []
    for i, k in enumerate(masks):
        mine = points[k] - bad
        visible = split = 0
        for fi, f in enumerate(frames):
            counts = [(len(mine & (points[j] - bad)), -j[1], q) for q, j in enumerate(masks) if j[0] == f]
            total = sum(c for c, _, _ in counts)
            if not total or (1 - (len(mine) - total) / len(mine) < p.mask_visible_threshold and total < p.visible_points):
                continue
            visible += 1
            top = max(counts)
            if top[0] / total > p.contained_threshold:
                V[i, fi] = C[i, top[2]] = 1
            else:
                split += 1
        ok.append(visible > 0 and not split / visible > p.undersegment_filter_threshold)
    for j, good in enumerate(ok):
        if not good:
            V[C[:, j] > 0, frames.index(masks[j][0])] = 0
            C[:, j] = 0
    counts = (V @ V.T).ravel()
    counts = counts[counts > 0]
    thresholds = []
    for q in range(95, -5, -5):
        v = np.percentile(counts, q) if len(counts) else 0
        if v <= 1 and q < 50 or not len(counts):
            break
        thresholds.append(max(v, 1))
    groups = [[i] for i in range(n) if ok[i]]
    for t in thresholds:
        vs = np.array([V[g].max(0) for g in groups], np.float32)
        cs = np.array([C[g].max(0) for g in groups], np.float32)
        o, s = vs @ vs.T, cs @ cs.T
        link = (o >= t) & (s / (o + np.float32(1e-7)) >= np.float32(p.view_consensus_threshold))
        left, merged = set(range(len(groups))), []
        while left:
            stack, part = [min(left)], set()
            while stack:
                x = stack.pop()
                if x not in part:
                    part.add(x)
                    stack += [y for y in range(len(groups)) if y != x and link[x, y]]
            left -= part
            merged.append(sorted(i for x in part for i in groups[x]))
        groups = merged
    return masks, ok, C, thresholds, sorted(map(tuple, groups))


def random_rows(rng):
    """Objects seen in frames, cut and merged at random."""
    objects = [set(range(20 * k, 20 * k + int(rng.integers(8, 20)))) for k in range(8)]
    rows = []
    for f in range(7):
        m = 1
        for o in objects:
            if rng.random() < 0.3:
                continue
            seen = [x for x in sorted(o) if rng.random() < 0.9]
            parts = [seen[: len(seen) // 2], seen[len(seen) // 2 :]] if rng.random() < 0.15 else [seen]
            if rng.random() < 0.2:
                parts[0] = parts[0] + [x for x in sorted(objects[int(rng.integers(8))])][:6]
            for part in parts:
                rows += [(f, m, x) for x in part]
                m += 1
    return rows


@pytest.mark.parametrize("seed,p", [(0, PRESETS["scannet"]), (1, PRESETS["scannetpp"]), (2, Params(view_consensus_threshold=0.5, contained_threshold=0.4, undersegment_filter_threshold=0.8))])
def test_equals_dense_model(spark, seed, p):
    rows = random_rows(np.random.default_rng(seed))
    other = random_rows(np.random.default_rng(seed + 50))
    inc = make(spark, rows).unionByName(make(spark, other, "t"))
    engines = {}
    for engine in ("grouped", "joined"):
        nodes, masks, contained, valid, visible = clustering.cluster(inc, p, engine=engine)
        engines[engine] = sorted(map(tuple, nodes.select("seq", "node", "gid").collect()))
    assert all(e == engines["grouped"] for e in engines.values())
    for seq, data in (("s", rows), ("t", other)):
        names, ok, C, thresholds, groups = dense(data, p)
        assert [(r.frame_id, r.mask_id) for r in masks.where(F.col("seq") == seq).orderBy("gid").collect()] == names
        assert [r.valid for r in valid.where(F.col("seq") == seq).orderBy("gid").collect()] == ok
        assert {(r.gid, r.by_gid) for r in contained.where(F.col("seq") == seq).collect()} == {(i, j) for i, j in zip(*np.nonzero(C))}
        found = consensus.thresholds(visible).where(F.col("seq") == seq).orderBy("round").collect()
        assert np.allclose([r.threshold for r in found], thresholds)
        got: dict = {}
        for s, node, gid in engines["grouped"]:
            if s == seq:
                got.setdefault(node, []).append(gid)
        assert sorted(tuple(sorted(g)) for g in got.values()) == groups
        assert all(node == min(g) for node, g in got.items())


def test_single_precision_edges(spark):
    pairs = spark.createDataFrame([(10, 9), (20, 18), (1, 1), (5, 5)], "o int, s int")
    at = lambda t: {(r.o, r.s) for r in pairs.where(consensus.agreement(F.col("s"), F.col("o"), t)).collect()}
    assert at(0.9) == {(10, 9), (20, 18), (1, 1), (5, 5)}
    assert at(1.0) == {(5, 5)}


def test_supporters_count_masks(spark):
    held = spark.createDataFrame([("s", 1, 7), ("s", 1, 8), ("s", 2, 7), ("s", 2, 8)], "seq string, gid int, by_gid int")
    seen = spark.createDataFrame([("s", 1, 0), ("s", 2, 0)], "seq string, gid int, frame_id int")
    s, o = consensus.supporters(held), consensus.observers(seen)
    assert (s.first().supporters, o.first().observers) == (2, 1)
    least = spark.createDataFrame([("s", 1.0)], "seq string, threshold double")
    assert consensus.links(o, s, least, 1.0).count() == 1


def test_boundary_points_are_left_out_everywhere(spark):
    rows = [(0, 1, 5), (0, 2, 5), (0, 1, 1), (1, 1, 5), (1, 1, 1)]
    inc = make(spark, rows)
    assert [r.point_id for r in incidence.boundary(inc).collect()] == [5]
    assert incidence.interior(inc).where("point_id = 5").count() == 0
    assert incidence.point_frame(inc).where("point_id = 5").count() == 2


def test_undersegmented_container_is_undone(spark):
    rows = [(0, 1, x) for x in range(20)] + [(1, 1, x) for x in range(10)] + [(1, 2, x) for x in range(10, 20)]
    inc = make(spark, rows)
    masks = incidence.masks(inc)
    contained, valid = containment.containment(inc, masks, PRESETS["scannet"])
    assert [r.valid for r in valid.orderBy("gid").collect()] == [False, True, True]
    assert not contained.where("by_gid = 0").count() and contained.where("gid = 0").count() == 0


@pytest.mark.parametrize("seen,expected", [(499, 0), (500, 1)])
def test_many_visible_points_outweigh_their_share(spark, seen, expected):
    overlap = spark.createDataFrame([("s", 0, 3, 1, seen)], "seq string, gid int, frame_id int, by_gid int, k long")
    size = spark.createDataFrame([("s", 0, 5000)], "seq string, gid int, n long")
    assert containment.visibility(overlap, size, PRESETS["scannet"]).count() == expected


def test_chain_of_overlaps(spark):
    pairs = spark.createDataFrame([("s", 0, 1, 9, 10, 20), ("s", 0, 2, 5, 10, 5)], "seq string, i int, j int, k long, n_i long, n_j long")
    assert {r.object_id for r in postprocess.overlapped(pairs).collect()} == {0, 2}
    assert {r.object_id for r in postprocess.overlapped(pairs, most=0).collect()} == {0, 2}


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_by_rounds_equal_the_loop(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(s, int(i), int(j), int(rng.integers(5, 11)), 10, int(rng.integers(5, 16))) for s in ("s", "t") for i in range(14) for j in range(i + 1, 14) if rng.random() < 0.6]
    rows += [("chain", i, i + 1, 9, 20, 10) for i in range(9)]
    want = set()
    for s in ("s", "t", "chain"):
        gone = set()
        for i in range(14):
            if i in gone:
                continue
            for t, a, j, k, n, m in rows:
                if (t, a) == (s, i) and j not in gone and (k / n > 0.8 or k / m > 0.8):
                    gone.add(i if k / n > 0.8 else j)
        want |= {(s, x) for x in gone}
    frame = spark.createDataFrame(rows, "seq string, i int, j int, k long, n_i long, n_j long")
    for most in (0, 40, 1000):
        assert {tuple(r) for r in postprocess.overlapped(frame, most=most).collect()} == want
    assert postprocess.overlapped(frame.limit(0), most=0).count() == 0


def test_objects_keep_noise_and_count_frames_of_the_node(spark):
    rows = [(f, 1, x) for f in range(3) for x in range(12)] + [(3, 1, x) for x in range(6)]
    xyz = [("s", x, 0.01 * x if x < 8 else 5.0 + x, 0.0, 0.0) for x in range(12)]
    inc = make(spark, rows)
    scene = spark.createDataFrame(xyz, "seq string, point_id long, x double, y double, z double")
    nodes, masks, _, _, visible = clustering.cluster(inc, PRESETS["scannet"])
    found = {tuple(r.point_ids): r for r in postprocess.objects(nodes, inc, masks, visible, scene, PRESETS["scannet"]).collect()}
    assert tuple(range(8)) in found
    assert all(len(r.repre_mask_list) <= 5 and r.object_id in (0, 1) for r in found.values())
    empty = postprocess.objects(nodes.limit(0), inc.limit(0), masks.limit(0), visible.limit(0), scene, PRESETS["scannet"])
    assert empty.count() == 0


def test_empty_scene(spark):
    nodes = clustering.cluster(make(spark, [(0, 1, 1), (0, 2, 1)]), PRESETS["scannet"])[0]
    assert nodes.count() == 0
    assert clustering.cluster(make(spark, [(0, 1, 1)]).limit(0), PRESETS["scannet"], engine="joined")[0].count() == 0


def test_config():
    assert load('{"step": 3, "unknown": 1, "contained_threshold": 0.7}', PRESETS["scannetpp"]) == Params(0.4, 0.2, 1.0, 0.7, 0.7, 3)


def test_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(consensus, "BLOCK", 3)
    rng = np.random.default_rng(1)
    rows = sorted({(s, int(rng.integers(20)), int(rng.integers(4))) for s in ("s", "t") for _ in range(60)})
    frame = spark.createDataFrame(rows, "seq string, gid int, frame_id int")
    for ordered in (False, True):
        plain = {}
        for (s, i, f), (t, j, g) in itertools.product(rows, rows):
            if (s, f) == (t, g) and (ordered or i < j):
                plain[s, i, j] = plain.get((s, i, j), 0) + 1
        assert {(r.seq, r.i, r.j): r.observers for r in consensus.observers(frame, ordered=ordered).collect()} == plain


def test_sets_of_hashed_points(spark):
    """Points by two hashes, rows that repeat and boundary points give the sets of plain points; the texts are dealt once."""
    rng = np.random.default_rng(5)
    rows = sorted({(int(rng.integers(4)), int(rng.integers(3)), int(rng.integers(40))) for _ in range(120)})
    inc = make(spark, rows)
    masks = incidence.masks(inc)
    hashed = incidence.with_gid(inc, containment.numbered(masks)).select("seq", "at", F.xxhash64("point_id").alias("h1"), F.xxhash64(F.lit(1), "point_id").alias("h2"))
    plain = {(r.seq, tuple(r["at"])): r.w for r in containment.mask_sets(inc, masks).collect()}
    found = containment.hashed_sets(hashed.unionByName(hashed))
    assert plain and {(r.seq, tuple(r["at"])): r.w for r in found.collect()} == plain


def test_pairs_of_observers_are_not_shuffled(spark, monkeypatch):
    """What pairs need is counted where two blocks meet: no step groups rows of pairs."""
    monkeypatch.setattr(consensus, "BLOCK", 2)
    frame = spark.createDataFrame([("s", g, f) for g in range(7) for f in (0, g % 3)], "seq string, gid int, frame_id int").distinct()
    found = consensus.observers(frame, ordered=True)
    assert found.count() == 49
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan.splitlines()[0] and "Aggregate [seq#" in plan
    assert not any("Aggregate" in line and " i#" in line for line in plan.splitlines())


@pytest.mark.parametrize("ordered", [False, True])
def test_observers_send_a_block_once_a_group(spark, monkeypatch, ordered):
    """What is dealt grows with the nodes and the groups, not with the pairs of blocks."""
    for name, n in (("BLOCK", 2), ("GROUP", 16), ("GROUPS", 2)):
        monkeypatch.setattr(consensus, name, n, raising=False)
    rows = [(s, g, f) for s in "st" for g in range(64) for f in (0, 1 + g % 3)]
    frame = spark.createDataFrame(rows, "seq string, gid int, frame_id int")
    sent, kind = [], type(frame)

    def seen(self, *rest, plain=kind.mapInArrow):
        lists = sum((F.size(c) for c, t in self.dtypes if t.startswith("array")), F.lit(0))
        sent.append(self.agg(F.sum(lists)).first()[0])
        return plain(self, *rest)

    monkeypatch.setattr(kind, "mapInArrow", seen)
    found = [(r.seq, r.i, r.j, r.observers) for r in consensus.observers(frame, ordered=ordered).collect()]
    assert sorted(found) == [(s, i, j, 1 + (i % 3 == j % 3)) for s in "st" for i in range(64) for j in range(64) if ordered or i < j]
    assert sent == [2 * 64 * (4 + 1)]


def test_edges_count_observers_of_supported_pairs_alone(spark, tmp_path, monkeypatch):
    """Links of a query over tables in which every mask is seen with every other."""
    from tessera.queries import ORACLE_SQL, consensus_edges
    from tests.oracle import connect, rows_of, sql_rows

    monkeypatch.setattr(consensus, "observers", lambda *a, **k: pytest.fail("pairs of all masks of a frame"))
    rows = [(i, f"{i % 2}", "\n".join(f"line {i // 4} {k}" for k in range(30))) for i in range(16)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows_of(consensus_edges(spark, str(tmp_path))) == sql_rows(connect(str(tmp_path)), ORACLE_SQL["consensus_edges"])


def test_observer_histogram(spark, monkeypatch):
    """Equal sets of frames, sets in blocks of two, scenes side by side, frames that are dates."""
    monkeypatch.setattr(consensus, "BLOCK", 2)
    rng = np.random.default_rng(3)
    rows = sorted({(s, int(rng.integers(25)), f"2024-01-{int(rng.integers(1, 8)):02d}") for s in ("s", "t") for _ in range(90)})
    rows += [("s", g, d) for g in (100, 101, 102) for d in ("2024-01-01", "2024-01-05")] + [("u", 1, "2024-01-01")]
    visible = spark.createDataFrame(rows, "seq string, gid int, day string").select("seq", "gid", F.to_date("day").alias("frame_id"))
    plain = {}
    for s in "stu":
        of = {}
        for t, g, d in rows:
            if t == s:
                of.setdefault(g, set()).add(d)
        for a, b in itertools.product(of.values(), of.values()):
            if a & b:
                plain[s, len(a & b)] = plain.get((s, len(a & b)), 0) + 1
    assert {(r.seq, r.o): r.w for r in consensus.observer_histogram(visible).collect()} == plain
    assert consensus.thresholds(visible.limit(0)).count() == 0


def test_pairs_of_changed_nodes(spark):
    """Pairs formed again are those of all pairs that have a changed node."""
    rng = np.random.default_rng(4)
    held = spark.createDataFrame(sorted({("s", int(rng.integers(12)), int(rng.integers(9))) for _ in range(60)}), "seq string, node int, by_gid int")
    seen = spark.createDataFrame(sorted({("s", int(rng.integers(12)), int(rng.integers(5))) for _ in range(40)}), "seq string, node int, frame_id int")
    all_ = {tuple(r) for r in consensus.agreeing(held, seen, 0.8).collect()}
    some = {tuple(r) for r in consensus.agreeing(held, seen, 0.8, spark.createDataFrame([("s", 3), ("s", 5)], "seq string, node int")).collect()}
    assert some == {r for r in all_ if {r[1], r[2]} & {3, 5}} and some < all_
    one = [np.array(c) for c in zip(*sorted(tuple(r)[1:] for r in held.collect()))]
    two = [np.array(c) for c in zip(*sorted(tuple(r)[1:] for r in seen.collect()))]
    for of in (np.arange(12), np.array([3, 5])):
        got = set(zip(*(c.tolist() for c in clustering._agreeing(one, two, 12, of, 0.8))))
        assert got == {r[1:] for r in (all_ if len(of) > 2 else some)}


def test_large_scene_in_one_task():
    """3,000 masks of 300 objects: no matrix of pairs; the memory at its height stays far below one."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(5)
    gid = np.arange(3000)
    mates = pd.DataFrame({"a": np.repeat(gid, 10), "b": (gid[:, None] // 10 * 10 + np.arange(10)).ravel().astype(str)})
    frames = pd.DataFrame({"a": np.repeat(gid, 8), "b": np.array([rng.permutation(40)[:8] for _ in gid]).ravel().astype(str)})
    pdf = pd.concat([pd.DataFrame({"kind": 0, "a": gid, "b": "", "v": None}), mates.assign(kind=1, v=None), frames.assign(kind=2, v=None), pd.DataFrame({"kind": 3, "a": [0, 1], "b": "", "v": [4.0, 1.0]})]).assign(seq="s")
    tracemalloc.start()
    out = clustering._scene(0.9, None)(pdf)
    assert tracemalloc.get_traced_memory()[1] < 3000 * 3000 * 4
    tracemalloc.stop()
    assert (out["node"].to_numpy() == gid // 10 * 10).mean() > 0.95


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_masks_meet_their_sets_without_a_row_for_each_pair(spark, rows):
    """Overlaps and visible masks of random scenes, however a mask's sets are cut into batches; pairs are formed where they are counted."""
    rng = np.random.default_rng(5)
    table = pd.DataFrame({"seq": rng.choice(["a", "b"], 600), "frame_id": rng.integers(0, 6, 600), "mask_id": rng.integers(0, 3, 600), "point_id": rng.integers(0, 90, 600)}).drop_duplicates()
    inc = spark.createDataFrame(table)
    masks = incidence.masks(inc)
    inside = table[~table.set_index(["seq", "point_id"]).index.isin(table.groupby(["seq", "point_id", "frame_id"]).size().loc[lambda n: n > 1].reset_index().set_index(["seq", "point_id"]).index)]
    inside = inside.merge(masks.toPandas(), on=["seq", "frame_id", "mask_id"])
    pairs = inside.merge(inside.rename(columns={"gid": "by_gid"})[["seq", "point_id", "by_gid", "frame_id"]], on=["seq", "point_id"], suffixes=("_own", ""))
    want = {tuple(k): n for k, n in pairs.groupby(["seq", "gid", "frame_id", "by_gid"]).size().items()}
    p = Params(mask_visible_threshold=0.4, visible_points=5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        found = containment.overlaps(inc, masks)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
        assert {(r.seq, r.gid, r.frame_id, r.by_gid): r.k for r in found.collect()} == want and len(want) > 100
        slow = containment.visibility(found, containment.sizes(inc, masks), p)
        seen = containment.visible_masks(inc, masks, p)
        assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, slow.collect())) and seen.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
