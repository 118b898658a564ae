import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import lifting, runs
from tessera.plans.config import Params
from tessera.sources import images


def table(spark, rows, schema="k string, start long, length long"):
    return spark.createDataFrame(rows, schema)


def places(rows):
    out = {}
    for *k, s, n in rows:
        out.setdefault(tuple(k), set()).update(range(s, s + n))
    return out


def drawn(seed, n=60, top=400, keys="ab", longest=60):
    rng = np.random.default_rng(seed)
    return [(str(rng.choice(list(keys))), int(rng.integers(top)), int(rng.integers(0, longest))) for _ in range(n)]


def test_union(spark):
    rows = drawn(1) + [("c", 5, 0), ("d", 0, 4), ("d", 4, 2), ("d", 7, 1)]
    found = [tuple(r) for r in runs.merged(table(spark, rows), ["k"]).select("k", "start", "length").collect()]
    assert places(found) == {k: v for k, v in places(rows).items() if v}
    for k in {r[0] for r in found}:
        mine = sorted(r[1:] for r in found if r[0] == k)
        assert all(a + n < b for (a, n), (b, _) in zip(mine, mine[1:]))  # a gap between any two
    assert sorted(r[1:] for r in found if r[0] == "d") == [(0, 6), (7, 1)]


def test_places_come_back(spark):
    rows = [("a", p) for p in (3, 4, 5, 9, 9, 11, 12)] + [("b", 0)]
    coded = runs.encode(table(spark, rows, "k string, p int"), ["k"], F.col("p"))
    assert sorted(tuple(r) for r in coded.select("k", "start", "length").collect()) == [("a", 3, 3), ("a", 9, 1), ("a", 11, 2), ("b", 0, 1)]
    assert {tuple(r) for r in runs.decode(coded, ["k"]).collect()} == set(rows)
    assert {tuple(r) for r in runs.decode(runs.unpacked(runs.packed(coded, ["k"]), ["k"]), ["k"]).collect()} == set(rows)
    assert {r.k: r.n for r in runs.sizes(coded, ["k"]).collect()} == {"a": 6, "b": 1}
    empty = coded.limit(0)
    assert not any(f.count() for f in (runs.merged(empty, ["k"]), runs.decode(empty, ["k"]), runs.cut(empty), runs.painted(empty, [], "k")))


@pytest.mark.parametrize("span", [16, 4096])
def test_intersections_and_iou(spark, span):
    left, right = (runs.merged(table(spark, [("s", *r) for r in drawn(i, longest=200)], "seq string, k string, start long, length long"), ["seq", "k"]) for i in (2, 3))
    left, right = left.withColumnRenamed("k", "i"), right.withColumnRenamed("k", "j")
    a, b = (places(map(tuple, x.select("seq", c, "start", "length").collect())) for x, c in ((left, "i"), (right, "j")))
    met = [tuple(r) for r in runs.intersections(left, ["i"], right, ["j"], ["seq"], span).select("seq", "i", "j", "start", "length").collect()]
    want = {(*x, y[1]): a[x] & b[y] for x in a for y in b if x[0] == y[0] and a[x] & b[y]}
    assert places(met) == want
    found = {(r.seq, r.i, r.j): (r.k, round(r.iou, 9)) for r in runs.overlaps(left, ["i"], right, ["j"], ["seq"], span).collect()}
    assert found == {k: (len(v), round(len(v) / len(a[k[0], k[1]] | b[k[0], k[2]]), 9)) for k, v in want.items()}


@pytest.mark.parametrize("span", [8, 64, 4096])
def test_painting_equals_the_pixels(spark, span):
    rng = np.random.default_rng(4)
    rows = [("s", f, c, float(rng.integers(4, 9)) / 10, int(rng.integers(300)), int(rng.integers(1, 50))) for f in range(2) for c in range(9) for _ in range(3)]
    cand = spark.createDataFrame([(s, f, c, 0.4 + c % 4 / 8, a, n) for s, f, c, _, a, n in rows], "seq string, frame_id int, cand int, score double, start long, length long")
    found = runs.paint(cand, 0.5, 40, span)
    pixels = runs.decode(runs.merged(cand, ["seq", "frame_id", "cand", "score"]), ["seq", "frame_id", "cand", "score"])
    plain = lifting.paint(pixels.selectExpr("seq", "frame_id", "cand", "score", "place div 20 as v", "place % 20 as u"), Params(confidence=0.5, min_pixels=40))
    want = {(r.seq, r.frame_id, r.v * 20 + r.u): r.mask_id for r in plain.collect()}
    got = [tuple(r) for r in runs.decode(found, ["seq", "frame_id", "mask_id"]).collect()]
    assert len(got) == len(want) and {(s, f, p): m for s, f, m, p in got} == want and want
    shown = {r.frame_id: images.decode_png(r.content) for r in images.runs_as_png(found, 20, 20).collect()}
    assert all(shown[f].ravel()[p] == m for (_, f, p), m in want.items())
    assert found.count() < len(want) / 4  # far fewer rows than pixels


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(0, 15)), max_size=12))
def test_the_largest_mask_shows(spark, rows):
    want = {}
    for m, s, n in rows:
        for p in range(s, s + n):
            want[p] = max(m, want.get(p, 0))
    frame = spark.createDataFrame([("s", *r) for r in rows], "seq string, m int, start long, length long")
    got = [(r.place, r.m) for r in runs.decode(runs.painted(frame, ["seq"], "m", 7), ["seq", "m"]).collect()]
    assert len(got) == len(want) and dict(got) == want
