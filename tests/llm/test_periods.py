import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.periods import lag_counts, numbered, op13_periodic_runs, periodic_runs, runs_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_runs(w):
    """Every stretch, its smallest period by trial, then what no neighbour extends."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            stretch = w[i : i + length]
            if length >= max(6, 4 * q) and not any(all(x == y for x, y in zip(stretch, stretch[d:])) for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def changed(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def digest(doc_id, text):
    w = changed(doc_id, text)
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([None, 0, 3, 10**6]))
def test_runs_of_few_words(ids, heavy):
    assert runs_of(np.array(ids, np.int64), heavy=heavy) == plain_runs(ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=6), st.integers(1, 9)), max_size=8))
def test_runs_within_and_beside_runs(blocks):
    ids = [x for block, times in blocks for x in block * times]
    assert runs_of(np.array(ids, np.int64)) == plain_runs(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 1), min_size=1, max_size=4), st.integers(1, 6)), min_size=1, max_size=3), st.integers(4, 9))
def test_runs_of_blocks_that_hold_runs(inner, times):
    ids = [x for block, n in inner for x in block * n] * times
    assert runs_of(np.array(ids, np.int64)) == plain_runs(ids)


@pytest.mark.parametrize("heavy", [None, 0, 5, 10**6])
def test_lag_counts_are_exact(heavy):
    ids = np.array(random.Random(2).choices(range(40), [1 / (i + 1) for i in range(40)], k=3000))
    got = lag_counts(ids, 750, heavy)
    assert got.tolist() == [0] + [int((ids[p:] == ids[:-p]).sum()) for p in range(1, 751)]


def test_long_texts_end():
    """A multiple of a period is not scanned once more for each run it explains: 200,000 equal words take moments."""
    assert runs_of(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    tail = np.concatenate([np.arange(50_000), np.tile(np.arange(7), 30_000)])
    # the first words of the tail also stand at the start of the text; no other run comes of it
    assert runs_of(tail) == [(50_000, 210_000, 7)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a " * 6), (6, "a b " * 4 + "a"), (7, "É é x " * 9), (8, "x y " * 7 + "z " + "p q r " * 5 + "p s"), (None, "u v w " * 8)]
    for i in range(10, 400):
        words = [rng.choice(["the", "of", "a", "B", "b", "ü"]) if rng.random() < 0.6 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 90))]
        out.append((i, rng.choice(["\n", " ", "\t "]).join(words)))
    return out + [(10, out[9][1]), (11, "another text of an id"), (12, " ".join(map(str, range(3000))) + " k l m" * 1000)]


def test_operator(spark, rows):
    frame = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n_words int, runs string")
    got = periodic_runs(frame).collect()
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        runs = plain_runs(w) if len(w) < 3000 else [(3000, 3000, 3)]
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        want.append((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert runs_of(numbered([])) == []


def test_query(spark, tmp_path, rows):
    rows = [r for r in rows if r[0] != 12]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((digest(*r) for r in rows), key=repr)
