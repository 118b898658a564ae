import random
import re

import pytest
import xxhash

from tessera.llm.simhash import fingerprint, links, near_duplicates, op5_simhash
from tessera.plans.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    comp = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 2:
                x, y = comp[a], comp[b]
                comp = [y if c == x else c for c in comp]
    least = {}
    for (i, _), c in zip(fps, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, f, least.get(c)) for (i, f), c in zip(fps, comp)), key=repr)


def corpus(rng):
    words = [f"w{i}Ä" if i % 7 == 0 else f"W{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One two"), (5, "a b c d"), (6, "x " * 40000)]
    for i in range(10, 120):
        w = [rng.choice(words) for _ in range(rng.randrange(1, 300))]
        rows.append((i, rng.choice(["\n", " ", "\x0b"]).join(w)))
        if i % 3 == 0:
            for j in range(3):
                v = list(w)
                v[rng.randrange(len(v))] = f"new{j}"
                rows.append((1000 * (j + 1) + i, " ".join(v)))
    return rows + [rows[20], rows[20], (None, "lonely words of no id"), (10**9, rows[20][1])]


def test_fingerprint_and_components_equal_brute_force(spark):
    rows = corpus(random.Random(3))
    assert all(fingerprint(t.encode() if t is not None else None) == plain_fingerprint(t) for _, t in rows)
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, fp int, key string")
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in near_duplicates(docs).collect()), key=repr)
    assert got == plain_components(rows)


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, tmp_path):
    rows = [(1, "A b c d"), (2, "a b C d"), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash(spark, str(tmp_path)).collect()}
    assert got == {i: (f"{plain_fingerprint(t):016x}", c) for (i, t), c in zip(rows, (1, 1, 3))}


def test_one_id_with_two_texts(spark):
    base = [f"w{i}" for i in range(300)]
    changed = (" ".join([*base[:i], "new", *base[i + 1 :]]) for i in range(300))
    of = plain_fingerprint(" ".join(base))
    near = next(t for t in changed if 1 <= (plain_fingerprint(t) ^ of).bit_count() <= 2)
    rows = [(7, " ".join(base)), (7, "and quite another one here"), (9, "and quite another one here"), (3, near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in near_duplicates(docs).collect()), key=repr)
    assert got == plain_components(rows)
    assert {c for _, _, c in got} == {3, 7}


def test_links_join_all_pairs_for_any_tables(spark):
    """Components of the links are those of all pairs, whatever the segments and whatever the size of a table entry that is paired."""
    rng = random.Random(8)
    fps = {0, 2**64 - 1, 2**63}
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(40):  # many agree in one half
            near = base
            for b in rng.sample(range(32), rng.randrange(5)):
                near ^= 1 << (b + 32 * (len(fps) % 2))
            fps.add(near)
    fps = sorted(fps)

    def components(pairs):
        of = {x: x for x in fps}

        def root(x):
            while of[x] != x:
                x = of[x]
            return x

        for x, y in pairs:
            a, b = sorted((root(x), root(y)))
            of[b] = a
        return {x: root(x) for x in fps}

    nodes = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    for radius in (0, 2, 4):
        near = [(x, y) for i, x in enumerate(fps) for y in fps[:i] if (x ^ y).bit_count() <= radius]
        for segments, bucket in ((2, 64), (2, 1), (4, 3), (8, 64)) if radius == 2 else ((2, 64), (4, 2)) if radius else ((2, 1),):
            if radius == 4 and segments == 2 and bucket == 64:
                segments = 4
            found = [(r.a % 2**64, r.b % 2**64) for r in links(nodes, radius, segments, bucket).collect()]
            assert set(found) <= {(x, y) for p in near for x, y in (p, p[::-1])}
            assert components(found) == components(near)


def test_candidates_come_from_segment_tables(spark):
    nodes = spark.createDataFrame([(1,), (3,), (1 << 40,)], "fp long")
    for segments in (2, 4, 8):
        assert sorted((r.a, r.b) for r in links(nodes, 2, segments).collect()) == [(3, 1), (1 << 40, 1)]
    with pytest.raises(ValueError):
        links(nodes, 3)


def test_no_exploded_table_is_broadcast(spark, monkeypatch):
    """Balls of few fingerprints look small to Spark, which counts no row that an explode adds, and are many times as large."""
    plans, save = {}, Scratch.save

    def seen(self, df, *rest):
        df.collect()  # the plan that adaptive execution ends with
        plans[rest[0]] = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        return save(self, df, *rest)

    monkeypatch.setattr(Scratch, "save", seen)
    nodes = spark.range(2000).selectExpr("xxhash64(id DIV 2) ^ (id % 2) AS fp")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "0")
    assert links(nodes).count() == 1000
    assert "Generate" in plans["met"] and "SortMergeJoin" in plans["met"]
    assert "Broadcast" not in plans["met"]
