import hashlib
import random
import re
from collections import defaultdict

import pytest

from tessera.llm.lines import line_bitmaps, line_dedup, op10_line_dedup

TRIM = "\x20\t\n\x0b\x0c\r"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(TRIM))


def plain(rows):
    holders = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                holders[key_of(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key_of(x)) < 20 or len(holders[key_of(x)]) < 3 or i == max(holders[key_of(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    pool = [f"A common line that is number {k} " + "é" * (k % 3) for k in range(12)] + ["short", "", "  \t", "x" * 19, "y" * 20, "Ä" * 20, "ä" * 20]
    out = [(0, None), (1, ""), (2, "\n\n")]
    for i in range(3, 60):
        some = [rng.choice(["", " ", "\t"]) + rng.choice(pool) + rng.choice(["", "\r", "\x0b"]) for _ in range(rng.randrange(0, 200))]
        out.append((i, "\n".join(x.upper() if rng.random() < 0.3 else x for x in some)))
    return out + [out[5], (7, "another text of the same id\n" + pool[0]), (None, pool[0] + "\n" + pool[1])]


def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(i, t, 5, "z") for i, t in rows], "doc_id long, text string, n_lines int, h1 string")
    got = line_dedup(docs)
    assert got.columns == ["doc_id", "text", "h1", "n_lines", "n_dropped", "kept"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()), key=repr) == plain(rows)


def test_bitmaps_are_sparse_and_need_no_python(spark, rows):
    docs = spark.createDataFrame([(i, "u\n" * 1000 + "a line that three documents hold") for i in (1, 2, 3)], "doc_id long, text string")
    found = line_bitmaps(docs)
    assert sorted((r.doc_id, [tuple(x) for x in r.dropped]) for r in found.collect()) == [(1, [(15, 1 << 40)]), (2, [(15, 1 << 40)])]
    plan = line_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_and_query(spark, tmp_path, rows):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    keep = [r for r in rows if r[0] is not None]
    spark.createDataFrame(keep, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in op10_line_dedup(spark, str(tmp_path)).collect())
    assert got == sorted((i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in plain(keep))


def test_a_very_long_text(spark):
    """100,000 lines, of which every thousandth is found in two other documents."""
    common = "a line that many documents hold, number {}"
    long = "\n".join(common.format(i) if i % 1000 == 999 else f"own line of the document {i}" for i in range(100_000))
    rows = [(1, long)] + [(i, "\n".join(common.format(k) for k in range(999, 100_000, 1000))) for i in (2, 3)]
    found = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1].n_lines, found[1].n_dropped, found[2].n_dropped, found[3].n_dropped) == (100_000, 100, 100, 0)
    assert found[1].kept == "\n".join(x for x in long.split("\n") if x.startswith("own"))
