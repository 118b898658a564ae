import random
import re
from collections import Counter

import pytest

from tessera.llm import decontaminate
from tessera.llm.decontaminate import contaminated, op6_decontamination

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def plain(docs, items, least=0.8):
    """Every window of every document against every item."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not v or not w:
                continue
            k = min(5, len(v))
            theirs = shingles(v, k)
            for s in range(max(0, len(w) - len(v)) + 1):
                mine = shingles(w[s : s + len(v)], k)
                both = sum((theirs & mine).values())
                if (sim := both / max(1, sum(theirs.values()) + sum(mine.values()) - both)) >= least and sim > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (sim, s)
    return {(d, i, round(s, 6), at) for (d, i), (s, at) in out.items()}


@pytest.fixture(scope="module")
def data():
    rng = random.Random(8)
    vocab = [f"Wörd{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rng.randrange(8, 50)))) for i in range(25)] + [(100, "two words"), (101, ""), (102, None), (103, " ".join(["same"] * 30)), (104, "Alone")]
    docs = [(0, None), (1, ""), (2, "two\tWORDS"), (3, "words two"), (4, "same " * 33), (5, "alone " + "x " * 300 + items[3][1])]
    for d in range(10, 160):
        w = words(rng.choice(items[:25])[1])
        for _ in range(rng.choice([0, 1, 1, 2, 3])):  # words changed, left out and put in, mostly near the ends
            at = rng.choice([0, 1, 2, len(w) - 1, len(w) - 2, rng.randrange(len(w))])
            w[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"], ["new", "er"]])
        docs.append((d, rng.choice([" ", "\n", " \x0b"]).join(x.title() for x in text(rng.randrange(60)) + w + text(rng.randrange(60)))))
    return docs, items


@pytest.mark.parametrize("bits, rows, all_windows", [(1 << 24, 1_000_000, False), (64, 0, False), (1 << 24, 1_000_000, True)])
def test_equals_brute_force(spark, data, monkeypatch, bits, rows, all_windows):
    """With a fine and a full bitmap, broadcast and shuffled; and with every window fingerprinted, where the block tables alone choose."""
    monkeypatch.setattr(decontaminate, "MOST_BITS", bits)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    docs, items = data
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, start int, item_id string")
    b = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, n int")
    got = {(r.doc_id, r.item_id, round(r.similarity, 6), r.start) for r in contaminated(d, b, all_windows=all_windows).collect()}
    assert got == plain(docs, items)
    assert len(got) > 60


def test_simhash_is_the_majority_of_each_bit(spark):
    rng = random.Random(4)
    lists = [[rng.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 2, 3, 8, 31, 32, 33, 100)] + [[-1] * 5, [0] * 7]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, h array<long>")
    for longest in (100, 127, 5000):
        got = {r.i: r.fp % 2**64 for r in frame.select("i", decontaminate.simhash(decontaminate.F.col("h"), longest).alias("fp")).collect()}
        assert got == {i: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in x) > len(x)) for i, x in enumerate(lists)}


def test_block_tables_choose(spark, data, monkeypatch):
    """Without a ball around its blocks no changed window is found: candidates come from the tables."""
    docs, items = data
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BALL", -1)
    assert contaminated(d, b).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(2)
    item = " ".join(f"w{rng.randrange(99)}" for _ in range(30))
    long = " ".join(f"x{i}" for i in range(100_000))
    d = spark.createDataFrame([(1, f"{long} {item} {long}"), (2, long)], "doc_id long, text string")
    found = contaminated(d, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.similarity, r.start) for r in found] == [(1, 5, 1.0, 100_000)]


def test_repeated_null_and_empty(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "A B C D E F"), (1, "q")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "a b c d e f"), (7, "a b c d e f")], "item_id long, text string")
    found = contaminated(d, b).collect()
    assert len({r.row for r in found}) == 3 and {(r.doc_id, r.item_id) for r in found} == {(1, 7), (None, 7)}
    assert contaminated(d.limit(0), b).count() == 0
    assert contaminated(d, b.limit(0)).columns == contaminated(d, b).columns


def test_no_python_in_the_plan(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, "b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = op6_decontamination(spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [(1, 3, 1.0, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_parts_in_another_order(spark):
    rng = random.Random(9)
    say = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    docs, items = [], []
    for i, n in enumerate((100, 60, 90, 120)):
        w = say(n)
        items.append((i, " ".join(w)))
        for j, cut in enumerate((n // 2, n // 3, n // 4)):
            docs.append((10 * i + j, " ".join(say(j * 40) + w[cut:] + w[:cut] + say(50 - 25 * j))))
    w = words(items[0][1])
    docs.append((100, " ".join(w[60:] + ["new"] + w[:60])))
    docs.append((101, " ".join(say(30) + w[70:] + w[35:70] + w[:35])))
    want = plain(docs, items)
    assert {d for d, *_ in want} >= {0, 1, 2, 100}
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, round(r.similarity, 6), r.start) for r in found.collect()} == want


def test_item_tables_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    """Tables of few items are exploded 296 times: beyond the counted bound they are shuffled, however small Spark takes them to be."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 100)
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, "before " + text + " after"), (2, "quite another text")], "doc_id long, text string")
    items = spark.createDataFrame([(f"i{i}", f"{text} {i}") for i in range(30)], "item_id string, text string")
    found = contaminated(docs, items)
    assert {r.doc_id for r in found.collect()} == {1}
    joins = [x for x in found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Join" in x and " value#" in x.replace("[", " ")]
    assert joins and all("SortMergeJoin" in x for x in joins)
