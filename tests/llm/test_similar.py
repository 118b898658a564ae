import random

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import simhash, similar
from tests.llm.test_decontaminate import shingles, words
from tests.test_components import union_find


def plain_sets(texts, size=5):
    """Sets of shingles; a text of fewer words is one, all without words are equal."""
    return [set(shingles(w, min(size, len(w)))) if (w := words(t)) else {()} for t in texts]


def plain_groups(texts, least=0.8):
    sets = plain_sets(texts)
    edges = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    up = union_find(edges)
    return [up.get(i, i) for i in range(len(texts))]


def corpus(rng):
    vocab = [f"W{i}Ä" for i in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage = say(30)
    texts = [None, "", " \t", "one", "One", "two words", "a b c d", "a b c d e"]
    for i in range(60):
        w = say(rng.randrange(5, 200)) + (passage if i % 2 else [])
        texts.append(" ".join(w))
        for _ in range(rng.randrange(4)):  # a chain of changes around the similarity
            for _ in range(rng.randrange(1, 1 + max(1, len(w) // 40))):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"], ["new", "er"]])
            texts.append("\n".join(w))
    return texts


@pytest.mark.parametrize("common, listed", [(50, 512), (3, 2)])
def test_groups_equal_brute_force(spark, monkeypatch, common, listed):
    monkeypatch.setattr(similar, "COMMON", common)
    monkeypatch.setattr(similar, "LIST", listed)
    texts = corpus(random.Random(4))
    frame = spark.createDataFrame(list(enumerate(texts)) + [(20, texts[20])], "node long, text string")
    got = {r.node: r.component for r in similar.similar_texts(frame).collect()}
    want = plain_groups(texts)
    assert [got.get(i, i) for i in range(len(texts))] == want
    by_tables = {r.node: r.component for r in simhash.similar_documents(frame).collect()}
    assert by_tables == got
    assert len(set(want)) < len(texts) - 30


def test_stage_finds_copies_beyond_two_bits(spark):
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, kept = [], []
    for i in range(20):
        w = say(120)
        v = list(w)
        v[30], v[80] = "other", "words"  # 106 of 126 shingles: 0.841
        far = list(w)
        for at in (20, 50, 80):  # 101 of 131: 0.771
            far[at] = "far"
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(v)), (10 * i + 2, " ".join(far))]
        kept += [10 * i, 10 * i + 2]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == kept


def test_stage_judges_rows_of_a_repeated_id_by_their_texts(spark):
    rows = [(1, "a b c d e f g"), (7, "a b c d e f g"), (7, "quite another text under this id"), (7, "quite another text under this id"), (None, "a b c d e f g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, frame, "").collect()), key=repr)
    assert got == sorted([rows[0], rows[2], rows[4]], key=repr)


def test_parity_maps_bound_the_difference():
    rng = random.Random(7)
    for n in (1, 5, 80, 3000):
        a = set(rng.getrandbits(62) for _ in range(n))
        b = set(rng.sample(sorted(a), n - n // 3)) | {rng.getrandbits(62) for _ in range(n // 4)}
        x, y = (similar.parity(np.array(sorted(s), np.int64)) for s in (a, b))
        assert 0 < sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(a ^ b) or a == b


def test_shingles_beside_common_ones():
    rng = random.Random(8)
    text = [rng.randrange(60) for _ in range(300)]
    for common in ([], [7], [3, 9, 59], list(range(60))):
        at = [i for i, x in enumerate(text) if x in common]
        want = {x for i, x in enumerate(text) if x not in common and any(abs(i - j) <= similar.BESIDE for j in at)}
        assert similar.beside(np.array(text, np.int64), np.array(common, np.int64)).tolist() == sorted(want)


def test_empty(spark):
    none = spark.createDataFrame([], "node long, text string")
    assert similar.similar_texts(none).count() == 0 and simhash.similar_documents(none).count() == 0
