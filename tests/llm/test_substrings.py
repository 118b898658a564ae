import random
import re

import pytest

from tessera.llm.substrings import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, window):
    """rows in document order; equal rows are one document."""
    seen, out = {}, []
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for d, (i, t) in enumerate(order):
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - window + 1):
            if tuple(w[s : s + window]) in seen:
                gone.update(range(s, s + window))
            else:
                seen[tuple(w[s : s + window])] = d
        out += [(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] * rows.count((i, t))
    return sorted(out, key=repr)


def corpus(rng, window):
    vocab = [f"w{i}" for i in range(400)] + ["ä", "é"]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [text(rng.randrange(window - 2, 4 * window)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "same " * 90), (5, "a b " * 50), (6, "same " * (window - 1)), (7, " ".join(text(window)))]
    for i in range(10, 90):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 5)
            parts += [p[a : len(p) - rng.randrange(0, 5)], text(rng.randrange(0, 15))]
        rows.append((i, rng.choice([" ", "\n", "\x0b "]).join(x for p in parts for x in p)))
    return rows + [(1000 + i, t) for i, t in rows[::4]]


@pytest.mark.parametrize("window,anchor", [(20, 8), (6, 3), (5, 5)])
def test_equals_brute_force(spark, window, anchor):
    rows = corpus(random.Random(window), window)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, doc int, first int")
    got = sorted((tuple(r) for r in remove_repeats(docs, window, anchor).collect()), key=repr)
    assert got == plain(rows, window)


def test_repeated_rows_and_null_ids(spark):
    a, b = " ".join(f"x{i}" for i in range(30)), " ".join(f"x{i}" for i in range(5, 40))
    rows = [(None, a), (5, b), (5, b), (6, b)]
    got = sorted((tuple(r) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == plain(rows, 20)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_very_long_text(spark):
    """200,000 words, of which a passage at the end stands in a short document before, and one within the text again."""
    rng = random.Random(8)
    own, passage = [f"u{i}" for i in range(200_000)], [f"p{rng.randrange(10**6)}" for _ in range(60)]
    long = own + passage + own[500:560]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(long))], "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_words, got[2].n_removed) == (0, 200_120, 120) and got[2].kept == " ".join(own)
