import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm.phrases import BREAK, collocations, cut, heavy_cells, op12_collocations, phrase_counts, plain, word_hashes

DOC = "lang string, text string"


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def plain_counts(rows):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for p in pieces(text):
            n[lang or "und"] += len(p)
            f[lang or "und"].update(" ".join(p[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(p) - k + 1))
    return f, n


def plain_collocations(rows, least, best):
    f, n = plain_counts(rows)
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if a >= least and " " in p}
        found = []
        for p, a in cand.items():
            if any(100 * b >= 80 * a and f" {p} " in f" {q} " and q.count(" ") > p.count(" ") for q, b in cand.items()):
                continue
            w = p.split(" ")
            score, _, left, right = min((2_000_000 * a // (c[" ".join(w[:k])] + c[" ".join(w[k:])]), k, c[" ".join(w[:k])], c[" ".join(w[k:])]) for k in range(1, len(w)))
            found.append((-score, -a, p.encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = ["the", "The", "of", "a", "é", "É", "x\x1cy", " ", "the of", "ÿ", "ö"] + [f"w{k}" for k in range(8)]
    out = [("en", None), (None, ""), ("en", ".,;:!?"), ("fr", " \t\r\n"), ("solo", "one two")]
    for _ in range(500):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "! ", "\x0b"]) for _ in range(rng.randrange(0, 60)))
        out.append((rng.choice(["en", "en", "fr", None, "und"]), text))
    out += [("en", "New York City is. " * 40), ("en", "a a a a a a a a " * 20), ("de", "ein Wort " * 3000 + ". " + "kein Wort\n" * 50)]
    return out + out[100:140]


@pytest.mark.parametrize("size, bits", [(1 << 22, None), (300, 16), (2000, 8)])
def test_equals_brute_force(spark, rows, size, bits):
    """Blocks of any size, and a sketch so narrow that it proposes nearly everything, give the same result."""
    frame = spark.createDataFrame([(g, t, 1, "x") for g, t in rows], f"{DOC}, n int, phrase string").repartition(5)
    got = collocations(frame, min_count=12, best=40, size=size, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 12, 40)


def test_counts_are_exact(spark, rows):
    f, n = plain_counts(rows)
    want = {(g, p): k for g, c in f.items() for p, k in c.items() if k >= 5} | {(g, ""): k for g, k in n.items() if k}
    got = phrase_counts(spark.createDataFrame(rows, DOC), min_count=5, size=700)
    assert {(r.lang, r.phrase): r.f for r in got.collect()} == want


def test_texts_are_cut_at_breaks():
    assert plain("A b.\tC\r\nd ".encode()) == b"a b \xff c \xff \xff d"
    text = plain(("one two three. " * 50 + "x " * 100 + ". end").encode())
    parts = list(cut(text, 60))
    assert (b" " + BREAK + b" ").join(parts) == text and all(len(p) <= 60 or BREAK not in p.split(b" ") for p in parts)
    assert list(cut(b"", 10)) == [b""]


def test_hashes_follow_words_alone(monkeypatch):
    monkeypatch.setattr("tessera.llm.phrases.CHUNK", 16)
    words = [random.Random(i % 7).choice(["ab", "ba", "a", "a" * 40]).encode() for i in range(50)]
    starts, ends, found = word_hashes(b" ".join(words))
    assert len(set(zip(words, found.tolist()))) == len(set(words)) == len(set(found.tolist()))
    assert [b" ".join(words)[s:e] for s, e in zip(starts, ends)] == words


def test_candidates_are_fewer_than_phrases(spark):
    """What occurs once is not handed to the automata."""
    rng = random.Random(1)
    text = " ".join(f"u{rng.randrange(10**6)}" for _ in range(20_000)) + ". " + "is of the kind. " * 40
    blocks = []
    from tessera.llm import phrases

    frame = phrases.blocks_of(spark.createDataFrame([("en", text)], DOC), 18, 6, 4).selectExpr("0L as grp", "0L as block", "explode(parts) as p").select("grp", "block", "p.*")
    for r in heavy_cells(frame, 12, 30).collect():
        blocks += phrases._numbers(r.heavy).tolist()
    assert 8 <= len(blocks) < 100


def test_empty_and_query(spark, tmp_path, rows):
    assert collocations(spark.createDataFrame([], DOC)).count() == 0
    spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(tuple(r) for r in op12_collocations(spark, str(tmp_path)).collect()) == plain_collocations(rows, 30, 2000)
