import math
import random
import re
import zlib
from collections import Counter

from tessera.llm import lm
from tessera.llm.lm import SPACE, Lattice, op9_lm_score, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def base(rows):
    away = [zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, _ in rows]
    counts = Counter(t for (_, x), a in zip(rows, away) if not a for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    out = []
    for (i, x), a in zip(rows, away):
        ts = tokens(x)
        s = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        out.append((i, a, len(ts), sum(counts[t] > 0 for t in ts), n, s))
    return out, counts


def probability(word, text_pieces, byte_pieces):
    """Sum over all ways to write a word as pieces or characters spelt in bytes, on plain probabilities, from its end."""
    s = SPACE + word
    tail = [0.0] * len(s) + [1.0]
    for i in range(len(s) - 1, -1, -1):
        spelt = math.prod(byte_pieces[b] for b in s[i].encode())
        tail[i] = spelt * tail[i + 1] + sum(p * tail[i + len(k)] for k, p in text_pieces.items() if s.startswith(k, i))
    return tail[0]


def test_forward_recursion_equals_enumeration():
    plain = [SPACE, SPACE + "a", "a", "b", "ab", "ba", "aba", SPACE + "ab", "é"]
    pieces = [("<unk>", "none"), ("<s>", "none"), *((p, "text") for p in plain), *((f"<0x{b:02X}>", "byte") for b in range(256))]
    counts = {0: 50, **{i: 3 * i + 1 for i in range(2, 11)}, 11 + 0xC3: 5}
    total = sum(c for i, c in counts.items() if i > 1) + 0.1 * (9 + 256)
    share = lambda i: (counts.get(i, 0) + 0.1) / total
    texts, spelt = {p: share(2 + k) for k, p in enumerate(plain)}, [share(11 + b) for b in range(256)]
    assert math.isclose(sum(texts.values()) + sum(spelt), 1)
    lattice = Lattice(pieces, counts)
    for w in ("", "a", "ab", "abab", "baabba", "éa", "aéb", "漢", "<s>", "<unk>", "<0x41>"):
        assert math.isclose(math.exp(lattice.word(w)), probability(w, texts, spelt), rel_tol=1e-9)
    assert math.isfinite(lattice.word("ab" * 20000))


def test_a_word_is_looked_up_no_further_than_pieces_begin():
    """A vocabulary's longest piece does not set the look-ups of a word that begins nothing as long; rare and long words take the sum of logs."""

    class Counted(dict):
        asked = 0

        def get(self, *key):
            self.asked += 1
            return super().get(*key)

    pieces = [*((p, "text") for p in (SPACE, "a", "b", "ab", "x" * 40)), *((f"<0x{b:02X}>", "byte") for b in range(256))]
    lattice = Lattice(pieces, {0: 7, 1: 3, 2: 2})
    lattice.plain, lattice.log = Counted(lattice.plain), Counted(lattice.log)
    for w in ("ab" * 20, "x" * 50, "", "é" * 30, "漢" * 63, "漢" * 62 + "x"):
        assert math.isclose(lattice.word(w), lattice.long_word(SPACE + w), rel_tol=1e-12)
    lattice.plain.asked = lattice.log.asked = 0
    lattice.word("ab" * 20)
    assert lattice.plain.asked + lattice.log.asked <= 3 * 41


def test_names_of_control_and_byte_pieces_are_text_like_any_other():
    """The tokenizer never takes such a name for its piece: a text that spells it has the probability of its characters."""
    proc = lm.processor(lm.VOCABULARY)
    kinds = lm.kinds_of(proc)
    assert [k for p, k in kinds if p in ("<unk>", "<s>", "</s>")] == ["none"] * 3 and sum(k == "byte" for _, k in kinds) == 256
    plain = Lattice(kinds, {})
    assert plain.word("<s>") < plain.word("<r") and plain.word("<0x41>") < plain.word("<0x4")
    assert not {p for p, k in kinds if k != "text"} & plain.log.keys()


def test_base_equals_brute_force_for_any_bound(spark, tmp_path):
    rng = random.Random(3)
    vocab = [f"Word{i}" for i in range(80)] + ["É", "ñ\x1c", "漢字"]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "only here")] + [(i, rng.choice([" ", "\n"]).join(rng.choice(vocab) + rng.choice(["", "", str(rng.randrange(9))]) for _ in range(rng.randrange(60)))) for i in range(4, 150)]
    rows += [rows[9], (None, "word1 of no id")]
    spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, word string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want, counts = base(rows)
    results = [op9_lm_score(spark, str(tmp_path)).collect(), score(docs, lm.held_out(lm.F.col("doc_id"), 10), frequent=7).collect()]
    for found in results:
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found), key=repr)
        for g, w in zip(got, sorted(want, key=repr), strict=True):
            assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9)
    proc = lm.processor(lm.VOCABULARY)
    weights = Counter()
    for w, c in counts.items():
        if w is not None:
            for i in proc.encode(w):
                weights[i] += c
    names = [proc.id_to_piece(i) for i in range(proc.get_piece_size())]
    at_byte = {n: i for i, n in enumerate(names) if re.fullmatch("<0x[0-9A-F]{2}>", n)}
    texts = [i for i, n in enumerate(names) if n not in at_byte and n not in ("<unk>", "<s>", "</s>")]
    total = sum(weights.values()) + 0.1 * (len(texts) + 256)
    spelt = [(weights[at_byte[f"<0x{b:02X}>"]] + 0.1) / total for b in range(256)]
    seen = {x for _, text in rows for t in tokens(text)[:-1] for x in SPACE + t}
    usable = {names[i]: (weights[i] + 0.1) / total for i in texts if set(names[i]) <= seen}
    end = counts[None] / sum(counts.values())
    of_word = {t: math.log10(probability(t, usable, spelt)) + math.log10(1 - end) for _, x in rows for t in tokens(x)[:-1]}
    plain = {i: math.log10(end) + sum(of_word[t] for t in tokens(x)[:-1]) for i, x in rows}
    for found in results:
        assert [(r.doc_id, r.score) for r in found if not math.isclose(r.score, plain[r.doc_id], rel_tol=1e-9)] == []


def test_nothing_to_learn_from_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in score(docs, lm.F.lit(True)).collect()}
    assert found[1].train_tokens == 0 and found[1].n_known == 0 and math.isfinite(found[1].score)
    assert score(docs.limit(0), lm.F.lit(False)).count() == 0
