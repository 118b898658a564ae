import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.packing import cut, encoder, op3_packing, pack, sum_of_squares


TOKENIZER, ENCODER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), encoder()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.sampled_from(["<|endoftext|>", "<|end", "oftext|>", " ", "\n"]))).map("".join))
def test_ids_are_those_of_the_tokenizer(text):
    assert ENCODER(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_ids_of_long_and_odd_texts():
    assert ENCODER("end <|endoftext|> next") == [437, 220, 50256, 1306]
    for text in ("a" * 5000, "<|endoftext|><|endoftext|>", "<|<|endoftext|>|>", " " * 5000, "<|endoftext|> x", "\n\n\t   été 漢字 🙂" * 300, "123456789" * 200):
        assert ENCODER(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_cut():
    assert cut(1, 4) == [(0, 1)] and cut(4, 4) == [(0, 4)] and cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


def plain_sum_of_squares(lengths, capacity):
    """Tries every open sequence and adds up the squares anew each time."""
    gaps, out = [], []

    def total(gs):
        counts = defaultdict(int)
        for g in gs:
            counts[g] += g > 0
        return sum(c * c for c in counts.values())

    for n in lengths:
        fits = [(total([*gaps[:i], g - n, *gaps[i + 1 :]]), g) for i, g in enumerate(gaps) if g >= n]
        best = min(fits)[1] if fits else None
        out.append(best)
        if best is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(best)] -= n
    return out


def test_rule_equals_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        lengths = np.array(sorted((rng.randrange(1, 21) for _ in range(40)), reverse=True))
        seq, off = sum_of_squares(lengths, 20)
        gaps = [None if o == 0 else 20 - o for o in off.tolist()]
        assert gaps == plain_sum_of_squares(lengths.tolist(), 20)


def check(rows, texts, capacity):
    ids = {}
    for i, t in texts:
        ids[i] = np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    for i, found in by_doc.items():
        found.sort(key=lambda r: r.piece)
        assert [(r.start, r.length) for r in found] == cut(len(ids[i]), capacity)
    assert set(by_doc) == set(ids)
    for places in by_seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= capacity
    return len(by_seq)


def test_round_trip(spark, tmp_path):
    rng = random.Random(4)
    texts = [(1, None), (2, ""), (3, "x"), (4, "ab " * 4000)] + [(i, "word " * rng.randrange(900)) for i in range(10, 300)]
    spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, length int").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op3_packing(spark, str(tmp_path)).collect()
    n = check(rows, texts, 1024)
    assert n <= 1.02 * sum(r.length for r in rows) / 1024 + 1
    shared = pack(spark.read.parquet(f"{tmp_path}/documents.parquet"), share=100).collect()
    check(shared, texts, 1024)


def test_repeated_rows_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = pack(docs).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 3), (False, 3), (True, 2)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3
    assert pack(docs.limit(0)).count() == 0


def test_equal_rows_spread_over_packers(spark):
    docs = spark.createDataFrame([(None, "")] * 100, "doc_id long, text string")
    rows = pack(docs, capacity=4, share=10).collect()
    packers = Counter(r.sequence_id >> 40 for r in rows)
    assert len(rows) == 100 and len(packers) >= 8 and max(packers.values()) <= 25
    assert len({(r.sequence_id, r.offset) for r in rows}) == 100
