"""Collocations: phrases that occur more often together than their parts do apart.

Candidates come from a count-min sketch of one row, as wide as the corpus is long. No task holds the
whole of it: each block of texts counts the cells of its own phrases, ranges of cells are summed each
in one group, and a block gets back those of its cells whose upper bound reaches the threshold. The
phrases of a block that fall in such cells, all of whose own parts do so too, are compiled into an
Aho-Corasick automaton with a delimiter at both ends of every pattern; a scan of the block counts
their overlapping matches. These counts are summed over groups of blocks, and then over all, before the
threshold is applied, so that the sketch changes the work and never a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, raw_words, table
from tessera.plans.scratch import Scratch

#: Words of the longest phrase; least count of a phrase; percentage of a count that a longer phrase takes over.
LONGEST, MIN_COUNT, WITHIN = 4, 30, 80
#: Best phrases of a language, and what a score of one stands for.
BEST, SCALE = 2000, 1_000_000
#: Bytes of a block of texts, and of all blocks that a task fills at once; bytes that are hashed at once.
BLOCK, OPEN, CHUNK = 2 << 20, 16 << 20, 1 << 20
#: Blocks, of all languages, for each group of blocks of one language that are scanned one after another.
GROUP = 24
#: Buckets of phrases in which their counts meet, at least; as many as groups of a language where those are more.
BUCKETS = 16
#: Characters that end a piece; no phrase reaches over one.
ENDS = ".,;:!?\n\x0b\x0c\r"
#: Stands for an end in a block; no UTF-8 text holds this byte.
BREAK = b"\xff"
#: Cells of a range of the sketch, as a power of two, and the least number of ranges.
RANGE_BITS, LEAST_RANGE_BITS = 20, 6

_PLAIN = bytes.maketrans((UPPER + ENDS + "\t").encode(), (LOWER + "\n" * len(ENDS) + " ").encode())
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_BASE = 0xD1342543DE82EF95
_BYTES = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)


def plain(text: bytes | None) -> bytes:
    """Words in lower case with one space between them, and BREAK as a word where a piece ends."""
    return b" ".join(raw_words((text or b"").translate(_PLAIN).replace(b"\n", b" " + BREAK + b" ")))


def cut(text: bytes, size: int) -> Iterator[bytes]:
    """A plain text in parts of at most ``size`` bytes, cut at breaks; a longer piece stays whole."""
    gap = b" " + BREAK + b" "
    while len(text) > size:
        at = text.rfind(gap, 0, size)
        at = at if at >= 0 else text.find(gap, size)
        if at < 0:
            break
        yield text[:at]
        text = text[at + len(gap) :]
    yield text


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a block; the bytes are hashed by chunks that end with a word."""
    b = np.frombuffer(block, np.uint8)
    gaps = np.flatnonzero(b == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(b)]])
    out = np.empty(len(starts), np.uint64)
    size = min(len(b), max(CHUNK, int((ends - starts).max())))
    power, back = np.full(size + 1, _BASE, np.uint64), np.full(size + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    power[0] = back[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(back, out=back)
    i = 0
    while i < len(starts):
        s = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, s + size, "right")))
        upto = np.zeros(ends[j - 1] - s + 1, np.uint64)
        np.cumsum(_BYTES[b[s : ends[j - 1]]] * power[: len(upto) - 1], out=upto[1:])
        out[i:j] = (upto[ends[i:j] - s] - upto[starts[i:j] - s]) * back[starts[i:j] - s]
        i = j
    return starts, ends, _mixed(out)


def phrase_cells(block: bytes, lang: str, bits: int, longest: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Starts and ends of words; for phrases of 1 to ``longest`` words their cells by first word, and which exist."""
    starts, ends, words = word_hashes(block)
    real = ~((ends - starts == 1) & (np.frombuffer(block, np.uint8)[starts] == BREAK[0]))
    h, exists = _mixed(words ^ np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "replace")))), real
    cells, there = [], []
    for k in range(1, longest + 1):
        if k > 1:
            h, exists = _mixed(h[:-1] * _MIX[0] + words[k - 1 :]), exists[:-1] & real[k - 1 :]
        cells.append(h >> np.uint64(64 - bits))
        there.append(exists)
    return starts, ends, cells, there


def _packed(x: np.ndarray) -> bytes:
    """Sorted numbers, as differences; their first bytes, then their second ones and so on, the last of which are mostly zero."""
    return zstandard.compress(np.diff(x, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _numbers(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def blocks_of(docs: DataFrame, bits: int, range_bits: int, longest: int, size: int = BLOCK) -> DataFrame:
    """Columns lang, text, parts: plain texts of a language in blocks, compressed, with the counts of their cells by range."""
    part = pa.struct([("range", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])
    schema = pa.schema([("lang", pa.string()), ("text", pa.binary()), ("parts", pa.list_(part))])
    low = bits - range_bits

    def row(lang: str, block: bytes) -> pa.RecordBatch:
        _, _, cells, there = phrase_cells(block, lang, bits, longest)
        found, counts = np.unique(np.concatenate([c[t] for c, t in zip(cells, there)]), return_counts=True)
        found, counts = found.astype(np.int64), np.minimum(counts, 255).astype(np.uint8)
        at = np.append(np.flatnonzero(np.diff(found >> low, prepend=-1)), len(found))
        parts = [
            {"range": int(found[i] >> low), "cells": _packed(found[i:j] & ((1 << low) - 1)), "counts": zstandard.compress(counts[i:j].tobytes(), 1)} for i, j in zip(at, at[1:])
        ]
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([zstandard.compress(block, 3)], pa.binary()), pa.array([parts], schema.field("parts").type)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        held: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            del held[lang]
            return row(lang, (b" " + BREAK + b" ").join(waiting.pop(lang)))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for lang, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    for one in cut(plain(text), size):
                        if not one:
                            continue
                        if lang in held and held[lang] + len(one) > size:
                            yield flush(lang)
                        waiting.setdefault(lang, []).append(one)
                        held[lang] = held.get(lang, 0) + len(one) + 3
                        if sum(held.values()) > OPEN:
                            yield flush(max(held, key=held.get))
        for lang in list(held):
            yield flush(lang)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, text binary, parts array<struct<range: int, cells: binary, counts: binary>>")


def heavy_cells(parts: DataFrame, low: int, min_count: int) -> DataFrame:
    """Columns grp, block, range, heavy: of each part (grp, block, range, cells, counts) the cells whose sum over all blocks is min_count or more."""

    def of_range(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(1 << low, np.uint32)
        for cells, counts in zip(rows["cells"], rows["counts"]):
            total[_numbers(cells.as_py())] += np.frombuffer(zstandard.decompress(counts.as_py()), np.uint8)
        out = []
        for grp, block, cells in zip(rows["grp"].to_pylist(), rows["block"].to_pylist(), rows["cells"]):
            found = _numbers(cells.as_py())
            found = found[total[found] >= min_count]
            if len(found):
                out.append((grp, block, _packed(found)))
        grp, blocks, heavy = zip(*out) if out else ((), (), ())
        n = pa.array([key[0].as_py()] * len(out), pa.int32())
        return pa.table({"grp": pa.array(grp, pa.int64()), "block": pa.array(blocks, pa.int64()), "range": n, "heavy": pa.array(heavy, pa.binary())})

    return parts.groupBy("range").applyInArrow(of_range, "grp long, block long, range int, heavy binary")


def matches(lang: str, block: bytes, cells: np.ndarray, bits: int, longest: int) -> tuple[int, list[str], np.ndarray]:
    """(words, candidates between their delimiters, overlapping matches of each) of a block; cells: its heavy ones, in order."""
    starts, ends, of, there = phrase_cells(block, lang, bits, longest)
    text = f" {block.decode('latin-1')} "  # a character for each byte
    patterns: set[str] = set()
    fits = None
    for k, (c, t) in enumerate(zip(of, there)):
        fits = t if fits is None else t & fits[:-1] & fits[1:]
        at = np.flatnonzero(fits)
        c = c[at].astype(np.int64)
        at = at[cells[np.minimum(np.searchsorted(cells, c), len(cells) - 1)] == c] if len(cells) else at[:0]
        fits = np.zeros(len(t), bool)
        fits[at] = True
        patterns.update(text[s : e + 2] for s, e in zip(starts[at].tolist(), ends[at + k].tolist()))
    n = int(there[0].sum())
    del starts, ends, of, there, fits  # before the automaton is built
    found, counts = sorted(patterns), np.zeros(0, np.int64)
    if found:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, p in enumerate(found):
            automaton.add_word(p, i)
        automaton.make_automaton()
        counts = np.bincount(np.fromiter((i for _, i in automaton.iter(text)), np.int64), minlength=len(found))
    return n, found, counts


def counted(blocks: DataFrame, heavy: DataFrame, bits: int, low: int, longest: int, buckets: int) -> DataFrame:
    """Columns lang, bucket, phrases, counts: overlapping matches of the blocks' candidates, summed over a group (grp) of blocks.

    A row lists the phrases of a bucket, in the order of their bytes; the number of a group's words stands under the empty phrase.
    """

    def scan(key: tuple, own: pa.Table, marked: pa.Table) -> pa.Table:
        cells: dict[int, list[np.ndarray]] = {}
        for block, r, h in zip(marked["block"].to_pylist(), marked["range"].to_pylist(), marked["heavy"]):
            cells.setdefault(block, []).append(_numbers(h.as_py()) + (r << low))
        sums: dict[str, dict[str, int]] = {}
        for block, lang, text in zip(own["block"].to_pylist(), own["lang"].to_pylist(), own["text"]):
            mine = np.sort(np.concatenate(cells.pop(block, [np.zeros(0, np.int64)])))
            n, found, counts = matches(lang, zstandard.decompress(text.as_py()), mine, bits, longest)
            total = sums.setdefault(lang, {})
            total["  "] = total.get("  ", 0) + n
            for p, k in zip(found, counts.tolist()):
                total[p] = total.get(p, 0) + k
        out = []
        for lang, total in sums.items():
            listed: dict[int, list[str]] = {}
            for p in sorted(total):
                listed.setdefault(xxhash.xxh64_intdigest(p) % buckets, []).append(p)
            for bucket, mine in listed.items():
                phrases = b"\n".join(p[1:-1].encode("latin-1") for p in mine)  # no phrase holds the end of a line
                counts = np.array([total[p] for p in mine], np.int64).tobytes()
                out.append((lang, bucket, zstandard.compress(phrases, 3), zstandard.compress(counts, 1)))
        langs, numbers, phrases, counts = zip(*out) if out else ((), (), (), ())
        return pa.table({"lang": pa.array(langs, pa.string()), "bucket": pa.array(numbers, pa.int32()), "phrases": pa.array(phrases, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return blocks.select("grp", "block", "lang", "text").groupBy("grp").cogroup(heavy.groupBy("grp")).applyInArrow(scan, "lang string, bucket int, phrases binary, counts binary")


def summed(lists: DataFrame, min_count: int) -> DataFrame:
    """Columns lang, phrase, f: the sums of ``counted`` that are min_count or more, and those of the empty phrase."""

    def of_bucket(key: tuple, rows: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for phrases, counts in zip(rows["phrases"], rows["counts"]):
            for p, k in zip(zstandard.decompress(phrases.as_py()).split(b"\n"), np.frombuffer(zstandard.decompress(counts.as_py()), np.int64).tolist()):
                total[p] = total.get(p, 0) + k
        kept = {p: k for p, k in total.items() if k >= min_count or not p}
        return pa.table({"lang": pa.array([key[0].as_py()] * len(kept), pa.string()), "phrase": pa.array(list(kept), pa.binary()), "f": pa.array(list(kept.values()), pa.int64())})

    return lists.groupBy("lang", "bucket").applyInArrow(of_bucket, "lang string, phrase binary, f long")


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, scratch: Scratch | None = None, size: int = BLOCK, bits: int | None = None) -> DataFrame:
    """Columns lang, phrase, f of every phrase of 1 to ``longest`` words with min_count occurrences or more, and of the
    empty phrase, whose f is the number of words of the language; docs as for ``collocations``. bits: the sketch has 2 ** bits
    cells, by default one for eight bytes of text (0.4 phrases of a byte: about three of a cell)."""
    scratch = scratch or Scratch(docs.sparkSession, "phrases")
    if bits is None:
        n = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(30 + RANGE_BITS, max(16, (n // 8).bit_length()))
    range_bits = min(bits - 1, max(LEAST_RANGE_BITS, bits - RANGE_BITS))
    low = bits - range_bits
    made = scratch.save(blocks_of(docs, bits, range_bits, longest, size).withColumn("block", F.monotonically_increasing_id()), "blocks")
    groups = -(-made.count() // GROUP) or 1
    blocks = made.withColumn("grp", F.xxhash64("lang", F.pmod(F.xxhash64("block"), F.lit(groups))))
    parts = blocks.select("grp", "block", F.explode("parts").alias("p")).select("grp", "block", "p.*")
    heavy = scratch.save(heavy_cells(parts, low, min_count), "heavy")
    lists = scratch.save(counted(blocks, heavy, bits, low, longest, max(BUCKETS, groups)), "lists")
    out = scratch.save(summed(lists, min_count).select("lang", F.col("phrase").cast("string").alias("phrase"), "f"), "counts")
    for done in (heavy, made, lists):
        scratch.drop(done)
    return out


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, within: int = WITHIN, best: int = BEST,
    scratch: Scratch | None = None, size: int = BLOCK, bits: int | None = None,
) -> DataFrame:
    """The best phrases of each language: columns lang, rank, phrase, a, l, r, n, score.

    docs: lang (null: ``und``) and text (null: no words); other columns are ignored, repeated rows count
    each. Texts with A-Z lowered fall into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words ``[^\\x20\\x09]+``;
    n: words of the language. Candidates are phrases of 2 to ``longest`` words found a >= min_count times
    within pieces. A cut after k words has l and r, the counts of both parts, and the score
    floor(2 * SCALE * a / (l + r)); the least one counts, of equal ones that of the least k. Candidates that
    stand inside a longer one found within % of a times or more are left out. Ranked by score and a,
    falling, then by the bytes of the phrase; ``best`` of a language stay. A language without candidates and an
    empty table give no rows. A very long text is cut at the ends of pieces; a piece is held whole.
    """
    scratch = scratch or Scratch(docs.sparkSession, "phrases")
    counts = phrase_counts(docs, min_count, longest, scratch, size, bits)
    words = F.split("phrase", " ")
    found = counts.where("phrase like '% %'").select("lang", "phrase", F.col("f").alias("a"), words.alias("w"))
    joined = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.size("w")).alias("right"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = lambda c: f"CAST({c} AS DECIMAL(20, 0))"
    score = F.expr(f"({wide('a')} * {2 * SCALE}) DIV ({wide('l')} + {wide('r')})").alias("score")
    scored = scored.select("lang", "phrase", "a", F.struct(score, "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    # parts of two words or more of the longer candidates, with the highest count of these
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: joined(i, n))))
    longer = found.where(F.size("w") > 2).select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer IS NULL OR {wide('longer')} * 100 < {wide('a')} * {within}"))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    top = kept.withColumn("rank", rank).where(F.col("rank") <= best)
    n = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return top.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE = """
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || chr(9),
    'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 10) || ' '), chr(10))) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS ws FROM t),
g AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
c AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
a AS (SELECT *, string_split(phrase, ' ') AS ws FROM c WHERE k > 1 AND f >= 30),
u AS (SELECT lang, phrase, f, k, ws, unnest(range(1, k)) AS j FROM a),
s AS (SELECT u.lang, u.phrase, u.k, u.f AS a, j, x.f AS l, y.f AS r, ((2000000::HUGEINT * u.f) // (x.f + y.f))::BIGINT AS score
  FROM u JOIN c x ON x.lang = u.lang AND x.phrase = array_to_string(u.ws[1:j], ' ') JOIN c y ON y.lang = u.lang AND y.phrase = array_to_string(u.ws[j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM a z WHERE z.lang = b.lang AND z.k > b.k AND 100 * z.f >= 80 * b.a AND contains(' ' || z.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM o JOIN n USING (lang) QUALIFY rank <= 2000
"""
