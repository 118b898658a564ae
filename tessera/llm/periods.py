"""Periodic runs of words: stretches that repeat a block of words several times over.

A run with period q and length m makes m - q matches at lag q (equal words q places apart), so only
lags with enough matches can hold one. Matches of all lags are counted exactly, the frequent words by
an autocorrelation through the FFT, the rare ones by the differences between their places. A lag with
enough of them is scanned for islands of consecutive matches; matches that a run already found with a
shorter period explains are not counted again for its multiples.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, per_row, raw_words, table

#: A run has at least so many words, and so many times its period.
SHORTEST, REPEATS = 6, 4


def lag_counts(ids: np.ndarray, most: int, heavy: int | None = None) -> np.ndarray:
    """How many words equal the one p places on, for p up to ``most`` (and 0 for p = 0); exact.

    Words found more often than ``heavy`` go by the FFT, the others by pairs; by default the bound is
    where a word's pairs cost as much as its transform, so that both parts stay below n ** 1.5 log n.
    """
    n, counts = len(ids), np.zeros(most + 1, np.int64)
    if most < 1:
        return counts
    heavy = int(2 * (n * np.log2(n + 1)) ** 0.5) if heavy is None else heavy
    often = np.bincount(ids)
    loud = np.flatnonzero(often > heavy)
    if len(loud):
        size = 1 << (n + most - 1).bit_length()  # long enough that no lag up to most wraps around
        power = np.zeros(size // 2 + 1)
        for w in loud:
            f = np.fft.rfft(ids == w, size)
            power += f.real**2 + f.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    at = np.argsort(ids, kind="stable")
    at = at[often[ids[at]] <= heavy]
    word, first, k = ids[at], np.arange(len(at)), 0
    while len(first):
        k += 1
        first = first[: np.searchsorted(first, len(at) - k)]
        apart = at[first + k] - at[first]
        near = (word[first + k] == word[first]) & (apart <= most)
        first = first[near]
        counts += np.bincount(apart[near], minlength=most + 1)
    counts[0] = 0
    return counts


def _primes(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + [n] * (n > 1)


def runs_of(ids: np.ndarray, shortest: int = SHORTEST, repeats: int = REPEATS, heavy: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, by start and period; repeats is 4 or more.

    A run has no smaller period than its own, max(shortest, repeats * period) words or more, and no
    neighbouring word that keeps its period.
    """
    if repeats < 4:
        raise ValueError("the bound on explained matches needs four repeats or more")
    n = len(ids)
    most = n // repeats
    counts = lag_counts(ids, most, heavy)
    explained, found = np.zeros(most + 1, np.int64), []
    lags = np.arange(most + 1)
    for p in np.flatnonzero((counts >= np.maximum(shortest - lags, (repeats - 1) * lags)) & (lags > 0)).tolist():
        # a run of this very period shares fewer than p / 2 matches with a longer run of a divisor, at either end
        if explained[p] and counts[p] - explained[p] < (repeats - 2) * p:
            continue
        same = np.zeros(n - p + 2, np.int8)
        same[1:-1] = ids[p:] == ids[:-p]
        turns = np.flatnonzero(np.diff(same))
        for start, end in zip(turns[::2].tolist(), turns[1::2].tolist()):
            length = end - start + p
            if length < max(shortest, repeats * p):
                continue
            if any(np.array_equal(ids[start + q : start + length], ids[start : start + length - q]) for q in (p // r for r in _primes(p))):
                continue
            found.append((start, length, p))
            multiples = np.arange(2 * p, min(most, length // 2) + 1, p)
            explained[multiples] += length - multiples
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """Numbers that equal words share."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """Columns doc_id, n_words, runs and collapsed for every row of docs (doc_id, text).

    runs: array of (start, length, period) in words, by start and period. collapsed: the words that no
    run holds beyond its first period, joined by one space. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged;
    a null or blank text has none, no runs and an empty collapsed text. Repeated rows get a result each,
    the id is only passed on and may be null, other columns are ignored, an empty table gives an empty
    result. A very long text is looked at whole, in memory that grows with its length.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.binary())])

    def row(doc_id, text):
        words = raw_words(text)
        runs = runs_of(numbered(words), shortest, repeats)
        if runs:
            edge = np.zeros(len(words) + 1, np.int64)
            for start, length, period in runs:
                edge[start + period] += 1
                edge[start + length] -= 1
            words_kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
        else:
            words_kept = words
        return doc_id, len(words), [{"start": s, "length": m, "period": p} for s, m, p in runs], b" ".join(words_kept)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = rows.mapInArrow(per_row(lambda: row, schema), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(runs: Column) -> Column:
    """The run of the greatest length in periods; of equal ones the first. Null without runs."""
    empty = F.lit(None).cast("struct<start: long, length: long, period: long>")
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(runs, empty, lambda best, x: F.when(best.isNull() | more(x, best), x).otherwise(best))


def with_tails_repeated(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the texts of a tenth of the ids end in a repeated block of words.

    With h the crc32 of the decimal id (a null id: of the empty text) and g = floor(h / 10), the n words
    of a text with h % 10 = 0 become word a + (i - a) % p from place a = g % n on, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), SPACE, " " * len(SPACE)), " "), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words")
    changed = chosen.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("long") + 1)
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    tail = F.array_join(F.transform("words", lambda w, i: F.get("words", place(i).cast("int"))), " ")
    return changed.select("doc_id", F.when(n > 0, tail).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_tails_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))).withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
