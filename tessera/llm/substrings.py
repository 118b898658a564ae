"""Substring dedup: passages of at least a window of words that occur earlier are removed.

Seed: each window of ``window`` words selects one of its word k-grams by least hash (winnowing), so
equal windows select equal anchors at equal places. Consecutive windows that select the same anchor
form a block; documents are joined on anchors, and blocks whose anchor occurs once are done with.
Extend: a block occurrence whose whole context equals that of an earlier one is a repeat as it
stands; among the different contexts of an anchor, the match is extended window by window to both
sides as far as the context allows. What comes out is every window that occurs earlier; the union of
their words are the maximal repeats of ``window`` words or more.

Groups are reduced before they are joined (one row for a context however often it occurs), so a
group of copies costs rows in proportion to its size, and no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import raw_words, table
from tessera.plans.scratch import Scratch

WINDOW, ANCHOR = 20, 8

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Hasher:
    """Hashes of word runs of one document, from prefix sums of a polynomial modulo 2^64."""

    powers = inverses = np.ones(1, np.uint64)

    def __init__(self, words: list[bytes]):
        n = len(words)
        if len(Hasher.powers) <= n:
            size = 2 * n + 1
            step = lambda base: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))])
            Hasher.powers, Hasher.inverses = step(_BASE), step(_INVERSE)
        digest = xxhash.xxh64_intdigest
        each = np.fromiter(map(digest, words), np.uint64, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each * Hasher.powers[:n])])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x = (self.sums[ends] - self.sums[starts]) * Hasher.inverses[starts]
        x ^= (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def blocks_of(words: list[bytes], window: int, k: int) -> tuple[np.ndarray, ...] | None:
    """(anchor hash, context hash, first window, windows, again) of the blocks of a document.

    again: an equal block starts earlier in the document.
    """
    n = len(words) - window + 1
    if n < 1:
        return None
    hasher = Hasher(words)
    at = np.arange(len(words) - k + 1)
    grams = hasher.runs(at, at + k)
    anchors = sliding_window_view(grams, window - k + 1).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    count = np.diff(np.append(first, n))
    context = hasher.runs(first, first + count + window - 1)
    again = np.ones(len(first), bool)
    again[np.unique(context, return_index=True)[1]] = False
    return grams[anchors[first]], context, first, count, again


BLOCKS = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("first", pa.int32()), ("n", pa.int16()), ("again", pa.bool_())])


def _blocks(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                docs, parts = [], []
                for doc, text in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    if (found := blocks_of(raw_words(text), window, k)) is not None:
                        docs.append(np.full(len(found[0]), doc))
                        parts.append(found)
                if parts:
                    columns = [np.concatenate(c) for c in (docs, *zip(*parts))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((c.astype(t.to_pandas_dtype()) for c, t in zip(columns, BLOCKS.types)), BLOCKS.types)], schema=BLOCKS)

    return run


WINDOWS = pa.schema([("doc", pa.int64()), ("h", pa.int64()), ("w", pa.int64()), ("first", pa.int32()), ("again", pa.bool_())])


def _windows(window: int):
    """Windows of the blocks (h, first, n) of each document; again: an equal one of them is earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for doc, text, blocks in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    hasher, seen = Hasher(raw_words(text)), set()
                    blocks.sort(key=lambda b: b["first"])
                    starts = np.concatenate([np.arange(b["first"], b["first"] + b["n"]) for b in blocks])
                    anchors = np.repeat([b["h"] for b in blocks], [b["n"] for b in blocks])
                    for h, w, s in zip(anchors.tolist(), hasher.runs(starts, starts + window).tolist(), starts.tolist()):
                        out.append((doc, h, w, s, (h, w) in seen))
                        seen.add((h, w))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), WINDOWS.types)], schema=WINDOWS)

    return run


def _judged(rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows + ``leader``, the least document of each key; the leaders are a table, so that a hot key can be split."""
    leaders = scratch.save(rows.groupBy(*keys).agg(F.min("doc").alias("leader")), name)
    return rows.join(leaders, keys)


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, scratch: Scratch | None = None) -> DataFrame:
    """Columns doc, ranges: per document with repeats, the runs (first, n) of window starts that occur earlier.

    docs: doc and text; doc is not null and differs from row to row.
    """
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    docs = docs.select("doc", F.col("text").cast("binary").alias("text"))
    made = scratch.save(docs.mapInArrow(_blocks(window, anchor), "doc long, h long, c long, first int, n short, again boolean"), "blocks")
    mine = made.where("not again").select("doc", "h", "c", "first", "n")
    common = scratch.save(mine.groupBy("h").agg(F.count("*").alias("x")).where("x > 1").select("h"), "anchors")
    met = scratch.save(mine.join(common, "h"), "met")
    inside = scratch.save(made.where("again").select("doc", "first", "n"), "inside")
    scratch.drop(made)
    scratch.drop(common)

    judged = scratch.save(_judged(met, ["h", "c"], scratch, "contexts"), "judged")
    scratch.drop(met)
    copied = judged.where("doc > leader").select("doc", "first", "n")
    # anchors with different contexts: one occurrence of each context is extended
    leading = judged.where("doc = leader").select("doc", "h", "first", "n")
    varied = scratch.save(leading.groupBy("h").agg(F.count("*").alias("x")).where("x > 1").select("h"), "varied")
    wanted = leading.join(varied, "h").groupBy("doc").agg(F.collect_list(F.struct("h", "first", F.col("n").cast("int").alias("n"))).alias("blocks"))
    seen = scratch.save(
        docs.join(wanted, "doc").select("doc", "text", "blocks").mapInArrow(_windows(window), "doc long, h long, w long, first int, again boolean"), "windows"
    )
    apart = _judged(seen.where("not again").select("doc", "h", "w", "first"), ["h", "w"], scratch, "matches").where("doc > leader")
    single = apart.select("doc", "first").unionByName(seen.where("again").select("doc", "first")).withColumn("n", F.lit(1).cast("short"))
    runs = copied.unionByName(inside).unionByName(single)
    return scratch.save(runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("first", F.col("n").cast("int").alias("n")))).alias("ranges")), "ranges")


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Columns doc_id, n_words, n_removed, kept for every row of docs (doc_id, text; others are ignored).

    kept: the words left, joined by one space. A word is removed if a window that covers it has the
    same words as one that starts earlier: in a smaller doc_id, or earlier in the same document.
    Null and blank texts have no words. A null doc_id counts as the smallest. Rows of equal doc_id and
    text are one document and get equal results; rows of equal doc_id and different texts are
    different documents in an arbitrary but fixed order. A very long text is looked at whole, in memory
    that grows with its length; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    plain = ids["rows"] == ids["ids"]
    if plain:
        named = docs.withColumn("doc", F.col("doc_id"))
        first = named
    else:  # numbers in the order of doc_id, the same for equal rows
        order = docs.select("doc_id", F.xxhash64("text").alias("key")).distinct().sort("doc_id", "key")
        order = scratch.save(order.withColumn("doc", F.monotonically_increasing_id()), "order")
        on = docs["doc_id"].eqNullSafe(order["doc_id"]) & (F.xxhash64(docs["text"]) == order["key"])
        named = docs.join(order, on).select(docs["doc_id"], "text", "doc")
        first = scratch.save(named.groupBy("doc").agg(F.first("text").alias("text")), "texts")
    found = repeats(first, window, anchor, scratch)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for doc_id, text, ranges in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    words = kept = raw_words(text)
                    if ranges:
                        edges = np.zeros(len(words) + 1, np.int64)
                        first, n = np.array([(r["first"], r["n"]) for r in ranges]).T
                        np.add.at(edges, first, 1)
                        np.add.at(edges, first + n + window - 1, -1)
                        kept = [w for w, over in zip(words, np.cumsum(edges).tolist()) if not over]
                    out.append((doc_id, len(words), len(words) - len(kept), b" ".join(kept)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    whole = named.join(found, "doc", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "ranges")
    return whole.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20),
x AS (SELECT doc_id, p, hash(array_to_string(w[p:p + 19], ' ')) AS h1, md5_number(array_to_string(w[p:p + 19], ' ')) AS h2 FROM s),
r AS (SELECT doc_id, p FROM x QUALIFY row_number() OVER (PARTITION BY h1, h2 ORDER BY doc_id, p) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM r),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT e.doc_id, count(c.p) AS gone, string_agg(e.word, ' ' ORDER BY e.p) FILTER (WHERE c.p IS NULL) AS kept FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.p = c.p GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.gone, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
