"""All pairs of texts whose sets of word shingles reach a Jaccard similarity, and their groups.

A fingerprint's radius cannot promise a similarity: two texts at 0.8 differ in about 10 of 64 bits,
give or take 3. Candidates come from a table of prefixes instead. All shingles have one order; a text
of n shingles keeps its first n - ceil(0.8 n) + 1, and two texts that reach the similarity share one
of those whatever they differ in. The order is that of the hashes, except that common shingles come
last, so that a common passage does not make all its texts candidates: any order is as right, this
one is faster. Common are those found in the prefixes of many texts, and of the shingles that stand
beside these in a text, the rest of the passage, those that as many texts hold.

Each shared shingle links its texts to the one with the least of its own; then every pair of different
groups that shares a shingle is compared. The first step keeps groups of copies linear, the second
leaves no pair out. A candidate is first held against a bound that loses nothing: maps of the parity
of the shingles' hashes differ in no more bits than the texts in shingles; pairs of different groups
that fail it are never written. What is left is verified by
the exact similarity, and only those texts' shingles travel.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import per_row, raw_words
from tessera.operators.components import connected_components
from tessera.plans.scratch import Scratch

SEED = 42
SIZE, SIMILARITY = 5, 0.8
#: A shingle of more texts than this goes to the end of the order; at most so many do; places on which one is beside another.
COMMON, MOST_COMMON, BESIDE = 50, 200_000, 16
#: Bits of a text's parity map, a power of two; texts of a shingle's list.
BITMAP, LIST = 1024, 512
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Rows of hashes take three times their shuffled size in memory, and texts several times theirs in a batch: smaller partitions and batches than the usual.
FRUGAL = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def runs(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """Hashes of the runs of ``size`` words, A-Z lowered, as they stand; a shorter text is one run, one without words is 0."""
    words = raw_words(text.lower() if text else text)
    if not words:
        return np.zeros(1, np.int64)
    w = np.array([xxhash.xxh64_intdigest(x, SEED) for x in words], np.uint64)
    k = min(size, len(w))
    n = len(w) - k + 1
    h = w[:n].copy()
    for j in range(1, k):
        h ^= h >> np.uint64(29)
        h = h * MIX + w[j : j + n]
    h ^= h >> np.uint64(32)
    h *= MIX
    return h.view(np.int64)


def shingles(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """The different hashes of the runs, in order."""
    return np.unique(runs(text, size))


def among(hashes: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which hashes are in ``some``, which is sorted."""
    if not len(some):
        return np.zeros(len(hashes), bool)
    return some[np.minimum(np.searchsorted(some, hashes), len(some) - 1)] == hashes


def beside(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The different hashes, in order, that stand within ``BESIDE`` places of a common one and are none."""
    found = among(hashes, common)
    upto = np.concatenate([[0], np.cumsum(found)])
    at = np.arange(len(hashes))
    near = upto[np.minimum(at + BESIDE + 1, len(hashes))] > upto[np.maximum(at - BESIDE, 0)]
    return np.unique(hashes[near & ~found])


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The first hashes in the order: those that are not common, then the others."""
    n = len(hashes)
    late = among(hashes, common)
    return np.concatenate([hashes[~late], hashes[late]])[: n - math.ceil(similarity * n - 1e-9) + 1]


def parity(hashes: np.ndarray) -> np.ndarray:
    """BITMAP bits: whether an odd number of the hashes falls on each. Two sets differ in as many hashes at least as their maps in bits."""
    odd = np.bincount(hashes & (BITMAP - 1), minlength=BITMAP).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _by_text(texts: DataFrame, of: Callable[[bytes | None], tuple], schema: pa.Schema, ddl: str) -> DataFrame:
    """node and of(text), one row for each node of texts (node, text)."""
    rows = texts.select("node", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(per_row(lambda: lambda node, text: (node, *of(text)), schema), ddl).dropDuplicates(["node"])


def _sketches(texts: DataFrame, size: int, similarity: float, common: np.ndarray) -> DataFrame:
    """Columns node, n, prefix and map, one row for each node of texts."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("map", pa.list_(pa.int64()))])

    def of(text):
        found = shingles(text, size)
        return len(found), prefix(found, similarity, common), parity(found)

    return _by_text(texts, of, schema, "node long, n int, prefix array<long>, map array<long>")


SETS = pa.schema([("node", pa.int64()), ("hashes", pa.list_(pa.int64()))])


def _frequent(sets: DataFrame, column: str, most: int) -> np.ndarray:
    """The hashes that more than ``COMMON`` rows hold, sorted; the most frequent of them, ``most`` at most."""
    counts = sets.select(F.explode(column).alias("h")).groupBy("h").count().where(F.col("count") > COMMON)
    return np.array(sorted(r["h"] for r in counts.orderBy(F.desc("count"), "h").limit(most).collect()), np.int64)


def _apart(x: F.Column, y: F.Column) -> F.Column:
    """Bits in which two maps differ."""
    return F.aggregate(F.zip_with(x, y, lambda i, j: F.bit_count(i.bitwiseXOR(j))), F.lit(0), lambda s, i: s + i)


def _near(x: F.Column, y: F.Column, n: F.Column, m: F.Column, similarity: float) -> F.Column:
    """Whether texts of n and m shingles with these maps may reach the similarity."""
    return _apart(x, y) <= (n + m) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes whose similarity is reached: by their maps first, then by their shingles."""
    of = lambda c, k, m: sketches.select(F.col("node").alias(c), F.col("n").alias(k), F.col("map").alias(m))
    met = pairs.join(of("a", "k", "x"), "a").join(of("b", "l", "y"), "b").where(_near(F.col("x"), F.col("y"), F.col("k"), F.col("l"), similarity))
    near = scratch.save(met.select("a", "b"), "near")
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = scratch.save(_by_text(texts.join(wanted, "node", "left_semi"), lambda t: (shingles(t, size),), SETS, "node long, hashes array<long>"), "sets")
    met = near.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    met = met.select("a", "b", (F.size("x") + F.size("y")).alias("both"), F.size(F.array_intersect("x", "y")).alias("shared"))
    found = scratch.save(met.where(F.col("shared") / (F.col("both") - F.col("shared")) >= similarity).select("a", "b"), "links")
    for done in (near, sets):
        scratch.drop(done)
    return found


def similar_texts(texts: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, scratch: Scratch | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """Columns node, component of every node that a chain of pairs at ``similarity`` or more links to another.

    texts: node (a number that equal texts share and different ones do not) and text, rows in any number.
    component: the least node of the group. Null, empty and blank texts are similar to each other; a
    very long text has all its shingles. An empty table gives an empty result. seeds: pairs (a, b) of
    nodes, a < b, that are worth a comparison before others; they change the work, not the result.
    """
    scratch = scratch or Scratch(texts.sparkSession, "similar", FRUGAL)
    sketches = scratch.save(_sketches(texts, size, similarity, np.zeros(0, np.int64)), "sketches")
    common = _frequent(sketches, "prefix", MOST_COMMON)
    if len(common):
        scratch.drop(sketches)
        rest = _by_text(texts, lambda t, seen=common: (beside(runs(t, size), seen),), SETS, "node long, hashes array<long>")
        common = np.union1d(common, _frequent(rest.where(F.size("hashes") > 0), "hashes", MOST_COMMON - len(common)))
        sketches = scratch.save(_sketches(texts, size, similarity, common), "sketches")
    places = sketches.select("node", "n", F.posexplode("prefix").alias("at", "h")).withColumn("texts", F.count("*").over(Window.partitionBy("h")))
    places = scratch.save(places.where("texts > 1").drop("texts"), "places")
    # a text with little of its own shares more of its prefix than others: the best first one of a shingle's texts
    own = places.groupBy("node").agg(F.count("*").alias("many"))
    places = scratch.save(places.join(own, "node").select("h", "node", "n", "at", (F.col("many") / F.col("n")).alias("share")), "weighted")

    def can(n: F.Column, at: F.Column, m: F.Column, to: F.Column) -> F.Column:
        """Whether texts of n and m shingles that first meet at these places can reach the similarity."""
        return F.least(n - at, m - to) >= (n + m) * F.lit(similarity / (1 + similarity)) - 1e-6

    of = Window.partitionBy("h").orderBy(F.desc("share"), "node")
    stars = places.select("node", "n", "at", F.first(F.struct("node", "n", "at")).over(of).alias("f")).where(F.col("node") != F.col("f.node"))
    stars = stars.where(can(F.col("n"), F.col("at"), F.col("f.n"), F.col("f.at"))).select(F.least("node", "f.node").alias("a"), F.greatest("node", "f.node").alias("b"))
    stars = scratch.save((stars.unionByName(seeds) if seeds is not None else stars).distinct(), "stars")
    links = _verified(stars, sketches, texts, size, similarity, scratch)
    groups = connected_components(links, "a", "b", scratch=scratch)

    # what is not linked yet: members of different groups, in lists of bounded length
    grouped = scratch.save(places.join(groups, "node", "left").select("h", "node", "n", "at", F.coalesce("component", "node").alias("c")), "grouped")
    open_ = grouped.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("many")).where("lo <> hi")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / LIST)).alias("part")
    half = BITMAP // 128  # a map folded upon itself is one of half the bits
    folded = F.zip_with(F.slice("map", 1, half), F.slice("map", half + 1, half), lambda x, y: x.bitwiseXOR(y)).alias("map")
    listed = grouped.join(open_.select("h", "many"), "h").join(sketches.select("node", folded), "node")
    lists = listed.groupBy("h", "c", part).agg(F.collect_list(F.struct("node", "n", "at", "map")).alias("own"))
    lists = scratch.save(lists.select("h", "c", "own"), "lists")
    met = lists.join(lists.select("h", F.col("c").alias("d"), F.col("own").alias("other")), "h").where("c < d")
    each = F.transform("own", lambda x: F.transform(F.filter("other", lambda y: can(x["n"], x["at"], y["n"], y["at"]) & _near(x["map"], y["map"], x["n"], y["n"], similarity)), lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"))))
    pairs = met.select(F.explode(F.flatten(each)).alias("p")).select("p.*").distinct().join(stars, ["a", "b"], "left_anti")
    late = _verified(scratch.save(pairs, "pairs"), sketches, texts, size, similarity, scratch)
    return connected_components(links.unionByName(late), "a", "b", scratch=scratch) if late.take(1) else groups
