"""SimHash near-duplicates by multi-index hashing of 64-bit fingerprints.

A fingerprint is cut into segments, and each segment's value indexes a table of its own. Two
fingerprints within the radius differ in at most radius // segments bits of some segment, so a
fingerprint looks up, for each of its segments, the values of that small Hamming ball in that
segment's table; complete distances of what it meets are verified.

A table entry grows with the corpus where many different near copies agree in a segment. Entries of
more than ``BUCKET`` fingerprints are not paired: all fingerprints that look such an entry up are
keyed by every whole value within half the radius. Two fingerprints within the radius have such a
value in common (one half way between them), and two that share one are within the radius, so one
link to the first of each key is enough: linear in rows, whatever the size of a group, and no link
between different texts is lost.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import per_row, raw_words, table
from tessera.llm.similar import FRUGAL, SIMILARITY, SIZE, similar_texts
from tessera.operators.components import connected_components
from tessera.plans.scratch import Scratch

#: Seed of the shingle hash.
SEED = 42
BITS = 64
#: Bits within which fingerprints are linked, tables, and fingerprints of a table entry that are paired one by one.
RADIUS, SEGMENTS, BUCKET = 2, 2, 64


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """Bitwise majority of the XXH64 of all shingles of ``size`` words, A-Z lowered; 0 without words."""
    words = raw_words(text.lower() if text else text)
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = max(1, len(words) - size + 1)
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 15):  # bounded memory for very long texts
        top = min(n, at + (1 << 15))
        ends = (starts[min(i + size, len(words))] - 1 for i in range(at, top))
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:top], ends)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """Columns doc_id and fp, the fingerprint as a signed 64-bit number, for every row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def make():
        return lambda i, t: (i, fp - (1 << BITS) if (fp := fingerprint(t, size)) >> (BITS - 1) else fp)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(per_row(make, schema), "doc_id long, fp long")


def _masks(width: int, ball: int) -> F.Column:
    """All numbers of ``width`` bits with at most ``ball`` of them set, as an array of signed 64-bit numbers."""
    found = [sum(1 << b for b in c) for r in range(ball + 1) for c in combinations(range(width), r)]
    return F.array(*(F.lit(m - (1 << BITS) if m >> (BITS - 1) else m).cast("long") for m in found))


def segment(fp: F.Column, s: F.Column, segments: int) -> F.Column:
    """The value of the s-th segment of a fingerprint."""
    width = BITS // segments
    return F.call_function("shiftrightunsigned", fp, s * width).bitwiseAND(F.lit((1 << width) - 1 if width < BITS else -1).cast("long"))


def links(nodes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, bucket: int = BUCKET, scratch: Scratch | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints within ``radius`` bits.

    nodes: fp, one row for each different fingerprint. segments: a divisor of 64; it changes how
    fingerprints are found, not the result. radius: an even number.
    """
    if radius % 2 or BITS % segments:
        raise ValueError("an even radius and a divisor of 64 are needed")
    scratch = scratch or Scratch(nodes.sparkSession, "simhash")
    numbered = nodes.select("fp", F.explode(F.array(*map(F.lit, range(segments)))).alias("s")).withColumn("value", segment(F.col("fp"), F.col("s"), segments))
    nth = F.row_number().over(Window.partitionBy("s", "value").orderBy("fp"))
    tables = numbered.withColumn("nth", nth).where(F.col("nth") <= bucket + 1).groupBy("s", "value").agg(F.collect_list("fp").alias("fps"))
    # the balls of the segment's value
    ball = F.transform(_masks(BITS // segments, radius // segments), lambda m: F.col("value").bitwiseXOR(m))
    looked_up = numbered.select("fp", "s", F.explode(ball).alias("value"))
    near = F.filter("fps", lambda x: (x != F.col("fp")) & (F.bit_count(x.bitwiseXOR(F.col("fp"))) <= radius))
    none = F.lit(None).cast("long")
    # Spark sizes an explode as one row for each of its input, so it is told to deal both sides and broadcast neither
    met = looked_up.hint("merge").join(tables, ["s", "value"]).select("fp", F.explode(F.when(F.size("fps") > bucket, F.array(none)).otherwise(near)).alias("other"))
    met = scratch.save(met.distinct(), "met")  # a null stands for an entry that is too large
    keyed = met.where("other is null").select("fp", F.explode(F.transform(_masks(BITS, radius // 2), lambda m: F.col("fp").bitwiseXOR(m))).alias("key"))
    crowded = keyed.select("fp", F.min("fp").over(Window.partitionBy("key")).alias("other")).where("fp <> other")
    both = met.where("other is not null").unionByName(crowded)
    return both.select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = RADIUS, scratch: Scratch | None = None) -> DataFrame:
    """Columns doc_id, fp, component_id for every row of docs.

    component_id: the smallest doc_id that a chain of links of at most ``radius`` differing bits
    reaches. Null, empty and blank texts have fingerprint 0 and are linked like others; a very long
    text is counted piece by piece. Rows with equal doc_id are rows like others. A null doc_id belongs
    to its component but does not name it (the component of only such rows is null). Other columns
    are ignored. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(fingerprints(docs, size), "fingerprints")
    n = marked.count()  # at most so many nodes
    nodes = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("named")), "nodes", n)
    near = connected_components(links(nodes, radius, scratch=scratch), "a", "b", scratch=scratch).withColumnRenamed("node", "fp")
    placed = scratch.save(nodes.join(near, "fp", "left").select("fp", "named", F.coalesce("component", "fp").alias("c")), "grouped", n)
    placed = scratch.save(placed.join(placed.groupBy("c").agg(F.min("named").alias("component_id")), "c").select("fp", "component_id"), "placed", n)
    return marked.join(placed, "fp").select("doc_id", "fp", "component_id")


def similar_documents(texts: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, radius: int = RADIUS, scratch: Scratch | None = None) -> DataFrame:
    """Columns node, component of every node that a chain of pairs at ``similarity`` or more links to another.

    texts: node (a number that equal texts share and different ones do not) and text. Fingerprints over
    ``size`` words are linked by their tables, and each link is verified by the exact similarity of its
    texts. A radius cannot promise a similarity, so what the tables leave apart is searched by prefixes
    of shingles (``similar_texts``), which loses no pair. Nulls, long texts and empty tables as there.
    """
    scratch = scratch or Scratch(texts.sparkSession, "similar", FRUGAL)
    marked = fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), size)
    marked = scratch.save(marked.dropDuplicates(["doc_id"]), "fingerprints")
    nodes = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    equal = marked.join(nodes, "fp").select(F.col("doc_id").alias("x"), F.col("first").alias("y"))
    of = lambda c, name: nodes.select(F.col("fp").alias(c), F.col("first").alias(name))
    near = links(nodes.select("fp"), radius, scratch=scratch).join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    seeds = equal.unionByName(near).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return similar_texts(texts, size, similarity, scratch, seeds)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
