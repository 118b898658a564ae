"""Agreement between views: how many frames see two nodes, how many masks hold both, and which are linked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.scratch import Scratch

PERCENTILES = tuple(range(95, -1, -5))
#: Nodes of a shared value, or sets of frames, that are listed in one row, about.
BLOCK = 256
#: Nodes of a group of blocks that a task holds, about; groups of a scene at least, where it has so many blocks.
GROUP, GROUPS = 16_384, 24


def pair_counts(rows: DataFrame, node: str, shared: str, name: str, ordered: bool = False) -> DataFrame:
    """Columns seq, i, j, name: values of ``shared`` that nodes i < j have in common.

    rows: distinct (seq, node, shared). ordered: every pair in both orders, and each node with itself.
    The nodes of a value are listed in blocks, and each two blocks meet under a key of their own, so
    the pairs of a value that many nodes share are formed by many tasks.
    """
    held = rows.select("seq", F.col(node).alias("n"), F.col(shared).alias("_s"))
    many = held.groupBy("seq", "_s").agg(F.ceil(F.count("*") / BLOCK).alias("_k"))
    part = F.pmod(F.xxhash64("n"), F.col("_k")).alias("_p")
    blocks = held.join(many, ["seq", "_s"]).groupBy("seq", "_s", "_k", part).agg(F.collect_list("n").alias("_own"))
    a = blocks.withColumn("_q", F.explode(F.sequence(F.col("_p"), F.col("_k") - 1)))
    b = blocks.select("seq", "_s", F.col("_p").alias("_q"), F.col("_own").alias("_other"))
    two = (F.col("_p") < F.col("_q")).alias("_two")
    met = a.join(b, ["seq", "_s", "_q"]).select("seq", two, F.explode("_own").alias("x"), "_other").select("seq", "_two", "x", F.explode("_other").alias("y"))
    pairs = met.where(F.col("_two") | (F.col("x") < F.col("y"))).select("seq", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))
    counted = pairs.groupBy("seq", "i", "j").agg(F.count("*").alias(name))
    if not ordered:
        return counted
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("_p")
    itself = held.groupBy("seq", F.col("n").alias("i"), F.col("n").alias("j")).agg(F.count("*").alias(name))
    return counted.select("seq", both, name).select("seq", "_p.i", "_p.j", name).unionByName(itself)


def observers(visible: DataFrame, node: str = "gid", ordered: bool = False) -> DataFrame:
    """Columns seq, i, j, observers: frames that see both nodes i < j; ordered: both orders, and each node with itself.

    visible: distinct (seq, node, frame_id). Nodes with their frames are listed in blocks of one first frame,
    and blocks are dealt over groups. A task holds the blocks of one group at a time and passes those of
    another over them: two blocks that share a frame meet once, where the counts of their pairs are formed
    and leave as they are, so no pair is shuffled or sorted. A block is sent once for each group, not for
    each block that it meets.
    """
    place = (F.row_number().over(Window.partitionBy("seq").orderBy("frame_id")) - 1).cast("int").alias("at")
    places = visible.select("seq", "frame_id").distinct().select("seq", "frame_id", place)
    lists = visible.select("seq", F.col(node).alias("n"), "frame_id").join(places, ["seq", "frame_id"]).groupBy("seq", "n").agg(F.sort_array(F.collect_list("at")).alias("frames"))
    lists = Scratch(visible.sparkSession, "observers").save(lists.withColumn("first", F.col("frames")[0]), "lists")
    many = lists.groupBy("seq", "first").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    part = F.pmod(F.xxhash64("n"), F.col("k"))
    blocks = lists.join(many, ["seq", "first"]).groupBy("seq", F.struct("first", part.alias("part")).alias("p")).agg(F.sort_array(F.collect_list(F.struct("frames", "n"))).alias("own"))
    groups = F.greatest(F.ceil(F.count("*") / GROUP), F.least(F.lit(GROUPS), F.ceil(F.count("*") / BLOCK))).cast("int")
    dealt = blocks.join(lists.groupBy("seq").agg(groups.alias("groups")), "seq").withColumn("g", F.pmod(F.xxhash64("p"), "groups").cast("int"))
    left = dealt.select("seq", F.col("g").alias("x"), F.explode(F.sequence("g", F.col("groups") - 1)).alias("y"), F.lit(0).alias("side"), "p", "own")
    right = dealt.select("seq", F.explode(F.sequence(F.lit(0), "g")).alias("x"), F.col("g").alias("y"), F.lit(1).alias("side"), "p", "own")
    # tasks are not to be sized by what they read, a few bytes for each pair that they write
    both = left.unionByName(right).repartition(int(visible.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq", "x", "y").sortWithinPartitions("seq", "x", "y", "side")

    def counted(seq: pa.Scalar, left: pa.StructArray, right: pa.StructArray, same: bool) -> pa.RecordBatch:
        count = _meeting(left, right)
        a, b = (x.field("n").to_numpy(zero_copy_only=False) for x in (left, right))
        found = count > 0
        if same and not ordered:
            found &= a[:, None] < b[None, :]
        x, y = np.nonzero(found)
        i, j, k = a[x], b[y], count[x, y]
        if ordered and not same:
            i, j, k = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([k, k])
        elif not ordered:
            i, j = np.minimum(i, j), np.maximum(i, j)
        return pa.RecordBatch.from_arrays([pa.repeat(seq, len(i)), pa.array(i), pa.array(j), pa.array(k)], names=["seq", "i", "j", "observers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                seq, x, y, side, p = (batch.column(c)[at] for c in ("seq", "x", "y", "side", "p"))
                own, p, key = batch.column("own").slice(at, 1).flatten(), tuple(p.as_py().values()), (seq.as_py(), x.as_py(), y.as_py())
                frames = set(own.field("frames").flatten().to_pylist())
                if key != of:
                    of, held = key, []
                if side.as_py() == 0:
                    held.append((p, frames, own))
                    continue
                for q, seen, other in held:
                    if (x != y or q <= p) and not seen.isdisjoint(frames):
                        yield counted(seq, other, own, p == q)

    kinds = dict(visible.dtypes)
    return both.mapInArrow(run, f"seq {kinds['seq']}, i {kinds[node]}, j {kinds[node]}, observers long")


def supporters(contained: DataFrame, node: str = "gid", ordered: bool = False) -> DataFrame:
    """Masks that contain both nodes; a frame may count with several masks."""
    return pair_counts(contained, node, "by_gid", "supporters", ordered)


def frame_sets(visible: DataFrame) -> DataFrame:
    """Columns seq, frames, m: the different sets of frames, as places in the order of the scene's frames, and how many masks have each."""
    place = (F.row_number().over(Window.partitionBy("seq").orderBy("frame_id")) - 1).cast("int").alias("at")
    places = visible.select("seq", "frame_id").distinct().select("seq", "frame_id", place)
    each = visible.select("seq", "gid", "frame_id").join(places, ["seq", "frame_id"])
    return each.groupBy("seq", "gid").agg(F.sort_array(F.collect_list("at")).alias("frames")).groupBy("seq", "frames").agg(F.count("*").alias("m"))


def _meeting(left: pa.StructArray, right: pa.StructArray) -> np.ndarray:
    """How many frames each list of the left shares with each of the right."""
    lists = [x.field("frames") for x in (left, right)]
    values = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
    columns = np.unique(np.concatenate(values))

    def matrix(x: pa.ListArray, v: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(columns)), np.float32)
        out[np.repeat(np.arange(len(x)), x.value_lengths().to_numpy(zero_copy_only=False)), np.searchsorted(columns, v)] = 1
        return out

    return (matrix(lists[0], values[0]) @ matrix(lists[1], values[1]).T).astype(np.int64)


def _shared(left: pa.StructArray, right: pa.StructArray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, weights): how often sets of both lists share so many frames, weighted by the masks that have the sets."""
    shared = _meeting(left, right)
    m, n = (x.field("m").to_numpy(zero_copy_only=False) for x in (left, right))
    weights = np.bincount(shared.ravel(), (times * np.outer(m, n)).ravel())
    weights[0] = 0
    return np.flatnonzero(weights), weights[weights > 0].astype(np.int64)


def observer_histogram(visible: DataFrame) -> DataFrame:
    """Columns seq, o, w: ordered pairs of masks, each with itself included, that are seen together in o > 0 frames.

    Masks with the same frames count as one set with a weight. Sets of one first frame are listed in
    blocks; two blocks that share a frame meet once and give a row for each number of frames, so no
    row is written for a pair. Weights are exact below 2 ** 53 for each two blocks.
    """
    sets = frame_sets(visible).withColumn("first", F.col("frames")[0])
    many = sets.groupBy("seq", "first").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    part = F.pmod(F.xxhash64("frames"), F.col("k"))
    blocks = sets.join(many, ["seq", "first"]).groupBy("seq", F.struct("first", part.alias("part")).alias("p")).agg(F.collect_list(F.struct("frames", "m")).alias("own"))
    held = blocks.select("seq", "p", F.explode(F.array_distinct(F.flatten("own.frames"))).alias("at"))
    met = held.join(held.select("seq", F.col("p").alias("q"), "at"), ["seq", "at"]).where("p <= q").select("seq", "p", "q").distinct()
    both = met.join(blocks, ["seq", "p"]).join(blocks.select("seq", F.col("p").alias("q"), F.col("own").alias("other")), ["seq", "q"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n).slice(i, 1) for n in batch.schema.names}
                o, w = _shared(row["own"].flatten(), row["other"].flatten(), 1 if row["same"][0].as_py() else 2)
                yield pa.RecordBatch.from_arrays([pa.repeat(row["seq"][0], len(o)), pa.array(o, pa.int64()), pa.array(w, pa.int64())], names=["seq", "o", "w"])

    kind = dict(visible.dtypes)["seq"]
    each = both.select("seq", (F.col("p") == F.col("q")).alias("same"), "own", "other").mapInArrow(run, f"seq {kind}, o long, w long")
    return each.groupBy("seq", "o").agg(F.sum("w").alias("w"))


def thresholds(visible: DataFrame) -> DataFrame:
    """Columns seq, round, threshold: least observers of a link in each round, from many to few.

    They are the percentiles 95, 90, .. 0 of the observers over all ordered pairs of masks, each with
    itself included; from the median up they are at least 1, below it those of 1 or less end the list.
    """
    at = F.array(*(F.lit(p / 100) for p in PERCENTILES))
    lists = observer_histogram(visible).groupBy("seq").agg(F.percentile("o", at, F.col("w")).alias("values"))
    each = lists.select("seq", F.posexplode("values").alias("round", "v"))
    upper_half = F.col("round") < PERCENTILES.index(45)
    return each.where(upper_half | (F.col("v") > 1)).select("seq", "round", F.greatest("v", F.lit(1.0)).alias("threshold"))


def agreement(supporters_: Column, observers_: Column, least: float) -> Column:
    """True where supporters / observers reaches ``least`` in single precision, which decides equal shares."""
    rate = supporters_.cast("float") / (observers_.cast("float") + F.lit(1e-7).cast("float")).cast("float")
    return rate.cast("float") >= F.lit(least).cast("float")


def links(observed: DataFrame, supported: DataFrame, least: DataFrame, connect: float) -> DataFrame:
    """Columns seq, i, j: pairs with enough observers, of whose observers enough support them.

    least: seq, threshold.
    """
    both = observed.join(supported, ["seq", "i", "j"]).join(least.select("seq", "threshold"), "seq")
    return both.where((F.col("observers") >= F.col("threshold")) & agreement(F.col("supporters"), F.col("observers"), connect)).select("seq", "i", "j")


def agreeing(held: DataFrame, seen: DataFrame, connect: float, changed: DataFrame | None = None) -> DataFrame:
    """Columns seq, i, j, observers: pairs of nodes i < j enough of whose observers support them.

    held: distinct (seq, node, by_gid); seen: distinct (seq, node, frame_id). Observers are counted for
    pairs with a supporter alone, from both nodes' lists of frames. changed: distinct (seq, node); only
    pairs with one of these nodes are formed.
    """
    if changed is None:
        pairs = supporters(held, "node")
    else:
        new = held.join(changed.withColumn("new", F.lit(True)), ["seq", "node"], "left").select("seq", "by_gid", F.col("node").alias("y"), F.coalesce("new", F.lit(False)).alias("new"))
        mine = new.where("new").select("seq", "by_gid", F.col("y").alias("x"))
        met = mine.join(new, ["seq", "by_gid"]).where("x <> y AND (NOT new OR x < y)")
        pairs = met.groupBy("seq", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).agg(F.count("*").alias("supporters"))
    lists = seen.groupBy("seq", "node").agg(F.collect_list("frame_id").alias("frames"))
    of = lambda n, c: lists.select("seq", F.col("node").alias(n), F.col("frames").alias(c))
    both = pairs.join(of("i", "own"), ["seq", "i"]).join(of("j", "other"), ["seq", "j"])
    counted = both.select("seq", "i", "j", "supporters", F.size(F.array_intersect("own", "other")).alias("observers"))
    return counted.where((F.col("observers") > 0) & agreement(F.col("supporters"), F.col("observers"), connect)).select("seq", "i", "j", "observers")


def links_at(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Columns seq, i, j: agreeing pairs with enough observers. least: seq, threshold."""
    return pairs.join(least.select("seq", "threshold"), "seq").where(F.col("observers") >= F.col("threshold")).select("seq", "i", "j")
