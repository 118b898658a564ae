"""In which frames a mask is seen whole, in which mask of those frames it is contained, and which masks cover two objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.incidence import interior, with_gid
from tessera.plans.config import Params
from tessera.plans.scratch import Scratch


def numbered(masks: DataFrame) -> DataFrame:
    """Columns seq, frame_id, mask_id, at: the mask's number, with the least one of its frame in the upper half."""
    first = F.min("gid").over(Window.partitionBy("seq", "frame_id")).cast("long")
    return masks.select("seq", "frame_id", "mask_id", F.shiftleft(first, 32).bitwiseOR(F.col("gid").cast("long")).alias("at"))


def mask_sets(inc: DataFrame, masks: DataFrame) -> DataFrame:
    """Columns seq, at, w: the different sets of masks that hold an interior point, and how many points have each.

    at: masks in order, each with the least mask of its frame in the upper half of the number. Points
    are counted in each frame first, so what meets for a point is at most one row of every frame.
    """
    held = with_gid(inc, numbered(masks)).groupBy("seq", "point_id", F.shiftright("at", 32).alias("frame")).agg(F.min("at").alias("at"), F.count("*").alias("c"))
    sets = held.groupBy("seq", "point_id").agg(F.max("c").alias("c"), F.sort_array(F.collect_list("at")).alias("at")).where("c = 1")
    return sets.groupBy("seq", "at").agg(F.count("*").alias("w"))


def hashed_sets(rows: DataFrame) -> DataFrame:
    """``mask_sets`` of points that are told apart by 128 bits. rows: seq, h1, h2 and the mask's ``at`` of ``numbered``; they may repeat.

    Rows are dealt once, by the point, after which its frames and its masks meet where they are.
    """
    names = ["seq", "h1", "h2"]
    held = rows.repartition("h1").groupBy(*names, F.shiftright("at", 32).alias("frame")).agg(F.min("at").alias("at"), F.max("at").alias("most"))
    sets = held.groupBy(*names).agg(F.max(F.col("at") < F.col("most")).alias("edge"), F.sort_array(F.collect_list("at")).alias("at")).where("NOT edge")
    return sets.groupBy("seq", "at").agg(F.count("*").alias("w"))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(seq, gid, n, group, at, k) of whole masks: rows (seq, gid, at, w) in the order of seq and gid, a mask's rows added up.

    seq, gid and n (its points) have a value for each mask, group, at and k one for each pair.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        seq, gid, w = batch.column("seq"), batch.column("gid").to_numpy(), batch.column("w").to_numpy()
        lists = batch.column("at")
        at, many = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        names = pa.concat_arrays([held[0], seq]) if held else seq
        code = names.dictionary_encode().indices.to_numpy()
        if held:
            gid, w = np.concatenate([held[1], gid]), np.concatenate([held[2], w])
        start = np.flatnonzero(np.r_[True, (gid[1:] != gid[:-1]) | (code[1:] != code[:-1])])
        n = np.add.reduceat(w, start)
        of = np.searchsorted(start, np.arange(len(gid)), "right") - 1
        row = np.repeat(of[1 if held else 0 :], many)
        k = np.repeat(batch.column("w").to_numpy(), many)
        if held:
            row, at, k = np.concatenate([np.zeros(len(held[3]), row.dtype), row]), np.concatenate([held[3], at]), np.concatenate([held[4], k])
        order = np.lexsort((at, row))
        row, at, k = row[order], at[order], k[order]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1])])
        row, at, k = row[new], at[new], np.add.reduceat(k, new)
        last = len(start) - 1
        cut = np.searchsorted(row, last)
        held = (names.take(pa.array(start[-1:])), gid[start[-1:]], n[-1:], at[cut:], k[cut:])
        if last:
            yield names.take(pa.array(start[:-1])), gid[start[:-1]], n[:-1], row[:cut], at[:cut], k[:cut]
    if held:
        yield held[0], held[1], held[2], np.zeros(len(held[3]), np.int64), held[3], held[4]


def _by_mask(sets: DataFrame) -> DataFrame:
    """Rows seq, gid, at, w of ``mask_sets``: each mask with the sets it is in, a mask's rows side by side.

    What is dealt is a set for each of its masks, not a row for each pair; pairs are counted where they arrive.
    """
    one = sets.select("seq", F.explode("at").alias("own"), "at", "w")
    one = one.select("seq", F.col("own").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("gid"), "at", "w")
    return one.repartition("seq", "gid").sortWithinPartitions("seq", "gid")


def overlaps(inc: DataFrame, masks: DataFrame) -> DataFrame:
    """Columns seq, gid, frame_id, by_gid, k: interior points that mask gid shares with mask by_gid of a frame."""
    return overlaps_of_sets(mask_sets(inc, masks), masks)


def overlaps_of_sets(sets: DataFrame, masks: DataFrame) -> DataFrame:
    """``overlaps`` of points whose sets of masks are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, gid, _, row, at, k in _pairs(batches):
            columns = [seq.take(pa.array(row)), pa.array(gid[row]), pa.array((at & (2**32 - 1)).astype(np.int32)), pa.array(k)]
            yield pa.RecordBatch.from_arrays(columns, names=["seq", "gid", "by_gid", "k"])

    pairs = _by_mask(sets).mapInArrow(run, f"seq {dict(sets.dtypes)['seq']}, gid int, by_gid int, k long")
    frame_of = masks.select("seq", F.col("gid").alias("by_gid"), "frame_id")
    return pairs.join(frame_of, ["seq", "by_gid"]).select("seq", "gid", "frame_id", "by_gid", "k")


def visible_masks(inc: DataFrame, masks: DataFrame, p: Params) -> DataFrame:
    """``visibility`` of all overlaps, decided where a mask's sets meet, so no row leaves there for a pair or for a frame that does not see the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, gid, n, row, at, k in _pairs(batches):
            frame = at >> 32
            start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (frame[1:] != frame[:-1])])
            of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(at)]))
            best = np.lexsort((at, -k, of))[start]  # most points, then the lowest number
            row, seen, k, by = row[start], np.add.reduceat(k, start), k[best], (at[best] & (2**32 - 1)).astype(np.int32)
            share = 1.0 - (n[row] - seen) / n[row]
            stay = ~((share < p.mask_visible_threshold) & (seen < p.visible_points))
            row = row[stay]
            columns = [seq.take(pa.array(row)), pa.array(gid[row]), pa.array(seen[stay]), pa.array(n[row]), pa.array(by[stay]), pa.array(k[stay])]
            yield pa.RecordBatch.from_arrays(columns, names=["seq", "gid", "seen", "n", "best", "k"])

    found = _by_mask(mask_sets(inc, masks)).mapInArrow(run, f"seq {dict(inc.dtypes)['seq']}, gid int, seen long, n long, best int, k long")
    frame_of = masks.select("seq", F.col("gid").alias("best"), "frame_id")
    return found.join(frame_of, ["seq", "best"]).select("seq", "gid", "frame_id", "seen", "n", "best", "k")


def sizes(inc: DataFrame, masks: DataFrame) -> DataFrame:
    """Columns seq, gid, n: interior points of every mask, 0 for masks of boundary points alone."""
    counts = with_gid(interior(inc), masks).groupBy("seq", "gid").agg(F.count("*").alias("n"))
    return masks.select("seq", "gid").join(counts, ["seq", "gid"], "left").select("seq", "gid", F.coalesce("n", F.lit(0)).alias("n"))


def visibility(overlap: DataFrame, size: DataFrame, p: Params) -> DataFrame:
    """Columns seq, gid, frame_id, seen, n, best, k: frames where each mask is visible, and its main mask there.

    A mask is hidden in a frame where fewer than its share of points and fewer than visible_points
    appear. best: the mask with most of the visible points, the lowest number of equal ones.
    """
    frames = overlap.groupBy("seq", "gid", "frame_id").agg(
        F.sum("k").alias("seen"), F.max("k").alias("k"), F.max_by("by_gid", F.struct("k", -F.col("by_gid"))).alias("best")
    )
    share: Column = F.lit(1.0) - (F.col("n") - F.col("seen")) / F.col("n")
    hidden = (share < p.mask_visible_threshold) & (F.col("seen") < p.visible_points)
    return frames.join(size, ["seq", "gid"]).where(~hidden).select("seq", "gid", "frame_id", "seen", "n", "best", "k")


def contained_once(visible: DataFrame, p: Params) -> DataFrame:
    """Columns seq, gid, by_gid: the mask that holds nearly all of what is visible of gid in a frame."""
    return visible.where(F.col("k") / F.col("seen") > p.contained_threshold).select("seq", "gid", F.col("best").alias("by_gid"))


def validity(visible: DataFrame, masks: DataFrame, p: Params) -> DataFrame:
    """Columns seq, gid, visible_num, split_num, valid for every mask.

    A mask that falls apart in too large a share of the frames that see it covers several objects.
    """
    split = ~(F.col("k") / F.col("seen") > p.contained_threshold)
    counts = visible.groupBy("seq", "gid").agg(F.count("*").alias("visible_num"), F.count_if(split).alias("split_num"))
    all_masks = masks.select("seq", "gid").join(counts, ["seq", "gid"], "left").fillna(0, ["visible_num", "split_num"])
    valid = (F.col("visible_num") > 0) & ~(F.try_divide("split_num", "visible_num") > p.undersegment_filter_threshold)
    return all_masks.select("seq", "gid", "visible_num", "split_num", F.coalesce(valid, F.lit(False)).alias("valid"))


def without_invalid(contained: DataFrame, valid: DataFrame) -> DataFrame:
    """contained without the rows whose container covers several objects; other rows of such masks stay."""
    bad = valid.where("not valid").select("seq", F.col("gid").alias("by_gid"))
    return contained.join(bad, ["seq", "by_gid"], "left_anti").select("seq", "gid", "by_gid")


def containment(inc: DataFrame, masks: DataFrame, p: Params, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(contained, validity) of all masks. scratch: where what both are read off is kept, so that points meet once."""
    seen = visible_masks(inc, masks, p)
    if scratch:
        seen = scratch.save(seen, "seen")
    valid = validity(seen, masks, p)
    return without_invalid(contained_once(seen, p), valid), valid


def visible_frames(contained: DataFrame, masks: DataFrame) -> DataFrame:
    """Columns seq, gid, frame_id: a mask counts as visible where it is contained in some mask."""
    frame_of = masks.select("seq", F.col("gid").alias("by_gid"), "frame_id")
    return contained.join(frame_of, ["seq", "by_gid"]).select("seq", "gid", "frame_id").distinct()
