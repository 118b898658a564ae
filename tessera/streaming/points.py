"""What a stream of incidences says of each point, kept up to date: boundary points, and how many points masks share.

A point's state is the least and the greatest mask that hold it in each frame; where they differ, it is a
boundary point, and where no frame has two, they are all its masks. So a state has a fixed size, and whatever
changes it is appended to a table as it is then; the present state is the least and the greatest of these rows.
No row is too late: the order of arrival, how the stream is cut into batches and rows written again by a batch
that is repeated change the table, not what is read from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME = ["seq", "point_id", "frame_id"]


def follow(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the changes that a stream of incidences (seq, frame_id, mask_id, point_id) makes to Parquet below ``path``.

    Rows may come again, in any order and at any time; rows with a null are ignored. Frames and masks
    are numbers or texts. A point has a state of two masks for each frame that sees it.
    """
    stream.sparkSession.conf.set(STORE, ROCKS)
    rows = stream.select(*FRAME, "mask_id").dropna()
    states = rows.groupBy(*FRAME).agg(F.min("mask_id").alias("least"), F.max("mask_id").alias("most"))
    write = lambda batch, _: batch.write.mode("append").parquet(path)
    return states.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def present(changes: DataFrame) -> DataFrame:
    """Columns seq, point_id, frame_id, least, most: the state of each point now."""
    return changes.groupBy(*FRAME).agg(F.min("least").alias("least"), F.max("most").alias("most"))


def boundary(changes: DataFrame) -> DataFrame:
    """Columns seq, point_id: points that two masks of one frame hold."""
    return present(changes).where("least <> most").select("seq", "point_id").distinct()


def overlaps(changes: DataFrame) -> DataFrame:
    """Columns seq, frame_a, mask_a, frame_b, mask_b, k: points, boundary points aside, that each two masks share, in both orders; each mask with itself."""
    # points with the same masks are counted first; a point that is no boundary point has one of each frame at most
    mask = F.struct(F.col("frame_id").alias("frame"), F.col("least").alias("mask"))
    held = present(changes).groupBy("seq", "point_id").agg(F.max(F.col("least") != F.col("most")).alias("edge"), F.sort_array(F.collect_list(mask)).alias("held"))
    sets = held.where("NOT edge").groupBy("seq", "held").agg(F.count("*").alias("w"))
    pairs = sets.select("seq", F.explode("held").alias("a"), "held", "w").select("seq", "a", F.explode("held").alias("b"), "w")
    sums = pairs.groupBy("seq", "a", "b").agg(F.sum("w").alias("k"))
    return sums.select("seq", *(F.col(f"{c}.{n}").alias(f"{n}_{c}") for c in "ab" for n in ("frame", "mask")), "k")
