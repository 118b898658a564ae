"""Writers of results. Tables go to Parquet by scene; text layouts are for tools that expect them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_scenes(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table (predictions, objects, features, pixels) as Parquet in a folder per scene; also an empty one. Only scenes of df are replaced."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("seq").parquet(path)


def remove_scenes(spark: SparkSession, path: str, seqs: list[str]) -> int:
    """Removes the folders of some scenes that ``write_scenes`` or ``write_gt_text`` wrote; gives how many there were."""
    jvm, n = spark.sparkContext._jvm, 0
    for seq in seqs:
        at = jvm.org.apache.hadoop.fs.Path(path, f"seq={jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(seq))}")
        n += at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return n


def write_files(files: DataFrame, root: str) -> int:
    """Writes each row of files (name, content) as one file below root, on the executors; gives their number.

    root: a folder that all executors share, as a path or an address that Arrow knows. A task that
    runs again writes the same files again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, top = FileSystem.from_uri(root)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                fs.create_dir(f"{top}/{name}".rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(f"{top}/{name}") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select(F.col("name").cast("string"), F.col("content").cast("binary")).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def copy_files(spark, pattern: str, root: str) -> int:
    """Copies the files of a glob below root under their own names."""
    found = spark.read.format("binaryFile").load(pattern).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return write_files(found, root)


def predictions(objects: DataFrame, classes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, meta) of objects: every score is 1; classes (seq, object_id, class_id) where they are known, else 0."""
    pred = objects.select("seq", F.col("object_id").alias("inst"), F.explode("point_ids").alias("point_id"))
    meta = objects.select("seq", "object_id")
    if classes is not None:
        meta = meta.join(classes, ["seq", "object_id"], "left")
    else:
        meta = meta.withColumn("class_id", F.lit(0))
    return pred, meta.select("seq", F.col("object_id").alias("inst"), F.coalesce("class_id", F.lit(0)).cast("int").alias("class_id"), F.lit(1.0).alias("score"))


def write_gt_text(gt: DataFrame, path: str) -> None:
    """One number a line in the order of the points, in a folder per scene; each scene is one file."""
    lines = gt.repartition("seq").sortWithinPartitions("seq", "point_id").select("seq", F.col("gt_id").cast("string").alias("value"))
    lines.write.mode("overwrite").partitionBy("seq").text(path)


def ap_rows(summary: DataFrame) -> DataFrame:
    """The rows of the score table in order: classes by name, then the averages with an empty class."""
    return summary.select("class", F.col("class_id").alias("class id"), "ap", "ap50", "ap25").orderBy(F.col("class") == "", "class")


def write_ap_csv(summary: DataFrame, path: str) -> None:
    ap_rows(summary).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def ap_text(summary: DataFrame) -> str:
    """The score table as aligned text, without classes that have no instances; at most a vocabulary's rows."""
    rows = [r for r in ap_rows(summary).collect() if r["ap"] is not None and r["ap"] == r["ap"]]
    out = ["{:<24}{:>12}{:>12}{:>12}".format("what", "AP", "AP_50%", "AP_25%")]
    out += ["{:<24}{:>12.3f}{:>12.3f}{:>12.3f}".format(r["class"] or "average", r["ap"], r["ap50"], r["ap25"]) for r in rows]
    return "\n".join(out)
