"""Plain tables read as incidences, scenes, features, ground truth and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.incidence import incidence


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_number(source: F.Column) -> F.Column:
    return F.regexp_extract(source, r"(\d+)", 1).cast("int")


def docs_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as masks of their source's frame, lines of text as points."""
    docs = table(spark, sf_dir, "documents").select(source_number(F.col("source")).alias("f"), "doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return incidence(docs, "docs", F.col("f"), F.col("doc_id"), F.col("line"))


def line_point(line: F.Column) -> F.Column:
    """A line as a point of fixed size: 128 bits and its length tell lines apart."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"), F.char_length(line).alias("n"))


def docs_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs_lines`` with ``line_point`` in place of each line, so that no text is shuffled."""
    docs = table(spark, sf_dir, "documents").select(source_number(F.col("source")).alias("f"), "doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return incidence(docs, "docs", F.col("f"), F.col("doc_id"), line_point(F.col("line")))


def lines_of(spark: SparkSession, sf_dir: str, masks: DataFrame) -> DataFrame:
    """Columns point, line: a row for each different line of the documents in masks (frame_id, mask_id)."""
    docs = table(spark, sf_dir, "documents").select(source_number(F.col("source")).alias("frame_id"), F.col("doc_id").alias("mask_id"), "text")
    lines = docs.join(masks, ["frame_id", "mask_id"], "left_semi").select(F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.select(line_point(F.col("line")).alias("point"), "line").groupBy("point").agg(F.first("line").alias("line"))


def docs_words(spark: SparkSession, sf_dir: str, least: int = 5) -> DataFrame:
    """Columns seq, frame_id, mask_id, w: the words of documents with so many, as masks of their source's frame."""
    docs = table(spark, sf_dir, "documents").select(F.lit("docs").alias("seq"), source_number(F.col("source")).alias("frame_id"), F.col("doc_id").alias("mask_id"), F.split("text", " ").alias("w"))
    return docs.dropna().where(F.size("w") >= least)


def shingle_hashes(words: DataFrame, size: int = 5) -> DataFrame:
    """words (w and others) with a row for each run of words, repeats included: its hashes by two seeds, h1 and h2, in place of w."""
    others = [c for c in words.columns if c != "w"]
    each = words.select(*others, "w", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("i"))
    s = F.array_join(F.slice("w", F.col("i"), size), " ")
    return each.select(*others, F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), s).alias("h2"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as frames, line numbers as masks, parts as points."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_partkey")
    return incidence(rows, "lineitem", F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_partkey"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as frames, event types as masks, users as points."""
    rows = table(spark, sf_dir, "events")
    return incidence(rows, "events", F.to_date("ts"), F.col("event_type"), F.col("user_id"))


def vectors_as_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns seq, point_id, x, y, z, label: the first three dimensions of each embedding."""
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        F.lit("vec").alias("seq"), F.col("vec_id").alias("point_id"), *(e[i].cast("double").alias(c) for i, c in enumerate("xyz")), "label"
    )


def label_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns idx, label, v: the first embedding of each label as its text feature."""
    first = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v"))
    return first.select(F.col("label").alias("idx"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("label"), "v")


def nation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns idx, label, label_id: regions as classes."""
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("idx"), F.col("r_name").alias("label"), (F.col("r_regionkey") + 1).alias("label_id"))


def orders_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"))
    return o.join(c, "o_custkey").join(n, "nation")


def nations_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns seq, point_id, gt_id: orders labelled by region and nation."""
    return orders_of_nations(spark, sf_dir).select(
        F.lit("orders").alias("seq"), F.col("o_orderkey").alias("point_id"), ((F.col("region") + 1) * 1000 + F.col("nation") + 1).cast("int").alias("gt_id")
    )


def nations_pred(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(points, meta) of predictions: a nation's orders without those of its first few priorities; fewer are right the more are left out."""
    rows = orders_of_nations(spark, sf_dir).where(F.col("priority") > F.col("nation") % 5)
    pred = rows.select(F.lit("orders").alias("seq"), F.col("nation").alias("inst"), F.col("o_orderkey").alias("point_id"))
    n = table(spark, sf_dir, "nation")
    meta = n.select(F.lit("orders").alias("seq"), F.col("n_nationkey").alias("inst"), (F.col("n_regionkey") + 1).alias("class_id"), (1.0 / (1 + F.col("n_nationkey") % 3)).alias("score"))
    return pred, meta
