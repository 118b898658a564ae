"""A cleaning pipeline over ``documents``: each stage works on all that the one before it kept.

Every stage takes an empty table to an empty table, handles very long texts whole, and keeps the
columns of documents, whatever their names; rows with a null id or text are said of where they matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, lines, packing, simhash
from tessera.llm.common import held_out, table
from tessera.llm.similar import FRUGAL
from tessera.plans.scratch import Scratch


def frugal(spark: SparkSession) -> None:
    """Settings of a session that runs the stages: batches of texts and partitions that leave room on small executors."""
    for k, v in FRUGAL.items():
        spark.conf.set(k, v)


def carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one struct ``rest``, so that their names cannot clash with an operator's."""
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*(F.col(f"`{c}`") for c in other)) if other else F.struct(F.lit(0))).alias("rest"))


def restored(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs from carried rows, with some of them changed."""
    return found.select(*(changed.get(c, F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those that language ID rejects go. All rows of the rest stay, nulls in other columns included."""
    frugal(spark)
    learned = langid.fit(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id"), 5))
    return restored(langid.detect(carried(docs), learned).where(~F.col("rejected")), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; all documents stay, and n_chars follows the text."""
    frugal(spark)
    found = lines.line_dedup(carried(docs))
    return restored(found, docs, text=F.col("kept"), n_chars=F.char_length("kept").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) one row of the smallest doc_id; rows without an id stay."""
    frugal(spark)
    rows = carried(docs).withColumn("node", F.xxhash64("text"))
    groups = simhash.similar_documents(rows.select("node", "text"))
    named = rows.where("doc_id is not null")
    group = F.coalesce("component", "node").alias("component")
    placed = named.select("doc_id", "node").join(groups, "node", "left").select("doc_id", "node", group)
    first = placed.groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("first")).select("first.*")
    nth = F.row_number().over(Window.partitionBy("doc_id", "node").orderBy(F.lit(0)))
    kept = named.join(first, ["doc_id", "node"], "left_semi").withColumn("nth", nth).where("nth = 1").drop("nth")
    return restored(kept.unionByName(rows.where("doc_id is null")), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    frugal(spark)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    found = found.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    rows = carried(docs)
    return restored(rows.join(found, rows["doc_id"].eqNullSafe(found["id"]) & (F.xxhash64(rows["text"]) == found["key"]), "left_anti"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    frugal(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed),
]

#: Compression, tokenisation and packing are beyond SQL; the tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return after
        after = scratch.save(after, f"stage{n}")
        if n:
            scratch.drop(docs)
        docs = after
    return docs
