"""Line dedup with built-in functions only.

Hashes of line keys are counted per document, range-partitioned by hash with a secondary sort by
document, and streamed: the first row of a hash names the document that keeps the line. The result
per document is a sparse bitmap of dropped lines, not text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, ascii_lower, table
from tessera.plans.scratch import Scratch

#: A hash has at most so many rows when it is range-partitioned.
PIECES = 32


def split_lines(text):
    """Lines of a text at \\n; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """Columns doc_id, text_key, dropped: bitmaps of the lines that each document loses.

    docs: doc_id and text; other columns are ignored. A line's key is the line without white space
    at its ends, in lower case A-Z. Keys of min_chars code points or more that are found in min_docs
    documents or more lose all their lines except in the largest doc_id that holds them.
    dropped: array of (word, bits); bit b of word w stands for line 64 w + b; words without a dropped
    line are absent, and so are documents that lose nothing. text_key tells apart rows of equal
    doc_id. Rows with a null doc_id neither count nor lose lines; equal rows lose the same lines.
    Keys are compared by two 64-bit hashes of different seeds. A very long text is split whole, into as
    many rows as it has lines; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    lines = docs.where("doc_id is not null").select(
        "doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")
    )
    key = ascii_lower(F.btrim("line", F.lit(SPACE)))
    found = lines.where(F.char_length(key) >= min_chars).select(
        "doc_id", "text_key", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")
    )
    found = scratch.save(found, "lines")  # texts are split and hashed once
    # one row per hash and document, then at most PIECES rows per hash, each the sum of many documents
    pieces = (
        found.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(PIECES)).alias("piece"))
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    )
    of_hash = Window.partitionBy("h1", "h2")
    streamed = pieces.repartitionByRange("h1", "h2").select(
        "h1", "h2", "last", F.row_number().over(of_hash.orderBy(F.desc("last"), "piece")).alias("nth"), F.sum("n").over(of_hash).alias("n_docs")
    )
    repeated = scratch.save(streamed.where((F.col("nth") == 1) & (F.col("n_docs") >= min_docs)).select("h1", "h2", "last"), "repeated")
    lost = found.join(repeated, ["h1", "h2"]).where(F.col("doc_id") != F.col("last"))
    words = lost.groupBy("doc_id", "text_key", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)).alias("bits")
    )
    return words.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def with_lines_dropped(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """All rows and columns of docs + n_lines, n_dropped and kept, the text of the kept lines.

    Columns of docs named n_lines, n_dropped, kept or starting with an underscore are replaced.
    """
    docs = docs.select([c for c in docs.columns if c not in ("n_lines", "n_dropped", "kept") and not c.startswith("_")])
    marks = bitmaps.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("dropped").alias("_dropped"))
    key = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    joined = docs.join(marks, key, "left").withColumn("_lines", split_lines(F.col("text")))
    # the words up to the last one that is not zero, so that each line finds its bit in constant time
    zero = F.lit(0).cast("long")
    dense = F.aggregate(
        "_dropped", F.array().cast("array<bigint>"), lambda upto, x: F.concat(upto, F.array_repeat(zero, x["word"] - F.size(upto)), F.array(x["bits"]))
    )
    joined = joined.withColumn("_dense", dense)
    kept = F.filter("_lines", lambda _, i: F.getbit(F.coalesce(F.get("_dense", F.shiftright(i, 6)), zero), i % 64) == 0)
    joined = joined.withColumn("_kept", F.when(F.col("_dense").isNull(), F.col("_lines")).otherwise(kept))
    return joined.select(
        *docs.columns,
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.array_join("_kept", "\n").alias("kept"),
    )


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with repeated lines dropped: all columns + n_lines, n_dropped, kept. Nulls, long texts, repeated rows and empty tables as in ``line_bitmaps``."""
    return with_lines_dropped(docs, line_bitmaps(docs, min_chars, min_docs))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS pos FROM d),
k AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND k.doc_id <> r.last AS lost FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
