"""What the operators of this subpackage share: words, tables, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that separate words: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def lowered_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; null and blank texts have none."""
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + SPACE[1:], LOWER + " " * len(SPACE[1:]))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def raw_words(text: bytes | None) -> list[bytes]:
    """The same words as UTF-8: bytes.split() separates at exactly these six characters."""
    return text.split() if text else []


def held_out(doc_id: Column, mod: int) -> Column:
    """True where crc32 of the id as text leaves no remainder; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == 0


def per_row(make: Callable[[], Callable[..., tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies make()(*columns of a row) and gives rows of ``schema``.

    make runs once a task; a batch is turned into Python values in slices, so that a batch of
    very long texts is never held twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                cols = [c.to_pylist() for c in batch.slice(at, 512).columns]
                out = [f(*row) for row in zip(*cols)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return run
