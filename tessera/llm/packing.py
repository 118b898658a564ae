"""Best-fit packing of tokenised documents into sequences by the sum-of-squares rule.

Only lengths are packed: texts are tokenised where they are read, and a piece travels as five
numbers. A packer gets a bounded share of the pieces, longest first, and puts each into the open
sequence for which the sum of squared counts of open sequences per residual gap gets smallest.
A new sequence is opened only where no open one has room. Gaps are at most ``capacity``, so the
packer's state is one counter and one stack for each gap.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.plans.scratch import Scratch

#: Id of the token that ends every document.
END = 2
#: Pieces that one packer handles: about 4 s of its time and 20 MB.
SHARE = 500_000
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The token beyond the ranks.
ADDED = "<|endoftext|>"

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(vocabulary: str = VOCABULARY):
    """text -> ids of the byte-level BPE of ``byte_bpe_50k.json``, from the same vocabulary as ranks: equal ids, a fifth of the time.

    The vocabulary's added token is one id wherever a text spells it out, as ``tokenizers`` has it.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    added = {ADDED: len(ranks)}
    coder = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def ids(text: str) -> list[int]:
        return coder.encode(text, allowed_special="all") if ADDED in text else coder.encode_ordinary(text)

    return ids


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; all but the first are full."""
    first = (total - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def pieces(docs: DataFrame, capacity: int = 1024, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every row of docs (doc_id, text; null text: empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, rows = batch.slice(at, 1024), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), END], "<u4")
                    for k, (s, n) in enumerate(cut(len(ids), capacity)):
                        rows.append((doc, k, s, n, zlib.crc32(ids[s : s + n])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, which come longest first."""
    open_at = np.zeros(capacity + 1, np.int64)  # open sequences per residual gap; full ones are not open
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    seq, off, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    never = np.iinfo(np.int64).max
    for i, n in enumerate(lengths.tolist()):
        fits = open_at[n:capacity]
        gap = capacity
        if n < capacity and fits.any():
            # a sequence of gap g becomes one of gap g - n: the sum changes by 2 (count[g - n] - count[g]) + 2
            change = 2 * (open_at[: capacity - n] - fits) + 2
            change[0] = 1 - 2 * fits[0]  # a full sequence leaves the sum
            change[fits == 0] = never
            gap = n + int(change.argmin())
        if gap == capacity:
            k, made = made, made + 1
        else:
            k = stacks[gap].pop()
            open_at[gap] -= 1
        seq[i], off[i] = k, capacity - gap
        if gap > n:
            stacks[gap - n].append(k)
            open_at[gap - n] += 1
    return seq, off


def pack(docs: DataFrame, capacity: int = 1024, vocabulary: str = VOCABULARY, share: int = SHARE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of one token, the end. Equal rows are packed one by one. A
    null doc_id stays null. A very long text is cut like any other; only its numbers travel. Pieces
    of equal length are taken in order of doc_id, piece and row. Other columns are ignored. An empty
    table gives an empty result. More than ``share`` pieces are dealt over several packers by a hash
    of their number in the written table, so equal rows spread evenly and a packer that runs again
    gets the same pieces in the same order.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cuts = pieces(docs, capacity, vocabulary)
    names = [*cuts.columns, "sequence_id", "offset"]
    cuts = scratch.save(cuts.withColumn("row", F.monotonically_increasing_id()), "pieces")
    packers = max(1, ceil(cuts.count() / share))
    dealt = cuts.repartition(packers, F.xxhash64("row")).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        seq, off = sum_of_squares(rows["length"].to_numpy(), capacity)
        seq += TaskContext.get().partitionId() << 40
        for column, name in ((seq, "sequence_id"), (off, "offset")):
            rows = rows.append_column(name, pa.array(column))
        yield from rows.select(names).to_batches(max_chunksize=50_000)

    return dealt.mapInArrow(run, f"{PIECE}, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
