"""Language-model scores from the lattice of all segmentations of words into subword pieces.

The pieces are those of an existing vocabulary; their unigram weights are relative frequencies in
the training texts, each word counted as the vocabulary's own tokenizer segments it. A word's
probability is the sum over all its segmentations, by a forward recursion in log space; a document's
is the product over its words and its end.

Both the weights and the words' probabilities are worked out once for each different word of the
corpus. Documents then need the counts of their words: those of the most frequent words, a bounded
number, go to every task; the words beyond it are joined, and their sums are added to the rest.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import held_out, raw_words, table
from tessera.plans.scratch import Scratch

#: Words whose figures go to every task: some 30 MB of Python memory.
FREQUENT = 150_000
#: Different words that a task counts before it passes the counts on.
FLUSH = 300_000
#: Added to every count of the base model, and to the count of every piece.
SMOOTH = 0.1
#: Characters of a word, with its space, up to which plain probabilities are tried, and the least sum that they are kept for.
SHORT = 64
LEAST = 1e-250
VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"


class Lattice:
    """Forward recursion over the pieces of a vocabulary with given counts.

    pieces: (piece, kind); kind is "text" for pieces that stand for themselves, "byte" for the byte
    pieces ``<0x..>``, and anything else for pieces (control, unknown, unused) that no text spells:
    the tokenizer never takes their names in a text for them, and neither does the lattice.
    """

    def __init__(self, pieces: list[tuple[str, str]], counts: dict[int, int]):
        own = [(i, p, kind) for i, (p, kind) in enumerate(pieces) if kind in ("text", "byte")]
        total = sum(counts.get(i, 0) for i, _, _ in own) + SMOOTH * len(own) or 1.0
        weight = lambda i: math.log((counts.get(i, 0) + SMOOTH) / total)
        self.log = {p: weight(i) for i, p, kind in own if kind == "text"}
        bytes_at = {p: weight(i) for i, p, kind in own if kind == "byte"}
        self.bytes = [bytes_at.get(f"<0x{b:02X}>", -math.log(total + 1)) for b in range(256)]
        self.longest = max(map(len, self.log), default=1)
        # as plain probabilities; a beginning of pieces that is none itself has 0, anything else is absent and ends the look-up
        self.plain = {p[:n]: 0.0 for p in self.log for n in range(1, len(p))} | {p: math.exp(w) for p, w in self.log.items()}
        self.spelt: dict[str, float] = {}

    def word(self, word: str) -> float:
        """Natural log of the summed probability of all segmentations of a word and the space before it.

        Each character can also be spelt as its UTF-8 bytes, so that every word has a probability.
        Sums are of plain probabilities where they are far from the least double, else in log space.
        """
        s = SPACE + word
        if len(s) <= SHORT:
            get, spelt, end = self.plain.get, self.spelt, len(s) + 1
            alpha = [1.0] + [0.0] * len(s)
            for i, char in enumerate(s):
                a = alpha[i]
                if char not in spelt:
                    spelt[char] = math.exp(self.bytes_of(char))
                alpha[i + 1] += a * spelt[char]
                for j in range(i + 1, end):
                    if (p := get(s[i:j])) is None:
                        break
                    alpha[j] += a * p
            if alpha[-1] > LEAST:
                return math.log(alpha[-1])
        return self.long_word(s)

    def bytes_of(self, char: str) -> float:
        return sum(self.bytes[b] for b in char.encode("utf-8", "replace"))

    def long_word(self, s: str) -> float:
        """``word`` in log space, of a word with the space before it."""
        get, longest, exp, log = self.log.get, self.longest, math.exp, math.log
        alpha = [0.0]
        for j in range(1, len(s) + 1):
            terms = [a + p for i, a in enumerate(alpha[max(0, j - longest) :], max(0, j - longest)) if (p := get(s[i:j])) is not None]
            terms.append(alpha[-1] + self.bytes_of(s[j - 1]))
            top = max(terms)
            alpha.append(top + log(sum(exp(t - top) for t in terms)))
        return alpha[-1]


def processor(vocabulary: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))


def kinds_of(proc) -> list[tuple[str, str]]:
    """(piece, kind) of all pieces of a vocabulary, as ``Lattice`` takes them."""

    def kind(i: int) -> str:
        return "byte" if proc.is_byte(i) else "none" if proc.is_control(i) or proc.is_unknown(i) or proc.is_unused(i) else "text"

    return [(proc.id_to_piece(i), kind(i)) for i in range(proc.get_piece_size())]


def count_words(docs: DataFrame) -> DataFrame:
    """Columns word (UTF-8), c (times in training texts), n (times in all), over docs (text, away)."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter = Counter()
        rest: Counter = Counter()

        def flush():
            rows = [(w, c, c + rest.pop(w, 0)) for w, c in train.items()] + [(w, 0, n) for w, n in rest.items()]
            train.clear()
            rest.clear()
            for at in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 20_000]), schema.types)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text, away in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    (rest if away else train).update(raw_words(text.lower() if text else text))
                if len(train) + len(rest) > FLUSH:
                    yield from flush()
        yield from flush()

    # counted before the exchange already; as many tasks as partitions, since each word's lattice is worked out there
    counted = docs.select(F.col("text").cast("binary"), "away").mapInArrow(run, "word binary, c long, n long")
    dealt = counted.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    return dealt.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def piece_counts(words: DataFrame, vocabulary: str) -> dict[int, int]:
    """Times that each piece occurs in the training texts; at most as many rows as pieces are collected."""
    schema = pa.schema([("piece", pa.int32()), ("k", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = processor(vocabulary).encode, Counter()
        for batch in batches:
            texts = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            for ids, c in zip(encode(texts, num_threads=1), batch.column(1).to_pylist()):
                for i in ids:
                    counts[i] += c
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip((counts.keys(), counts.values()), schema.types)], schema=schema)

    found = words.where("c > 0").select("word", "c").mapInArrow(run, "piece int, k long").groupBy("piece").agg(F.sum("k").alias("k"))
    return {r["piece"]: r["k"] for r in found.collect()}


def score(docs: DataFrame, away: F.Column, vocabulary: str = VOCABULARY, frequent: int = FREQUENT, scratch: Scratch | None = None) -> DataFrame:
    """Columns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    docs: doc_id, text; other columns may feed ``away``, which is true for texts that take no part in
    the training. Tokens are the words of the text with A-Z lowered and one end; a null text has the
    end alone. base_score: log10 of the unigram model over tokens with SMOOTH added to each count.
    score: log10 of the text's probability, each token being the end with the end's share of the
    training tokens (a half without any) and else a word with its lattice probability. Equal rows
    are scored each; a null doc_id stays null. A very long text is counted word by word, and a very
    long word has a lattice like any other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lm")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(away, F.lit(False)).alias("away"))
    counted = scratch.save(count_words(docs), "words")
    weights = piece_counts(counted, vocabulary)
    proc = processor(vocabulary)
    pieces = kinds_of(proc)
    shared = spark.sparkContext.broadcast((pieces, weights))  # as large as the vocabulary

    def lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = Lattice(*shared.value).word
        for batch in batches:
            found = [word(w.decode("utf-8", "replace")) / math.log(10) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=["word", "c", "n", "p"])

    words = scratch.save(counted.mapInArrow(lattice, "word binary, c long, n long, p double"), "scored")
    scratch.drop(counted)
    total = words.agg(F.sum("c").alias("tokens"), F.count_if(F.col("c") > 0).alias("kinds")).first()
    ends = docs.where("not away").count()
    tokens = (total["tokens"] or 0) + ends
    kinds = total["kinds"] + (ends > 0)
    below = math.log10(tokens + SMOOTH * (kinds + 1))
    end_share = ends / tokens if tokens else 0.5
    end_base, end_score = math.log10(ends + SMOOTH) - below, math.log10(end_share)
    inner = math.log10(1 - end_share) if end_share < 1 else 0.0

    # words by sixteenths of the power of two of their count: at most 1024 rows tell how far down the bound reaches
    band = F.floor(F.log2("n") * 16).cast("int")
    room, lowest = frequent, 1 << 30
    for r in words.groupBy(band.alias("band")).count().orderBy(F.desc("band")).collect():
        room -= r["count"]
        if room < 0:
            break
        lowest = r["band"]
    top = {r["word"]: (int(r["c"] > 0), math.log10(r["c"] + SMOOTH) - below, r["p"] + inner) for r in words.where(band >= lowest).collect()}
    known = spark.sparkContext.broadcast({bytes(w): v for w, v in top.items()})  # at most ``frequent`` words
    schema = pa.schema(
        [("doc_id", pa.int64()), ("away", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
         ("rare", pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int32())])))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc_id, text, is_away in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    found = raw_words(text.lower() if text else text)
                    n, base, total_score, rare = int(ends > 0), end_base, end_score, []
                    for w, k in Counter(found).items():
                        if v := get(w):
                            n += k * v[0]
                            base += k * v[1]
                            total_score += k * v[2]
                        else:
                            rare.append({"word": w, "k": k})
                    out.append((doc_id, is_away, len(found) + 1, n, base, total_score, rare))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    part = docs.mapInArrow(run, "doc_id long, away boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word: binary, k: int>>")
    part = scratch.save(part.withColumn("row", F.monotonically_increasing_id()), "documents")
    rare = part.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    met = rare.join(words.select("word", "c", "p"), "word")
    more = met.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).cast("long").alias("known2"),
        F.sum(F.col("k") * (F.log10(F.col("c") + F.lit(SMOOTH)) - F.lit(below))).alias("base2"),
        F.sum(F.col("k") * (F.col("p") + F.lit(inner))).alias("score2"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return part.drop("rare").join(more, "row", "left").select(
        "doc_id",
        F.col("away").alias("held_out"),
        "n_tokens",
        (F.col("n_known") + zero("known2")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base2")).alias("base_score"),
        (F.col("score") + zero("score2")).alias("score"),
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), held_out(F.col("doc_id"), 10))
