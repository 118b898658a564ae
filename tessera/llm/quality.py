"""Quality rules under weak supervision.

Each rule votes good or bad, or abstains. Expectation-maximisation over the counts of all vote
patterns estimates how often good and bad documents get each vote from each rule; the posterior
probability of a document's pattern is its quality. There are at most 3^rules patterns, so what the
fit collects is bounded while it covers every document.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import per_row, raw_words, table
from tessera.plans.scratch import Scratch

SYMBOLS = b"#*$%&|<>"
ENDS = (b".", b"!", b"?", b'"', b"\xe2\x80\xa6", b":", b";")
GOOD, BAD, ABSTAIN = 1, 2, 0


def repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words which the list holds twice or more."""
    windows = list(zip(*(words[i:] for i in range(size))))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + size - max(i, upto)
            upto = i + size
    return covered


def features(text: bytes | None) -> dict[str, float]:
    text = text or b""
    words = raw_words(text)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    letters = sum(map(str.isalpha, joined.decode("utf-8", "replace")))
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": len(text) - len(text.translate(None, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat_words(words),
        "lines": len(lines), "ended": sum(x.rstrip().endswith(ENDS) for x in lines),
        "top": max(counts.values(), default=0), "letters": letters,
    }


def _vote(value: float, good: float, bad: float) -> int:
    """GOOD up to the first bound, BAD from the second on, no vote in between."""
    return GOOD if value <= good else BAD if value >= bad else ABSTAIN


def _within(value: float, good: tuple[float, float], bad: tuple[float, float]) -> int:
    """GOOD inside the first bounds, BAD outside the second ones, no vote in between."""
    return GOOD if good[0] <= value <= good[1] else BAD if value < bad[0] or value > bad[1] else ABSTAIN


#: name -> features -> vote; a rule abstains where it has nothing to go by. The rules overlap and are strict: each
#: finds fault with a few good texts in a hundred, which the fit weighs against what the other rules say. Their bounds
#: were set on labelled texts with crc32(doc_id) mod 5 other than 0 and are judged on the rest.
RULES = {
    "length": lambda f: GOOD if 80 <= f["n_words"] <= 1500 else BAD if f["n_words"] < 50 or f["n_words"] > 3000 else ABSTAIN,
    "repeats": lambda f: _vote(f["n_repeat_words"] / f["n_words"], 0.005, 0.02) if f["n_words"] >= 3 else ABSTAIN,
    "symbols": lambda f: _vote(f["n_symbols"] / f["word_chars"], 0, 0.02) if f["word_chars"] else BAD,
    "same lines": lambda f: _vote(f["n_dup_lines"] / f["lines"], 0, 0.03) if f["lines"] > 3 else ABSTAIN,
    "word length": lambda f: _within(f["word_chars"] / f["n_words"], (4.6, 5.8), (4.2, 6.6)) if f["n_words"] else BAD,
    "letters": lambda f: _vote(-f["letters"] / f["word_chars"], -0.93, -0.85) if f["word_chars"] else BAD,
    "line ends": lambda f: _vote(-f["ended"] / f["lines"], -1, -0.9) if f["lines"] else BAD,
    "one word": lambda f: _vote(f["top"] / f["n_words"], 0.07, 0.11) if f["n_words"] >= 20 else ABSTAIN,
}


def votes(f: dict[str, float]) -> list[int]:
    return [rule(f) for rule in RULES.values()]


def fit(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> dict[tuple[int, ...], float]:
    """Posterior probability of good for each pattern of votes, from counts of patterns.

    Two classes, rules independent given the class, each with its own shares of the three votes in
    each class (one vote of each kind is added to the counts). A text starts as good with the share of
    votes for it among its votes, which fixes the meaning of the classes and no more: how much a vote
    of a rule weighs, and for which class, is what the rounds estimate. A rule that often votes against
    texts that the others find good ends up with little weight.
    """
    if not patterns:
        return {}
    kinds = np.array(sorted(patterns))
    n = np.array([patterns[tuple(p)] for p in kinds.tolist()], float)
    good, bad = (kinds == GOOD).sum(1), (kinds == BAD).sum(1)
    q = (good + 1) / (good + bad + 2)
    onehot = kinds[:, :, None] == np.arange(3)
    for _ in range(rounds):
        prior = (np.array([(n * (1 - q)).sum(), (n * q).sum()]) + 1) / (n.sum() + 2)
        log = np.log(prior)[None, :].repeat(len(n), 0)
        for c, weight in enumerate((n * (1 - q), n * q)):
            share = (weight[:, None, None] * onehot).sum(0) + 1
            share /= share.sum(1, keepdims=True)
            log[:, c] += (onehot * np.log(share)).sum((1, 2))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -700, 700)))
        done, q = np.abs(new - q).max() < 1e-9, new
        if done:
            break
    return {tuple(p): float(v) for p, v in zip(kinds.tolist(), q)}


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Columns doc_id, the five counts, base_failed, quality, kept for every row of docs (doc_id, text).

    quality: posterior probability of good. kept: quality of a half or more and not base_failed
    (fewer than 50 words, or more than half of them in repeated windows of three). Null texts have no
    words and are base_failed; equal rows get equal results; other columns are ignored; the id is
    not looked at and may be null. A very long text is looked at whole, in memory that grows with its
    length. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "quality")
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in BASE), ("votes", pa.int32())])

    def make():
        def row(doc_id, text):
            f = features(text)
            return doc_id, *(f[n] for n in BASE), sum(v * 3**i for i, v in enumerate(votes(f)))

        return row

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    seen = scratch.save(rows.mapInArrow(per_row(make, schema), f"doc_id long, {', '.join(f'{n} long' for n in BASE)}, votes int"), "features")
    counts = {r["votes"]: r["count"] for r in seen.groupBy("votes").count().collect()}  # at most 3^8 rows
    code = lambda v: tuple(v // 3**i % 3 for i in range(len(RULES)))
    found = fit({code(v): n for v, n in counts.items()})
    quality = spark.createDataFrame([(v, found[code(v)]) for v in counts], "votes int, quality double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return seen.join(F.broadcast(quality), "votes").select(
        "doc_id", *BASE, failed.alias("base_failed"), "quality", (~failed & (F.col("quality") >= 0.5)).alias("kept")
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *BASE, "base_failed", "kept", "quality")
