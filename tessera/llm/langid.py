"""Language ID by compression: a text belongs to the language whose dictionary compresses it best.

Per language, a bounded number of labelled texts, each whole, becomes zstandard raw-content dictionaries,
as many as it takes that all of each is within the encoder's reach. A text is encoded whole with each
dictionary; the smallest result names the language, and a narrow margin to the next language rejects it.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import held_out, table

#: Bounds of the fit, in whole texts: of a language, and of all languages together (one of each at least).
SAMPLE_TEXTS, ALL_TEXTS = 128, 16_384
#: The same in bytes of UTF-8, and the largest dictionary: from a megabyte on its head is out of reach at this level.
SAMPLE_BYTES, ALL_BYTES, DICTIONARY = 4 << 20, 64 << 20, 512 << 10
LEVEL = 3
#: Compressed bytes that part the two best languages of an accepted text, at least.
MARGIN = 2
UNKNOWN = "und"

_not_letters = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """The text in lower case with each run of other characters as one space."""
    return _not_letters.sub(" ", text.lower()).strip() if text else ""


def fit(docs: DataFrame, training: F.Column, sample_texts: int = SAMPLE_TEXTS, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[str, bytes]]:
    """[(language, dictionary)], one or more of each language, from rows of docs (doc_id, text, lang) where ``training`` holds.

    Of each language the ``sample_texts`` texts are taken whose hashes of id and text come first
    (fewer where there are so many languages that ALL_TEXTS or ALL_BYTES would be passed), and of these
    the first that make up ``sample_bytes``, but one at least; equal rows count once. Rows with null text
    or lang take no part; a null id is an id. Texts are taken whole, very long ones too. Counts are over
    all rows; executors bound the sample, in rows and bytes, before it is collected.
    """
    order = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id", "text"), 2)
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.col("text").cast("string").alias("text"), order.alias("_order"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return []
    take = max(1, min(sample_texts, ALL_TEXTS // len(counts)))
    # about four times the sample passes this limit, and of that the first are taken
    limits = docs.sparkSession.createDataFrame([(lang, min(1 << 62, (1 << 62) * 4 * take // n)) for lang, n in counts.items()], "lang string, _limit long")
    near = rows.join(F.broadcast(limits), "lang").where(F.col("_order") <= F.col("_limit")).select("lang", "_order", "text")
    first = Window.partitionBy("lang").orderBy("_order", "text")
    taken = near.distinct().select("lang", "_order", "text", F.row_number().over(first).alias("nth")).where(F.col("nth") <= take)
    upto = F.sum(F.octet_length("text")).over(first.rowsBetween(Window.unboundedPreceding, 0))
    most = min(sample_bytes, ALL_BYTES // len(counts))
    found = taken.select("lang", "text", "nth", upto.alias("upto")).where((F.col("upto") <= most) | (F.col("nth") == 1)).orderBy("lang", "nth").collect()
    return dictionaries(trusted([(r["lang"], letters(r["text"])) for r in found]))


def dictionaries(sample: list[tuple[str, str]], size: int = DICTIONARY) -> list[tuple[str, bytes]]:
    """The texts of each language in dictionaries of at most ``size`` bytes; longer texts are cut at spaces, or where they must be."""
    parts: dict[str, list[bytes]] = {}
    for lang, text in sample:
        own, data = parts.setdefault(lang, [b""]), text.encode()
        while data:
            at = len(data) if len(data) <= size else data.rfind(b" ", 1, size + 1)
            at = size if at < 0 else at
            piece, data = data[:at], data[at:].lstrip(b" ")
            if own[-1] and len(own[-1]) + 1 + len(piece) > size:
                own.append(b"")
            own[-1] += b" " + piece if own[-1] else piece
    return [(lang, d) for lang, own in sorted(parts.items()) for d in own]


def trusted(sample: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The sample without texts whose label the rest contradicts: each half is judged by the dictionaries of the other.

    A text under a wrong label would draw its near copies to that language. All of a language's texts
    stay where none would be left.
    """
    halves = [classifier(dictionaries(sample[k::2])) for k in (1, 0)]
    judged = [(lang, text, halves[i % 2](text)) for i, (lang, text) in enumerate(sample)]
    good = [(lang, text) for lang, text, (pred, _, rejected) in judged if rejected or pred == lang]
    left = {lang for lang, _ in good}
    return good + [(lang, text) for lang, text in sample if lang not in left]


def classifier(learned: list[tuple[str, bytes]], margin: int = MARGIN):
    """text -> (lang, score, rejected); of the dictionaries of a language the smallest result counts."""
    made = []
    for lang, data in learned:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(data) >= 8 else None
        if d:
            d.precompute_compress(level=LEVEL)
        made.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False).compress))

    def classify(text: str | None) -> tuple[str, float, bool]:
        plain = letters(text)
        if not made or not any(map(str.isalpha, plain)):
            return UNKNOWN, 0.0, True
        # a few bytes are stored as they are whatever the dictionary; repeated, they are matched
        data = plain.encode()
        if len(data) < 64:
            data = b" ".join([data] * (64 // len(data) + 1))
        least: dict[str, int] = {}
        for lang, compress in made:
            least[lang] = min(len(compress(data)), least.get(lang, 1 << 62))
        sizes = sorted((n, lang) for lang, n in least.items())
        best = sizes[0][0]
        score = 1 / sum(2.0 ** -min(s - best, 1000) for s, _ in sizes)
        return sizes[0][1], score, len(sizes) > 1 and sizes[1][0] - best < margin

    return classify


def detect(docs: DataFrame, learned: list[tuple[str, bytes]], margin: int = MARGIN) -> DataFrame:
    """All rows and columns of docs + lang_pred, score, rejected (columns of these names are replaced).

    lang_pred: the language of the smallest encoding (ties: the first in alphabetical order), `und`
    where the text is null or has no letter or nothing was learned; such rows are rejected, with score
    0. Equal rows get equal results, ids may be null and are not looked at, very long texts are encoded
    whole, and an empty table gives an empty result. score: 1 / sum over languages of 2^(best - size), which is near 1 for a clear text. rejected:
    the second language is less than ``margin`` bytes behind.
    """
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score", "rejected").withColumn("text", F.col("text").cast("string"))
    shared = spark.sparkContext.broadcast(learned)  # the texts of the bounded sample
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches):
        classify = classifier(shared.value, margin)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = zip(*map(classify, part.column("text").to_pylist()))
                columns = [pa.array(c, t) for c, t in zip(found, schema.types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *schema.names])

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "lang_pred string, score double, rejected boolean"])
    return docs.mapInArrow(run, out)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    away = held_out(F.col("doc_id"), 5)
    learned = fit(docs.select("doc_id", "text", "lang"), ~away)
    found = detect(docs.select("doc_id", away.alias("held_out"), "text"), learned)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
