"""Benchmark decontamination with built-in functions only.

Windows of a document as long as a benchmark item are fingerprinted by SimHash over their word
shingles. Fingerprints are cut into blocks; for each block of an item's fingerprint the values of a
small Hamming ball are listed, and a window finds items in the tables of (length, block, value) alone.
Eight blocks and balls of two bits find every fingerprint within 23 bits. Complete distances and the
exact weighted Jaccard similarity of the shingles then verify each candidate.

A window that holds fewer shingles of items of its length than the similarity needs cannot reach it
with any of them, in whatever order they stand; such windows are not fingerprinted. Documents without
enough shingles of items are left after one pass over their words, by a Bloom filter of all item
shingles, and no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import lowered_words, table
from tessera.plans.scratch import Scratch

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, BALL = 8, 2
#: Every fingerprint within so many bits is met.
RADIUS = BLOCKS * (BALL + 1) - 1
#: The scan's Bloom filter has so many bits for each different item shingle, up to the second number (2 MB),
#: and so many probes; a fuller one lets more documents through to the joins, and the result stays the same.
BITS_EACH, MOST_BITS, PROBES = 32, 1 << 24, 8
#: Rows of item tables that are broadcast, at most (some 40 bytes each). Beyond it the same joins shuffle.
BROADCAST_ROWS = 1_000_000


def word_hashes(text: Column) -> Column:
    return F.transform(lowered_words(text), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words (given as hashes), in order; none for fewer words."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(size))))


def simhash(hashes: Column, longest: int = (1 << 16) - 1) -> Column:
    """64-bit majority fingerprint of an array of at most ``longest`` hashes, repeats included.

    The 64 counts are kept as binary digits, one number for the same digit of all of them: adding a
    hash is a carry from digit to digit, and the majority is a comparison from the top digit down.
    """
    planes = range(max(1, longest.bit_length()))
    zero, ones = F.lit(0).cast("long"), F.lit(-1).cast("long")
    name = "c{}".format

    def add(acc: Column, h: Column) -> Column:
        carry, out = h, []
        for j in planes:
            out.append(acc[name(j)].bitwiseXOR(carry).alias(name(j)))
            carry = carry.bitwiseAND(acc[name(j)])
        return F.struct(*out)

    def majority(acc: Column) -> Column:
        least = F.shiftright(F.size(hashes), 1) + 1
        more, same = zero, ones
        for j in reversed(planes):
            digit, wanted = acc[name(j)], -(F.shiftright(least, j).bitwiseAND(F.lit(1))).cast("long")
            more = more.bitwiseOR(same.bitwiseAND(digit).bitwiseAND(F.bitwise_not(wanted)))
            same = same.bitwiseAND(F.bitwise_not(digit.bitwiseXOR(wanted)))
        return more.bitwiseOR(same)

    return F.aggregate(hashes, F.struct(*(zero.alias(name(j)) for j in planes)), add, majority)


def block(fp: Column, b: Column) -> Column:
    width = 64 // BLOCKS
    return F.call_function("shiftrightunsigned", fp, b * width).bitwiseAND(F.lit((1 << width) - 1))


def overlap(item: Column, window: Column) -> Column:
    """Sum over different shingles of the smaller of the two counts."""
    count = lambda a, h: F.size(F.filter(a, lambda x: x == h))
    return F.aggregate(F.array_distinct(item), F.lit(0), lambda acc, h: acc + F.least(count(item, h), count(window, h)))


def once(column: Column) -> Column:
    """The column as a generator of one row: what refers to it never repeats its computation.

    Catalyst moves filters below projections and copies what they refer to, here whole passes over a
    text into a loop over its words.
    """
    return F.explode(F.array(column))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A side of a join by its counted rows: Spark's own size of it leaves out what an explode adds."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def _known(items: DataFrame, column: str) -> Callable[[Column], Column]:
    """hash -> whether it may be one of the hashes in an array column, by a Bloom filter of bounded size."""
    each = items.select(F.explode(column).alias("h")).distinct()
    bits = min(MOST_BITS, max(1 << 12, 1 << (BITS_EACH * each.count()).bit_length()))
    mask = F.lit(bits - 1).cast("long")

    def probe(h: Column, i: int) -> Column:
        return (h.bitwiseXOR(F.call_function("shiftrightunsigned", h, F.lit(5 * i + 3))) if i else h).bitwiseAND(mask)

    places = each.select(F.explode(F.array(*(probe(F.col("h"), i) for i in range(PROBES)))).alias("place"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    dense = [0] * (bits // 64)
    for r in places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("bits")).collect():  # at most MOST_BITS / 64 numbers
        dense[r["word"]] = r["bits"]
    table_ = F.split(F.lit(",".join(map(str, dense))), ",").cast("array<long>")  # folded into one constant

    def test(h: Column) -> Column:
        found = F.lit(True)
        for i in range(PROBES):
            at = probe(h, i)
            found = found & (F.call_function("getbit", F.get(table_, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
        return found

    return test


def contaminated(
    docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, scratch: Scratch | None = None, all_windows: bool = False
) -> DataFrame:
    """Columns row, doc_id, text_key, item_id, similarity, start: the best window of each item in each document.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Words are those of
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. An item of n words is compared with windows of n words
    (a shorter document: with all of it); items of fewer words than a shingle are one shingle, and
    items without words match nothing, nor do null texts. similarity: shared shingles over all
    shingles, counted with repeats. start: the window's first word, the earliest of equal ones.
    row: a number of the document's row, so that equal rows, or rows with equal or null doc_id, are
    judged each by itself; text_key, the hash of its text, finds it again. Equal items are reported
    each. A very long text has its windows like any other. Empty tables give an empty result.
    all_windows: fingerprint also the windows that cannot reach the similarity; the result is the same.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "decontaminate")
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.size("w").alias("n"), F.least(F.size("w"), F.lit(shingle)).alias("k"), "w")
    by_size = F.coalesce(*(F.when(F.col("k") == k, shingle_hashes(F.col("w"), k)) for k in range(1, shingle + 1)))
    items = scratch.save(items.select("item", "item_id", "k", (F.col("n") - F.col("k") + 1).alias("width"), by_size.alias("item_hashes")), "items")
    classes = sorted((r["k"], r["width"]) for r in items.select("k", "width").distinct().collect())  # the different lengths of items
    longest = max((w for _, w in classes), default=1)
    items = scratch.save(items.withColumn("item_fp", simhash(F.col("item_hashes"), longest)), "items")
    worded = docs.select("doc_id", F.xxhash64("text").alias("text_key"), once(word_hashes(F.col("text"))).alias("w"))

    bits = 64 // BLOCKS
    balls = [sum(1 << x for x in c) for r in range(BALL + 1) for c in combinations(range(bits), r)]
    listed = items.select("k", "width", "item", "item_fp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("b"))
    listed = listed.select("*", F.explode(F.transform(F.array(*(F.lit(x).cast("long") for x in balls)), lambda x: block(F.col("item_fp"), F.col("b")).bitwiseXOR(x))).alias("value"))
    n_items = items.count()

    found = []
    for k in sorted({k for k, _ in classes}):
        mine = items.where(F.col("k") == k)
        hashed = worded.select("doc_id", "text_key", once(shingle_hashes(F.col("w"), k)).alias("hashes")).where(F.size("hashes") > 0)
        everywhere = F.sequence(F.lit(0), F.size("hashes") - 1)
        if all_windows:
            seeded = scratch.save(hashed.withColumn("row", F.monotonically_increasing_id()), "seeded")
            widths = F.array(*(F.lit(w) for k_, w in classes if k_ == k))
            held = seeded.select("row", "doc_id", "text_key", "hashes", everywhere.alias("p"), F.explode(widths).alias("width"))
        else:
            known = _known(mine, "item_hashes")
            hits = F.filter(everywhere, lambda i: known(F.get("hashes", i)))
            # the shortest item needs the fewest
            least = min(w for k_, w in classes if k_ == k)
            fewest = F.greatest(F.lit(1), F.ceil((F.least(F.size("hashes"), F.lit(least)) + least) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9)))
            seeded = hashed.select("doc_id", "text_key", "hashes", once(hits).alias("hits")).where(F.size("hits") >= fewest)
            seeded = scratch.save(seeded.withColumn("row", F.monotonically_increasing_id()), "seeded")
            of_width = scratch.save(mine.select(F.explode("item_hashes").alias("h"), "width").distinct(), "widths")
            seeds = seeded.select("row", F.explode("hits").alias("p"), F.get("hashes", F.col("p")).alias("h"))
            held = seeds.join(_small(of_width, of_width.count()), "h").groupBy("row", "width").agg(F.sort_array(F.collect_list("p")).alias("p"))
            held = held.where(F.size("p") * (1 + similarity) + 1e-9 >= similarity * F.col("width")).join(seeded.drop("hits"), "row")
        # ``need`` shingles out of a window of ``size``; windows whose first place with a shingle of an item is
        # the i-th and whose need-th such place still lies within
        held = held.withColumn("size", F.least("width", F.size("hashes")))
        held = held.withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("width") + F.col("size")) * F.lit(similarity / (1 + similarity)) - F.lit(1e-9)).cast("int")))
        before = lambda i: F.when(i > 0, F.get("p", i - 1)).otherwise(F.lit(-1))
        low = lambda i: F.greatest(F.lit(0), before(i) + 1, F.get("p", i + F.col("need") - 1) - F.col("size") + 1)
        high = lambda i: F.least(F.get("p", i), F.size("hashes") - F.col("size"))
        none = F.array().cast("array<int>")
        firsts = F.transform(F.sequence(F.lit(0), F.size("p") - F.col("need")), lambda i: F.when(low(i) <= high(i), F.sequence(low(i), high(i))).otherwise(none))
        starts = held.where(F.size("p") >= F.col("need")).withColumn("start", F.explode(F.flatten(firsts)))
        windows = starts.select("row", "doc_id", "text_key", "width", "start", F.slice("hashes", F.col("start") + 1, F.col("size")).alias("window"))
        windows = windows.select("*", once(simhash(F.col("window"), longest)).alias("fp"))
        blocks = windows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))).withColumn("value", block(F.col("fp"), F.col("b")))
        table_ = listed.where(F.col("k") == k).drop("k")
        apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
        # an item that several blocks find counts at the first of them
        first = F.coalesce(*(F.when(F.bit_count(block(apart, F.lit(b))) <= BALL, F.lit(b)) for b in range(BLOCKS)))
        met = blocks.join(_small(table_, n_items * BLOCKS * len(balls)), ["width", "b", "value"]).where((F.bit_count(apart) <= RADIUS) & (first == F.col("b")))
        met = met.select("row", "doc_id", "text_key", "item", "start", "window")
        near = met.join(_small(mine.select("item", "item_id", "item_hashes"), n_items * BLOCKS), "item")
        shared = overlap(F.col("item_hashes"), F.col("window")).cast("double")
        judged = near.select("row", "doc_id", "text_key", "item", "item_id", "start", (F.size("item_hashes") + F.size("window")).alias("both"), once(shared).alias("shared"))
        judged = judged.select("row", "doc_id", "text_key", "item", "item_id", "start", (F.col("shared") / (F.col("both") - F.col("shared"))).alias("similarity"))
        best = judged.where(F.col("similarity") >= similarity).groupBy("row", "doc_id", "text_key", "item", "item_id").agg(
            F.min(F.struct(-F.col("similarity"), "start")).alias("best")
        )
        found.append(best.select("row", "doc_id", "text_key", "item_id", (-F.col("best.col1")).alias("similarity"), F.col("best.start").alias("start")))
    if not found:
        kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
        return spark.createDataFrame([], "row long, doc_id {}, text_key long, item_id {}, similarity double, start int".format(*kinds))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), F.col("start").cast("long").alias("start"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
i AS (SELECT item_id, len(w) AS n, list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) AS sh FROM iw WHERE len(w) >= 5),
d AS (SELECT doc_id, len(w) AS n, list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) AS sh FROM dw WHERE len(w) >= 5),
ip AS (SELECT item_id, n, len(sh) AS m, unnest(sh) AS s, generate_subscripts(sh, 1) AS p FROM i),
dp AS (SELECT doc_id, n, unnest(sh) AS s, generate_subscripts(sh, 1) AS p FROM d),
al AS (SELECT DISTINCT dp.doc_id, ip.item_id, ip.m, greatest(0, dp.n - ip.n) AS last FROM dp JOIN ip USING (s)),
st AS (SELECT doc_id, item_id, m, unnest(range(0, last + 1)) AS start FROM al),
wi AS (SELECT st.doc_id, st.item_id, st.m, st.start, d.sh[st.start + 1:st.start + st.m] AS win FROM st JOIN d USING (doc_id)),
wc AS (SELECT doc_id, item_id, start, m, mw, s, count(*) AS c FROM (SELECT doc_id, item_id, start, m, len(win) AS mw, unnest(win) AS s FROM wi) GROUP BY ALL),
ic AS (SELECT item_id, s, count(*) AS c FROM ip GROUP BY ALL),
j AS (SELECT doc_id, item_id, start, sum(least(wc.c, ic.c)) AS o, any_value(m) AS m, any_value(mw) AS mw FROM wc JOIN ic USING (item_id, s) GROUP BY doc_id, item_id, start),
r AS (SELECT doc_id, item_id, start, o / (m + mw - o) AS sim FROM j WHERE o / (m + mw - o) >= 0.8)
SELECT doc_id, item_id, round(sim, 6) AS similarity, start FROM r
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, start) = 1
"""
