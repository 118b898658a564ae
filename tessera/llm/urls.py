"""URL filters: rules of hosts and path prefixes, then a list of addresses behind a blocked Bloom filter.

Addresses are compared in a canonical form. The listed ones fill a Bloom filter of 256-bit blocks,
one bit in each of a block's eight words, so that a look-up touches a single block. The table of
blocks has a proven bound and is broadcast; addresses that it passes, the listed ones and few others,
go to an exact hash join with the list, which takes the false positives out again. A list too long
for the bound fills the blocks more densely: more addresses reach the join, the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, table
from tessera.plans.scratch import Scratch

ALLOW, BLOCK = "allow", "block"
#: Keys that share a block of 256 bits, and blocks at most: some 100 MB where they are broadcast.
KEYS_A_BLOCK, MOST_BLOCKS = 16, 1 << 20
#: Parameters of an address that only say where a visitor came from; those that start with utm_ besides.
TRACKING = ["fbclid", "gclid", "ref"]
#: (host, path) -> verdict; the rules of the query.
RULES = {
    ("com", "/"): ALLOW,
    ("example.com", "/en/"): BLOCK,
    ("www.example.com", "/en/"): ALLOW,
    ("net", "/es/"): BLOCK,
    ("net", "/fr/"): BLOCK,
}
#: Words in names of hosts whose addresses the query lists.
BAD_NAMES = ["adult", "bets", "casino", "pills", "spam"]


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty for a null address or one without it."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, with A-Z lowered."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """An address without scheme, ``www.``, usual port, slashes at the end, fragment and tracking parameters.

    The other parameters are sorted. Null where there is no host.
    """
    plain = F.regexp_replace(F.regexp_replace(host(url), r":(80|443)$", ""), r"^www\.", "")
    given = F.split(F.regexp_extract(_rest(url), r"^[^/?#]*[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(given, lambda p: (p != "") & ~p.startswith("utm_") & ~F.split(p, "=")[0].isin(TRACKING)))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(plain != "", F.concat(plain, F.regexp_replace(path(url), r"/+$", ""), asked))


def rule_of(of_host: Column, of_path: Column, rules: dict[tuple[str, str], str]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (h, p), v in sorted(rules.items(), key=lambda r: (len("".join(r[0])), len(r[0][0]))):
        fits = ((of_host == h) | of_host.endswith(f".{h}")) & of_path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _place(key: Column, blocks: int) -> list[Column]:
    """The block of a key, and four 64-bit halves of its mask: two bits each, one in every word of 32."""
    bits = F.xxhash64(F.lit("bits"), key)
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 5 * n).bitwiseAND(31).cast("int"))
    words = [one(2 * i).bitwiseOR(F.shiftleft(one(2 * i + 1), 32)).alias(f"m{i}") for i in range(4)]
    return [F.pmod(F.xxhash64(F.lit("block"), key), F.lit(blocks)).alias("block"), *words]


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """Columns block and b0 to b3 of the filter over ``keys`` (key, no nulls); empty blocks have no row."""
    placed = keys.select(*_place(F.col("key"), blocks))
    return placed.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"b{i}") for i in range(4)))


def possible(rows: DataFrame, filled: DataFrame, blocks: int) -> DataFrame:
    """rows (with a column key) + ``hit``: whether the filter passes the key; false for a null one."""
    placed = rows.select(*rows.columns, *_place(F.col("key"), blocks)).join(F.broadcast(filled), "block", "left")
    hit = F.col("key").isNotNull()
    for i in range(4):
        hit = hit & F.coalesce(F.col(f"b{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"), F.lit(False))
    return placed.select(*rows.columns, hit.alias("hit"))


def judge(pages: DataFrame, listed: DataFrame, rules: dict[tuple[str, str], str] | None = None, most_blocks: int = MOST_BLOCKS, scratch: Scratch | None = None) -> DataFrame:
    """Columns page_id, host, path, rule, verdict for every row of pages (page_id, url).

    rules: a short, hand-written list, (host, path) -> verdict. A rule fits its host and all
    subdomains where the path starts with its path; the longest fitting one (host and path together,
    then host) decides. Without one, addresses whose canonical form is that of an address in ``listed``
    (url) are blocked and the others allowed. Null addresses and those without ``://`` have an empty
    host and path and are allowed; a null page_id stays; repeated rows are judged each; other columns
    of either table are ignored; a very long address is compared whole. Empty tables are fine on both sides.
    """
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    listed = scratch.save(listed.select(canonical(F.col("url")).alias("key")).where("key is not null").distinct(), "listed")
    blocks = max(1, min(most_blocks, -(-listed.count() // KEYS_A_BLOCK)))
    filled = scratch.save(bloom_blocks(listed, blocks), "blocks")
    url = F.col("url")
    seen = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("key"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules or {})
    ruled = seen.withColumn("rule", rule).withColumn("verdict", verdict)
    # the key decides only where no rule does
    met = possible(ruled.withColumn("key", F.when(F.col("rule").isNull(), F.col("key"))), filled, blocks)
    out = ["page_id", "host", "path", "rule"]
    sure = met.where("not hit").select(*out, F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"))
    exact = met.where("hit").join(listed.withColumn("found", F.lit(True)).hint("shuffle_hash"), "key", "left")
    return sure.unionByName(exact.select(*out, F.when(F.col("found"), BLOCK).otherwise(ALLOW).alias("verdict")))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the addresses of pages on hosts with a bad word in their name."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.arrays_overlap(F.split(host(F.col("url")), r"[.\-]"), F.array(*map(F.lit, BAD_NAMES)))
    return judge(pages, pages.where(bad), RULES)


def _sql() -> str:
    case = lambda what: " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(h, p, v)}'"
        for (h, p), v in sorted(RULES.items(), key=lambda r: -len("".join(r[0])))
    )
    names = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, string_split(regexp_extract(rest, '^[^/?#]*[^?#]*\?([^#]*)', 1), '&') AS given FROM a),
c AS (SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') AS plain,
    list_sort(list_filter(given, lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND string_split(x, '=')[1] NOT IN ({names(TRACKING)}))) AS kept FROM b),
d AS (SELECT page_id, host, path, CASE {case(lambda h, p, v: h + p)} END AS rule, CASE {case(lambda h, p, v: v)} END AS verdict,
    CASE WHEN plain <> '' THEN plain || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS key FROM c),
l AS (SELECT DISTINCT key FROM d WHERE list_has_any(string_split_regex(host, '[.\-]'), [{names(BAD_NAMES)}]))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN key IN (SELECT key FROM l WHERE key IS NOT NULL) THEN 'block' ELSE 'allow' END) AS verdict FROM d
"""


ORACLE = _sql()
