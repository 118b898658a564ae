import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.urls import RULES, bloom_blocks, canonical, judge, op11_url_filter, possible

URL = "page_id long, url string"


def parts(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:end], rest[end:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    rest = rest.split("#", 1)[0]
    path, _, asked = rest.partition("?")
    kept = sorted(p for p in asked.split("&") if p and not p.startswith("utm_") and p.split("=")[0] not in ("fbclid", "gclid", "ref"))
    plain = host.removesuffix(":80") if host.endswith(":80") else host.removesuffix(":443")
    plain = plain.removeprefix("www.")
    return host, path, plain + path.rstrip("/") + ("?" + "&".join(kept) if kept else "") if plain else None


def plain_judge(pages, listed, rules):
    known = {parts(u)[2] for u in listed} - {None}
    out = []
    for i, u in pages:
        host, path, key = parts(u)
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
        out.append((i, host, path, best and "".join(best), rules[best] if best else "block" if key in known else "allow"))
    return sorted(out, key=repr)


def urls(n, seed=3):
    rng = random.Random(seed)
    some = lambda *x: rng.choice(x)
    out = [None, "", "no scheme", "://", "http://", "http://?a=1", "http://#x", "a://b://c/d", "HTTP://WWW.Example.COM:80/EN/x", "http://net/es/", "http://éÄ.net/fr", "http://x.net" + "/long" * 20_000]
    for _ in range(n):
        host = some("", "www.", "m.", "WWW.") + some("example", "casino-win.example", "spam.example", "notexample") + some(".com", ".net", ".org", ".com:443")
        out.append(some("http", "https") + "://" + host + some("", "/", "/en", "/en/", "/es/", "/fr/x", "/de/") + some("", "1", "2/", "3//") + some("", "?", "?b=1&a=2", "?a=2&utm_x=9&b=1", "?ref=z", "?refer=z") + some("", "#top", "#?/"))
    return out


def test_equals_brute_force(spark):
    pages = list(enumerate(urls(600))) + [(None, "http://spam.example.org/x"), (3, "no scheme")]
    listed = [u for i, u in pages if i and i % 3 == 0] + [None]
    frame = spark.createDataFrame([(i, u, "a", 1) for i, u in pages], f"{URL}, host string, key int")
    given = spark.createDataFrame([(u, "b") for u in listed], "url string, verdict string")
    for most in (1 << 20, 1, 4):  # an overfull filter passes more and changes nothing
        got = judge(frame, given, RULES, most_blocks=most)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_judge(pages, listed, RULES)
    free = judge(frame, given)
    assert sorted((tuple(r) for r in free.collect()), key=repr) == plain_judge(pages, listed, {})


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(4000).select(F.concat(F.lit("listed/"), "id").alias("key"))
    filled = bloom_blocks(keys, 250).cache()
    assert possible(keys, filled, 250).where("not hit").count() == 0
    others = spark.range(20_000).select(F.concat(F.lit("other/"), "id").alias("key"))
    assert possible(others, filled, 250).where("hit").count() < 200
    assert filled.select(F.sum(sum(F.bit_count(f"b{i}") for i in range(4)))).first()[0] <= 8 * 4000
    assert possible(spark.createDataFrame([(None,)], "key string"), filled, 250).first().hit is False


def test_canonical_forms_meet(spark):
    same = ["http://www.a.org/x/?b=1&a=2#f", "https://A.org:443/x?a=2&utm_source=q&b=1", "ftp://a.org/x//?ref=1&b=1&a=2"]
    rows = spark.createDataFrame([(u,) for u in same], "url string").select(canonical(F.col("url")).alias("k")).distinct().collect()
    assert [r.k for r in rows] == ["a.org/x?a=2&b=1"]


@pytest.mark.parametrize("pages, listed", [([], ["http://a.b/"]), ([(1, "http://a.b/")], []), ([], [])])
def test_empty(spark, pages, listed):
    got = judge(spark.createDataFrame(pages, URL), spark.createDataFrame([(u,) for u in listed], "url string"), RULES)
    assert [tuple(r) for r in got.collect()] == [(1, "a.b", "/", None, "allow")] * len(pages)


def test_query(spark, tmp_path):
    pages = list(enumerate(urls(300, 5)))
    spark.createDataFrame(pages, URL).write.parquet(f"{tmp_path}/pages.parquet")
    bad = [u for _, u in pages if {"casino", "spam"} & set(parts(u)[0].replace("-", ".").split("."))]
    got = sorted((tuple(r) for r in op11_url_filter(spark, str(tmp_path)).collect()), key=repr)
    assert got == plain_judge(pages, bad, RULES) and sum(r[3] is None and r[4] == "block" for r in got) > 5
