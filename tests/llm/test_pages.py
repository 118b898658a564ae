import random

from tessera.llm import pages
from tessera.llm.pages import address, blocks, common, extract, key_of, main_text, op4_main_text


def plain_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(30))] for _ in range(2))
        found = common(a, b)
        assert len(found) == plain_length(a, b) == pages._row(a, b)[-1]
        assert all(a[i] == b[j] for i, j in found) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:]))


def test_common_of_long_sequences_equals_the_table():
    rng = random.Random(2)
    a, b = ([rng.randrange(40) for _ in range(n)] for n in (700, 650))
    found = common(a, b)  # beyond the table's size
    assert len(found) == plain_length(a, b) and all(a[i] == b[j] for i, j in found)


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{}</style></head><body><nav><ul><li><a href="x>y">Menu</a></nav>
    <script>var t="</p>";</script><!-- <p>gone</p> --><div class="cookie-notice">Eat</div><header><h1>Site</h1></header>
    <article><header><h1>Title</h1></header><p>One&nbsp;<b>t</b>wo &lt;3 &#233;<br>next < 5<p>open  end
    <form><input value=">">Ask</form><aside>Side</aside><section class="comments"><p>Nice!</p></section></article><footer>&copy;</footer></body></html>"""
    assert main_text(page, frozenset()) == "Title One two <3 é next < 5 open end"
    assert {b[1] for b in blocks(page)} == {"main", "chrome"}
    for odd in (None, "", "<", "<p", "</p>", "<article>", "<!--", "<script>x", "plain & simple", "<p class='x>y"):
        assert isinstance(main_text(odd, frozenset()), str)
    assert main_text("plain &amp; simple", frozenset()) == "plain & simple"


def test_articles_of_other_kinds_and_class_names():
    page = """<main class="has-sidebar"><article class="post with-comments"><p>kept</p><ol class="commentlist"><li>no</ol><div class="entry-content">also</div>
    <article class="comment">no</article></article></main><article class="teaser">no</article><div id="footer2">no</div>"""
    assert main_text(page, frozenset()) == "kept also"


def test_address():
    assert address("HTTPS://Www.Ex.com:80/a/b?q#f") == ("www.ex.com", "/a/b")
    assert address(None) == ("", "") and address("http://[x") == ("", "http://[x")


def test_names_that_only_hint_and_articles_of_another_kind():
    assert main_text('<body><article class="review"><p>a whole review</p></article></body>') == "a whole review"
    prose = "the price of a share rose and rose until it fell"
    page = f'<article><p>one</p><div class="share-prices"><p>{prose}</p></div><section class="related-work"><p>{prose}</p></section><div class="share-bar">Tweet</div><div class="share"><p>{prose}</p></div></article>'
    assert main_text(page) == f"one {prose} {prose}"
    assert main_text(page, alone=False) == f"one {prose} {prose} Tweet"  # neighbours would have shown it
    assert main_text(page, frozenset({key_of("article[0]>div.share-bar[0]")}), False) == f"one {prose} {prose}"


def unnamed_pages():
    """Pages without article or main elements or telling names: frames, rotating menus and notices, quoted sentences."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    menus = ["".join(f"<p>{say(2)}</p>" for _ in range(5)) for _ in range(3)]
    notices = [say(9), say(9)]
    rows, want = [], {}
    for i in range(60):
        text = [say(12) for _ in range(4)]
        if 8 <= i < 16:  # neighbours quote the same sentence
            text[1] = "a sentence that many articles quote"
        host, path = ("one", f"{i:03d}") if i < 40 else (f"lonely{i}", str(i))
        frame = '<div class="q7"><p>always here</p><p>and here</p><p>too</p></div>' if i < 40 else ""
        frame += f'<div class="q8">{rng.choice(menus)}</div><div class="q9"><p>{say(6) if i % 7 == 0 else notices[rng.randrange(2)]}</p></div>' if i < 40 else ""
        consent = "<p>we keep crumbs</p>" if i < 40 else ""
        rows.append((i, f"http://{host}.org/p/{path}?x={i}", f"<body>{frame}<div class=z1>{text[0]}{consent}{''.join(f'<p>{t}</p>' for t in text[1:])}</div></body>"))
        want[i] = " ".join(text)
    return rows, want


def test_neighbours_reveal_templates_without_names(spark):
    rows, want = unnamed_pages()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in extract(frame).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())
    joined = {r.page_id: r.text for r in extract(frame, broadcast_marks=0).collect()}
    assert joined == want
    without = {r.page_id: r.text for r in extract(frame, differencing=False).collect()}
    assert sum(without[i] != want[i] for i in range(40)) == 40 and all(without[i] == want[i] for i in range(40, 60))


def test_copies_of_an_article_stay(spark):
    rows = [(i, f"https://h.org/{i}", f"<nav>m</nav><article><h1>Same</h1><p>the same text everywhere</p></article><footer>{i}</footer>") for i in range(9)]
    rows += [(i, f"https://k.org/{i}", "<div class=a><p>the same text in a plain container</p></div><div class=b><p>short</p></div>") for i in range(9, 14)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "Same the same text everywhere" if i < 9 else "the same text in a plain container" for i in range(14)}


def test_a_sentence_of_all_articles_stays(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    quoted, rows, want = "a sentence that every article of the host quotes", [], {}
    for i in range(8):
        own = [say(40) for _ in range(3)]
        rows.append((i, f"http://h.org/{i}", f"<body><div>always</div><article><p>{own[0]}</p><p>{quoted}</p><p>{own[1]}</p><div><p>{own[2]}</p></div></article></body>"))
        want[i] = " ".join([own[0], quoted, own[1], own[2]])
    assert {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want


def test_a_few_copies_of_an_article_are_no_template(spark):
    """Five of fifty pages without an article element hold the same text: only what all share goes."""
    rng = random.Random(7)
    say = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    copied, rows, want = [say(20) for _ in range(4)], [], {}
    for i in range(50):
        text = copied if 20 <= i < 25 else [say(20) for _ in range(4)]
        rows.append((i, f"http://h.org/{i:02d}", f"<body><div>home news</div><div>{''.join(f'<p>{t}</p>' for t in text)}</div><div>imprint</div></body>"))
        want[i] = " ".join(text)
    assert {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want


def test_a_very_long_page(spark):
    long = "".join(f"<p>line {i} of many</p>" for i in range(30_000))
    rows = [(1, "https://h.org/1", f"<nav>m</nav><div class=c>{long}</div>"), (2, "https://h.org/2", "<nav>m</nav><div class=c><p>other</p></div>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "other" and got[1].startswith("line 0 of many line 1 of") and got[1].endswith("line 29999 of many")


def test_articles_keep_what_they_share(spark, tmp_path):
    rows = [(i, f"https://h.org/{i}", f"<nav>m</nav><article><h1>T{i}</h1><p>shared</p><div class=s9>like us</div></article>") for i in range(20)]
    rows += [(100, None, "<article>a</article>"), (101, "http://[bad", "<p>b"), (102, "https://h.org/5", None), (None, "x", ""), (0, rows[0][1], rows[0][2])]
    spark.createDataFrame([(i, u, h, "k", 3) for i, u, h in rows], "page_id long, url string, html string, host string, lines int").write.parquet(f"{tmp_path}/pages.parquet")
    found = op4_main_text(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    got = {r.page_id: r.text for r in found}
    assert all(got[i] == f"T{i} shared" for i in range(20))
    assert (got[100], got[101], got[102], got[None]) == ("a", "b", "", "")


def test_empty(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hosts_of_two_pages_in_any_number_of_ranges(spark):
    rows = []
    for h in range(8):
        for i in range(2):
            rows.append((2 * h + i, f"http://h{h}.org/{i}", f"<body><div class=q7><p>shared by host {h}</p></div><div class=z1><p>own words of page {h} {i}</p><p>more own words {i} {h}</p></div></body>"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for changed in ({}, settings):
        was = {k: spark.conf.get(k) for k in changed}
        try:
            for k, v in changed.items():
                spark.conf.set(k, v)
            got = {r.page_id: r.text for r in extract(frame).collect()}
        finally:
            for k, v in was.items():
                spark.conf.set(k, v)
        assert got == {2 * h + i: f"own words of page {h} {i} more own words {i} {h}" for h in range(8) for i in range(2)}
