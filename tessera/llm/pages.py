"""Main text of web pages by differencing against the page of the nearest URL.

Pages are ordered by host and URL path, and each is aligned with its neighbour by the longest common
subsequence of their text lines. A line that two neighbours share is a shared line of its host.
Containers are told apart by their chain of elements, names and places among siblings. One most of whose
lines are shared, over the host, or on the page with lines that many pages of the host hold, is template
and is deleted with its odd unshared line (a page's own advert or notice). Outside an article element, a
line that half of the host's pages hold is deleted too; a sentence that stands in an article stays, however
many articles quote it. Tags and names then settle, among what is left, what neighbours cannot tell:
text that no other page shares but is no article's (reader comments, unique adverts), and hosts of one page.
"""

from __future__ import annotations

import html
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import per_row, table
from tessera.plans.scratch import Scratch

#: A container is template if so large a share of its lines is shared, one at least; a line of another
#: container if so large a share of the host's pages hold it, among so many pages at least.
SHARED, LINE_PAGES = 0.5, 4
#: A shared line counts on a page of another place if so large a share of the host's pages hold it: that of a menu,
#: not that of an article with a few copies. It also bounds the lines of a host that count.
KNOWN = 0.2
#: Marks (template containers and lines of all hosts) that go to every task; beyond it pages are joined with theirs.
BROADCAST_MARKS = 200_000
#: Join partitions over which the pages of a host are dealt.
SALT = 16
#: Words of a container with a doubtful name that is an article's own text on a host without neighbours.
PROSE = 8

_token = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(script|style|noscript|template|textarea|title|svg|math|iframe|object)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?:/>|>.*?(?:</\1\s*>|$))"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_attribute = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_inline = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_containers = frozenset("div section article main nav header footer aside form ul ol dl table figure fieldset dialog menu details blockquote body center button select".split())
_chrome_tags = frozenset("nav footer aside form dialog menu button select head".split())
_chrome_roles = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Names of what is never an article's text, as a whole name or as a part of one (cookie-bar).
_chrome_names = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription"
    " comment comments disqus replies sidebar navbar navigation breadcrumb breadcrumbs footer pagination pager toolbar".split()
)
_chrome_starts = ("comment", "advert", "cookie", "sidebar", "newsletter", "breadcrumb", "navbar", "footer", "popup", "sponsor", "subscri", "disqus", "recommend", "paginat")
#: Names that say so as a whole; as a part (share-prices) they leave it to the difference.
_doubtful_names = frozenset(
    "promo promotion notice notices alert signup login respond reply aside widget widgets menu nav share sharing social related recommended recommendations skip search hidden".split()
)
#: Whole class names of article elements that are not the article, and of those that are only if nothing else is.
_other_articles = frozenset("comment comments reply ad advert advertisement sponsored".split())
_second_articles = frozenset("review promo related teaser".split())
_page_names = frozenset("header masthead topbar".split())


def blocks(page: str | None) -> list[tuple[str, str, str, int]]:
    """(text, zone, container, number of the innermost container's element) of the text blocks in page order.

    zone: main inside an article or main element, second inside an article of another kind, chrome in
    what is never an article's text, doubt in a container whose name only hints at that, else open;
    doubt inside an article is main doubt.
    container: the open containers from the article (or the page) down, with their classes and places among siblings of the same.
    """
    out: list[tuple[str, str, str, int]] = []
    stack: list[tuple[str, str, str, str, int]] = []  # tag, name with classes and place among siblings of that name, chrome or doubt, main or second, number
    born: Counter = Counter()  # children so far of an element, by name
    text: list[str] = []

    def flush():
        if text:
            if line := " ".join(html.unescape("".join(text)).split()):
                main = next((i for i, x in enumerate(stack) if x[3]), None)
                kinds = {x[2] for x in stack}
                zone = "chrome" if "chrome" in kinds else "open" if main is None else "second" if any(x[3] == "second" for x in stack) else "main"
                if "doubt" in kinds and zone in ("main", "open"):
                    zone = "doubt" if zone == "open" else "main doubt"
                out.append((line, zone, ">".join(x[1] for x in stack[main or 0 :]), stack[-1][4] if stack else 0))
            text.clear()

    page, at = page or "", 0
    for m in _token.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag or tag in _inline:
            continue
        flush()
        if tag not in _containers:
            continue
        if m[2]:
            if tag in (open_tags := [x[0] for x in stack]):
                del stack[len(stack) - 1 - open_tags[::-1].index(tag) :]
            continue
        if m[4].endswith("/"):
            continue
        main = tag in ("article", "main")
        inside = any(x[3] for x in stack)
        if main and not inside:  # an element left open does not take the article with it
            while stack and stack[-1][0] in ("nav", "form", "ul", "ol", "menu"):
                stack.pop()
        found = {k.lower(): a or b or c for k, a, b, c in _attribute.findall(m[4])}
        classes = found.get("class", "").lower().split()
        names = {*classes, *found.get("id", "").lower().split()}
        words = set(re.split(r"[^a-z0-9]+", " ".join(names)))
        role = found.get("role", "").lower()
        chrome = (
            tag in _chrome_tags or role in _chrome_roles or bool(words & _chrome_names or names & _doubtful_names) or any(w.startswith(_chrome_starts) for w in words)
            or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
            or not (inside or main) and (tag == "header" or bool(words & _page_names))
        )
        kind = "chrome" if chrome else "doubt" if words & _doubtful_names else ""
        if tag in ("body", "main"):
            kind = ""
        elif tag == "article":
            kind = "" if _other_articles.isdisjoint(classes) else "chrome"
        of = "second" if tag == "article" and not _second_articles.isdisjoint(classes) else "main" if main or role == "main" else ""
        name = ".".join([tag, *sorted(found.get("class", "").split())])
        nth = born[parent := stack[-1][4] if stack else 0, name]
        born[parent, name] += 1
        stack.append((tag, f"{name}[{nth}]", kind, of, at))
    if at < len(page):
        text.append(page[at:])
    flush()
    return out


def address(url: str | None) -> tuple[str, str]:
    """(host, path) in lower case; what cannot be parsed has an empty host."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").lower(), parts.path
    except ValueError:
        return "", url or ""


def _row(a: list[int], b: list[int]) -> list[int]:
    """Length of the longest common subsequence of a and each prefix of b, by bit vectors."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & full
    out = [0]
    for bit in f"{v:0{len(b)}b}"[::-1] if b else "":
        out.append(out[-1] + (bit == "0"))
    return out


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of a and b; memory grows with their lengths alone."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if not x or not y:
        middle = []
    elif len(x) * len(y) <= 1 << 18:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            row, below = best[i], best[i + 1]
            for j in range(len(y) - 1, -1, -1):
                row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
        middle, i, j = [], 0, 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                middle.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    elif len(x) == 1:
        middle = [(0, y.index(x[0]))] if x[0] in y else []
    else:  # the halves of x meet the parts of y at the split with the longest sum
        half = len(x) // 2
        left, right = _row(x[:half], y), _row(x[half:][::-1], y[::-1])
        cut = max(range(len(y) + 1), key=lambda j: left[j] + right[len(y) - j])
        middle = common(x[:half], y[:cut]) + [(i + half, j + cut) for i, j in common(x[half:], y[cut:])]
    ends = [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    return [(k, k) for k in range(head)] + [(i + head, j + head) for i, j in middle] + ends


def key_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


LINES = "key long, host long, address string, path string, page string, lines array<long>, places array<long>"
LINES_SCHEMA = pa.schema(
    [("key", pa.int64()), ("host", pa.int64()), ("address", pa.string()), ("path", pa.string()), ("page", pa.string()), ("lines", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))]
)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The address, hashed lines and hashed containers of each page."""

    def row(key, page, url, text):
        host, path = address(url)
        found = blocks(text)
        return key, key_of(host), host, path, page, [key_of(b[0]) for b in found], [key_of(b[2]) for b in found]

    return per_row(lambda: row, LINES_SCHEMA)(batches)


COUNTS = "host long, place long, line long, n long, same long, address string, path string, page string, last boolean, lines array<long>, places array<long>, range long"
COUNTS_SCHEMA = pa.schema(
    [(n, pa.int64()) for n in ("host", "place", "line", "n", "same")]
    + [("address", pa.string()), ("path", pa.string()), ("page", pa.string()), ("last", pa.bool_()), ("lines", pa.list_(pa.int64())), ("places", pa.list_(pa.int64())), ("range", pa.int64())]
)


def _differences(rows: Iterator[dict], own: bool = True) -> Iterator[pa.RecordBatch]:
    """How often each line stands in each container, and in how many pairs it is shared, from pages in the order of their addresses.

    A line of a page counts once a container. own: whether the pages' lines are counted, not only the shared ones.
    """
    counts: Counter = Counter()
    shared: Counter = Counter()
    last = None

    def flush():
        found = [(h, p, x, counts[h, p, x], shared[h, p, x]) for h, p, x in counts.keys() | shared.keys()]
        counts.clear()
        shared.clear()
        columns = list(zip(*found)) or [()] * 5
        empty = [pa.nulls(len(found), t) for t in COUNTS_SCHEMA.types[5:]]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), *empty], schema=COUNTS_SCHEMA)

    for row in rows:
        host, lines, places = row["host"], row["lines"], row["places"]
        if own:
            counts.update({(host, p, x) for p, x in zip(places, lines)})
        if last and last["host"] == host:
            met = common(last["lines"], lines)
            shared.update({(host, last["places"][i], lines[j]) for i, j in met} | {(host, places[j], lines[j]) for _, j in met})
        last = row
        if len(counts) + len(shared) > 100_000:
            yield flush()
    yield flush()


def _range_differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a range of pages, and its first and last page, which have neighbours in other ranges."""
    ends: list[dict] = []

    def seen():
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    ends[1 if ends else 0 :] = [row] if ends else [row, row]
                    yield row

    yield from _differences(seen())
    if ends:
        kept, name = ("host", "address", "path", "page", "lines", "places"), uuid.uuid4().int >> 65
        rows = [{**{k: r[k] for k in kept}, "last": side, "range": name} for r, side in ((ends[0], False), (ends[-1], True))]
        yield pa.RecordBatch.from_pylist(rows, COUNTS_SCHEMA)


def _border_differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shared lines of pages a and b, which are neighbours in two ranges."""
    for batch in batches:
        for at in range(batch.num_rows):
            for row in batch.slice(at, 1).to_pylist():
                yield from _differences(iter([row["a"], row["b"]]), own=False)


def _borders(ends: DataFrame) -> DataFrame:
    """Columns a, b: the last page of each range and the first page of the next one, where they are of one host.

    Only the addresses of two pages a range are put in order in one task; their lines are joined to them.
    """
    order = Window.orderBy("address", "path", "page", "last")
    small = ends.select("address", "path", "page", "last", "range", "host")
    met = small.withColumn("next", F.lead(F.struct("range", "last", "host")).over(order)).where(F.col("last") & ~F.col("next.last") & (F.col("host") == F.col("next.host")))
    row = F.struct("host", "lines", "places")
    a, b = (ends.where(F.col("last") == side).select(F.col("range").alias(of), row.alias(name)) for side, of, name in ((True, "range", "a"), (False, "other", "b")))
    return met.select("range", F.col("next.range").alias("other")).join(a, "range").join(b, "other").select("a", "b")


def templates(seen: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns host, mark: hashes of the template containers and shared lines of each host; those of lines that are template anywhere also inverted.

    seen: the rows of ``LINES``. Pages are dealt by ranges of their addresses, so a large host fills
    many tasks; only hashes of lines travel, counted before they do. The last page of a range meets
    the first one of the next range.
    """
    order = ("address", "path", "page", "key")
    dealt = seen.repartitionByRange(*order).sortWithinPartitions(*order)
    met = scratch.save(dealt.select(*order, "host", "lines", "places").mapInArrow(_range_differences, COUNTS), "differences")
    counts = met.where("last is null").unionByName(_borders(met.where("last is not null")).mapInArrow(_border_differences, COUNTS))
    lines = counts.groupBy("host", "place", "line").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    lines = lines.groupBy("host", "place", F.when(F.col("same") > 0, F.col("line")).alias("line")).agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    found = scratch.save(lines, "lines")
    place = found.groupBy("host", "place").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("same") > 0, F.col("n")).otherwise(0)).alias("same"))
    place = place.where((F.col("same") > 0) & (F.col("same") >= SHARED * F.col("n"))).select("host", F.col("place").alias("mark"))
    pages = seen.groupBy("host").agg(F.count("*").alias("pages"))
    line = found.where("same > 0").groupBy("host", "line").agg(F.sum("n").alias("n")).join(pages, "host").where(F.col("n") >= KNOWN * F.col("pages"))
    often = line.where((F.col("pages") >= LINE_PAGES) & (F.col("n") >= SHARED * F.col("pages"))).select("host", F.bitwise_not("line").alias("mark"))
    return scratch.save(place.unionByName(line.select("host", F.col("line").alias("mark"))).unionByName(often).distinct(), "templates")


def main_text(page: str | None, marks: frozenset[int] = frozenset(), alone: bool = True) -> str:
    """The article of a page: its blocks without template and without what tags and names rule out.

    marks: those of ``templates`` for the page's host; alone: the host has no other page.
    """
    found = blocks(page)
    lines = [key_of(b[0]) for b in found]
    places = {c: key_of(c) in marks for _, _, c, _ in found}
    held: Counter = Counter(b[3] for b in found)
    known: Counter = Counter(b[3] for b, x in zip(found, lines) if x in marks)
    template = [places[b[2]] or known[b[3]] >= SHARED * held[b[3]] for b in found]
    zones = [b[1] for b in found]
    size = lambda at: sum(len(found[i][0]) for i in at)

    own = [i for i, z in enumerate(zones) if z.startswith("main")] or [i for i, z in enumerate(zones) if z == "second"]
    if own:
        # the article element itself is no template, whatever its pages share
        body = [i for i in own if not template[i] or re.match(r"\w*", found[i][2].split(">")[-1])[0] in ("article", "main")]
        if 2 * size(body) < size(own):  # neighbours with the same article share it whole
            body = own
    else:
        own = [i for i, z in enumerate(zones) if z in ("open", "doubt")]
        body = [i for i in own if not template[i]]
        if not body:  # nothing but shared text: the largest container is what the page is about
            sizes: Counter = Counter()
            for i in own:
                sizes[found[i][2]] += len(found[i][0])
            largest = max(sizes, key=lambda c: (sizes[c], c), default="")
            body = [i for i in own if found[i][2] == largest]
        plain = [i for i in body if ~lines[i] not in marks]
        if 2 * size(plain) >= size(body):
            body = plain
    words: Counter = Counter()
    for i in body:
        words[found[i][3]] += len(found[i][0].split())
    # a doubtful name goes by the difference; without one, and outside an article, by whether its text is prose
    sure = lambda i: "doubt" not in zones[i] or (zones[i] == "main doubt" and not alone) or words[found[i][3]] >= PROSE
    return " ".join(found[i][0] for i in body if sure(i))


def extract(pages: DataFrame, broadcast_marks: int = BROADCAST_MARKS, differencing: bool = True) -> DataFrame:
    """Columns page_id, url, text, n_chars for every row of pages (page_id, url, html).

    text: character references decoded, white space of each block as one space, blocks joined by one
    space; empty for a null or empty html and for a page without an article's text. Pages of null or
    odd urls form a host of their own. Equal rows get equal results; pages of equal urls are ordered
    by page_id and content; other columns are ignored; an empty table gives an empty result. A very
    long page is compared whole, in memory that grows with its lines alone. Html is parsed twice.
    broadcast_marks: so many template marks of all hosts go to every task; more are joined with their
    pages. differencing: False leaves pages to their tags and names.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "pages")
    kind = dict(pages.dtypes)["page_id"]
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html")).withColumn("key", F.xxhash64("page_id", "url", "html"))
    types = [pa.string(), pa.int64()]

    def texts(part: pa.RecordBatch, marks) -> pa.RecordBatch:
        found = [main_text(h, *marks(i, u)) for i, (h, u) in enumerate(zip(part.column("html").to_pylist(), part.column("url").to_pylist()))]
        columns = [pa.array(c, t) for c, t in zip((found, [len(t) for t in found]), types)]
        return pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *columns], names=["page_id", "url", "text", "n_chars"])

    out = f"page_id {kind}, url string, text string, n_chars long"
    if not differencing:

        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    yield texts(batch.slice(at, 256), lambda i, u: ())

        return pages.mapInArrow(plain, out)

    seen = scratch.save(pages.select("key", F.col("page_id").cast("string"), "url", "html").mapInArrow(_lines, LINES), "lines")
    marks = templates(seen, scratch)
    lonely = seen.groupBy("host").agg(F.count("*").alias("pages")).where("pages = 1").select("host")
    n_marks, n_lonely = marks.count(), lonely.count()

    if n_marks + n_lonely <= broadcast_marks:
        of_host: dict[int, set[int]] = {}
        for r in marks.collect():
            of_host.setdefault(r["host"], set()).add(r["mark"])
        shared = spark.sparkContext.broadcast(({h: frozenset(m) for h, m in of_host.items()}, {r["host"] for r in lonely.collect()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, single = shared.value

            def of(i, url):
                host = key_of(address(url)[0])
                return known.get(host, frozenset()), host in single

            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    yield texts(batch.slice(at, 256), of)

        return pages.mapInArrow(run, out)

    # a host's pages are dealt over SALT partitions, and its marks are repeated there
    salt = F.pmod("key", F.lit(SALT)).cast("int").alias("salt")
    own = seen.select("key", "host", salt, F.explode(F.array_distinct(F.concat("lines", F.transform("lines", F.bitwise_not), "places"))).alias("mark")).distinct()
    copies = marks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    of_page = own.join(copies, ["host", "mark", "salt"]).groupBy("key").agg(F.collect_list("mark").alias("marks"))
    alone = seen.select("key", "host").distinct().join(lonely, "host").select("key", F.lit(True).alias("alone"))
    joined = pages.join(scratch.save(of_page.join(alone, "key", "full"), "of_page"), "key", "left").select("page_id", "url", "html", "marks", "alone")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, single = part.column("marks").to_pylist(), part.column("alone").to_pylist()
                yield texts(part, lambda i, u: (frozenset(found[i] or ()), bool(single[i])))

    return joined.mapInArrow(run_joined, out)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
