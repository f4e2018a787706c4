"""Main text of web pages by nearest-URL page differencing.

1. Every page becomes its text lines, one a block. A line is chrome if an element around it says so by its name, role,
   or a word of its class or id (menus, headers, footers, sidebars, notices, adverts, forms, reader comments); it is main
   if it lies in an ``article`` or else ``main`` element; all others are open.
2. Pages of a host are sorted by URL path. The page with the longest common path prefix is then the one before or after.
   Only hashes of lines are sorted and compared, in ranges of pages whose borders overlap by one page, so a host with a
   third of all pages is spread like any other.
3. The lines of both pages are aligned by a longest common subsequence, whatever their kind and whether or not the page
   declares an article. Shared lines are to be deleted. If hardly anything but shared lines makes up a page, the two are
   copies and say nothing about chrome; then the other neighbour is asked, and if that is a copy too, the pages before and
   after the whole run of copies are. Only where these are copies too, or of another host, nothing is deleted.
4. The elements check what is deleted and what is left: shared main lines are put back (``protect``), as pages quote, and
   repeat, passages of articles; and chrome goes although no neighbour has it. Where a page declares an article its main
   lines are its text, else its open lines are.

A null page is empty; a null URL, or one without a host, belongs to the host of an empty name. Rows that repeat id, URL and
page are one page among the neighbours, and each gets its text. Tags that are never closed end with the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadscope.llm.common import checkpoint, query, shuffle_partitions, small_batches, table, utf8

CHROME, OPEN, MAIN = 0, 1, 2
COPY = 0.9  # share of a page's own text in shared lines from which two pages are copies
RANGE = 256  # pages of one task's range
BUCKET = 1 << 16  # pages whose runs of copies are followed at a time
SMALL = 16 << 20  # bytes of deletion lists that may be broadcast

# Fixed values of HTML: names of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
BLOCK = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul").split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends an open element of the second set, unless one of the third set lies between.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ol ul menu dir".split())), "dd": (frozenset("dd dt".split()), frozenset(["dl"])),
    "dt": (frozenset("dd dt".split()), frozenset(["dl"])), "option": (frozenset(["option"]), frozenset(["select"])),
    "td": (frozenset("td th".split()), frozenset(["table"])), "th": (frozenset("td th".split()), frozenset(["table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
}
SCOPE = frozenset("html table td th caption button object".split())
# Elements, roles and words of classes and ids that tell chrome.
CHROME_TAGS = frozenset("aside button canvas datalist dialog footer form head math menu nav object search select svg template".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
CHROME_WORDS = frozenset((
    "ad ads advert advertisement advertising adverts adsense banner breadcrumb breadcrumbs captcha comment comments consent cookie "
    "cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "overlay pager pagination popup promo promotion recommended related replies respond share sharebar sharing sidebar sidenav signup "
    "skip social sponsor sponsored subscribe subscription toolbar topbar widget").split())
#: Elements hinted by these stay chrome even if an article lies inside.
STRONG_WORDS = frozenset("comment comments consent cookie cookies disqus newsletter recommended related replies respond".split())
COMMENT_CLASSES = frozenset("comment reply".split())
NEGATED = frozenset("has no with without".split())
UNHINTED = frozenset("html body main article".split())

TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TELLING = re.compile(r"class|id\b|role|hidden|display\s*:\s*none", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def hinted(attributes: str, name: str) -> int:
    """Whether the attributes say that the element is chrome or hidden: 2 surely, 1 unless an article lies inside, 0 not."""
    found = 0
    if not TELLING.search(attributes):
        return found
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 2
        if key == "role" and value.lower() in CHROME_ROLES:
            return 2
        if key in ("class", "id"):
            for word in html.unescape(value).split():
                if name in UNHINTED:
                    found = max(found, 2 * (name == "article" and word.lower() in COMMENT_CLASSES))
                    continue
                parts = [w.lower() for w in WORD.findall(word)]
                told = {p for i, p in enumerate(parts) if p in CHROME_WORDS and (i == 0 or parts[i - 1] not in NEGATED)}
                told |= {"".join(parts)} & CHROME_WORDS  # sideBar
                found = max(found, 2 if told & STRONG_WORDS else 1 if told else 0)
    return found


def lines(page: str | None) -> list[tuple[str, int]]:
    """(text, kind) of the blocks of a page, in page order."""
    page = page or ""
    names: list[str] = []  # open elements
    n_open: Counter = Counter()  # of each name
    states: list[tuple[int, int]] = [(0, 0)]  # of each: depth of chrome (2: not undone by an article inside), number of its article
    text: list[str] = []
    aside: list[str] = []
    out: list[list] = []
    titled, articles, has_main = set(), 0, False

    def flush():
        for buffer, chrome in ((aside, True), (text, False)):
            if buffer:
                line = " ".join("".join(buffer).split())
                if line:
                    out.append([line, CHROME if chrome else OPEN, states[-1][1]])
                buffer.clear()

    def say(raw: str):
        (aside if states[-1][0] else text).append(html.unescape(raw) if "&" in raw else raw)

    def pop(i: int):
        n_open.subtract(names[i:])
        del names[i:], states[i + 1:]

    def close(found: frozenset, border: frozenset):
        """End the innermost of the elements ``found`` that is open inside the ``border``."""
        if not any(n_open[x] for x in found):
            return
        for i in range(len(names) - 1, -1, -1):
            if names[i] in found:
                return pop(i)
            if names[i] in border:
                return

    at = 0
    while True:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at:m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue  # a comment or a declaration
        if m[1]:  # an end tag
            if name == "br":
                say(" ")
            elif name in BLOCK:
                flush()
                close(frozenset([name]), frozenset())
            else:
                close(frozenset([name]), BLOCK)  # of an inline element: not beyond its block
            continue
        if not page.endswith(">", m.start(), m.end()):
            break  # the page ends within a tag
        if name == "br":
            say(" ")
            continue
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            if end is None:
                break
            at = end.start()
            at = page.find(">", at) + 1 or len(page)
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES:
                close(*CLOSES[name])
            close(frozenset(["p"]), SCOPE)
            if name in HEADINGS and names and names[-1] in HEADINGS:
                pop(len(names) - 1)
        if name in VOID:
            continue
        chrome, article = states[-1]
        attributes = m[3]
        declares = name in ("article", "main") or "main" in attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I)
        if declares and chrome < 2:
            if article > 0 and name == "article":
                chrome = 1  # an article inside an article is a reader's comment
            else:
                states[:] = [(c if c > 1 else 0, a) for c, a in states]  # a wrapper, after all
                chrome = 0
                if name == "article":
                    articles += 1
                    article = articles
                elif article == 0:
                    has_main, article = True, -1  # in the main element, outside any article
        if name in CHROME_TAGS or name == "header" and not article:
            chrome = 2
        elif chrome < 2 and not (article and name in HEADINGS):
            chrome = max(chrome, hinted(attributes, name))
        if name == "h1" and article > 0 and not chrome:
            titled.add(article)
        if name in BLOCK or chrome:
            names.append(name)
            n_open[name] += 1
            states.append((chrome, article))
    flush()
    told = {a for line, kind, a in out if kind == OPEN and a > 0}
    wanted = (titled & told or told) or ({-1} if has_main else set())
    return [(line, MAIN if kind == OPEN and a in wanted else kind) for line, kind, a in out]


# --- alignment ----------------------------------------------------------------------------------------------------
def rows_of_bits(a: list, b: list) -> Iterator[int]:
    """After each element of ``a``, an integer whose bit j is 0 where the common subsequence with b[:j + 1] is longer than with b[:j]."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        met = row & where.get(x, 0)
        row = (row + met | row - met) & full
        yield row


def lengths(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and b[:j], for each j."""
    row = (1 << len(b)) - 1
    for row in rows_of_bits(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.append(0, np.cumsum(bits == 0))


def common(a: list, b: list, limit: int = 1 << 30) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence. Beyond ``limit`` cells ``a`` is halved first, so that memory stays bounded."""
    if not a or not b:
        return []
    if len(a) * len(b) > limit and len(a) > 1:
        half = len(a) // 2
        total = lengths(a[:half], b) + lengths(a[:half - 1:-1], b[::-1])[::-1]
        cut = int(np.argmax(total))
        return common(a[:half], b[:cut], limit) + [(i + half, j + cut) for i, j in common(a[half:], b[cut:], limit)]
    rows, pairs = list(rows_of_bits(a, b)), []
    i, j = len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            pairs.append((i, j))
            i, j = i - 1, j - 1
    return pairs[::-1]


def shared(a: list, b: list) -> list[tuple[int, int]]:
    """:func:`common` after equal ends and the elements that only one side has are set aside."""
    start, stop = 0, 0
    least = min(len(a), len(b))
    while start < least and a[start] == b[start]:
        start += 1
    while stop < least - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    both = set(a[start:len(a) - stop]) & set(b[start:len(b) - stop])
    at_a = [i for i in range(start, len(a) - stop) if a[i] in both]
    at_b = [j for j in range(start, len(b) - stop) if b[j] in both]
    inner = [(at_a[i], at_b[j]) for i, j in common([a[i] for i in at_a], [b[j] for j in at_b])]
    ends = [(len(a) - k, len(b) - k) for k in range(stop, 0, -1)]
    return [(i, i) for i in range(start)] + inner + ends


class Page:
    """Line hashes, kinds and sizes of one page, with what sorts it."""

    def __init__(self, row: dict) -> None:
        self.__dict__.update(row)

    def own(self, use: int) -> int:
        """Code points that may be text: main lines, or open ones where there are none."""
        return sum(n for n, k in zip(self.sizes, self.kinds) if k >= use)

    def shared_with(self, other: Page) -> list[int] | None:
        """Lines that the other page has too; None if the two are copies."""
        pairs = shared(self.hashes, other.hashes)
        sides = ((self, [i for i, _ in pairs]), (other, [j for _, j in pairs]))
        for page, met in sides:
            use = MAIN if MAIN in page.kinds else OPEN
            if (own := page.own(use)) and sum(page.sizes[i] for i in met if page.kinds[i] >= use) >= COPY * own:
                return None
        return sides[0][1]


def prefix(a: str, b: str) -> int:
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return n


def deletions(page: Page, around: list[Page]) -> list[int] | None:
    """Lines of ``page`` that its nearest page that is no copy shares; None if all of its host are copies."""
    near = sorted((p for p in around if p.host == page.host), key=lambda p: -prefix(p.path, page.path))  # stable: before, then after
    if not page.kinds or not near:
        return []
    return next((found for p in near if (found := page.shared_with(p)) is not None), None)


LINES = "key binary, host string, path string, hashes array<long>, kinds array<int>, sizes array<int>"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "html", 4 << 20):
        found = [lines(h) for h in batch.column("html").to_pylist()]
        hashes = [np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "replace")) for t, _ in x], np.uint64).view(np.int64) for x in found]
        columns = [*(batch.column(c) for c in ("key", "host", "path")), pa.array(hashes, pa.list_(pa.int64())),
                   pa.array([[k for _, k in x] for x in found], pa.list_(pa.int32())), pa.array([[len(t) for t, _ in x] for x in found], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "host", "path", "hashes", "kinds", "sizes"])


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[Page]:
    for batch in batches:
        for row in batch.to_pylist():
            yield Page(row)


COMPARED = "key binary, drop array<int>, rank long, opens boolean, ends boolean"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deletions of the pages of each range, which follow one another with two pages of context at both ends.

    A page among copies has none yet (null); of those that follow one another it says which opens and which ends the run.
    """
    def found(near: list[Page | None], i: int) -> list[int] | None:
        page = near[i]
        if page is None:
            return []
        return deletions(page, [p for p in (near[i - 1], near[i + 1]) if p is not None])

    def rows():
        near: list[Page | None] = [None] * 5
        for page in chain(_pages(batches), [None, None]):
            near = [*near[1:], page]
            if (middle := near[2]) is not None and middle.home:
                yield [p if p is not None and p.part == middle.part and p.rank - middle.rank == i - 2 else None for i, p in enumerate(near)]

    for near in rows():
        if (drop := found(near, 2)) or drop is None:
            opens, ends = (drop is None and found(near, i) is not None for i in (1, 3))
            yield pa.RecordBatch.from_arrays([pa.array([near[2].key], pa.binary()), pa.array([drop], pa.list_(pa.int32())), pa.array([near[2].rank], pa.int64()),
                                              pa.array([opens]), pa.array([ends])], ["key", "drop", "rank", "opens", "ends"])


def _compare_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deletions of pages among copies; a range begins with the pages before and after its runs."""
    part, held = None, {}
    for page in _pages(batches):
        if page.part != part:
            part, held = page.part, {}
        if not page.home:
            held[page.rank] = page
        elif drop := deletions(page, [held[r] for r in (page.before, page.after) if r in held]):
            yield pa.RecordBatch.from_arrays([pa.array([page.key], pa.binary()), pa.array([drop], pa.list_(pa.int32()))], ["key", "drop"])


def _texts(kept: list[str], protect: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "html", 4 << 20):
        texts = []
        for page, drop in zip(batch.column("html").to_pylist(), batch.column("drop").to_pylist()):
            found, gone = lines(page), set(drop or ())
            use = MAIN if any(k == MAIN for _, k in found) else OPEN
            texts.append("\n".join(t for i, (t, k) in enumerate(found) if k == use and (i not in gone or k == MAIN and protect)))
        n_shared = [len(d or ()) for d in batch.column("drop").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_shared, pa.int32())],
                                         [*kept, "text", "n_chars", "n_shared"])


def shared_lines(pages: DataFrame) -> DataFrame:
    """(key, drop): numbers of the lines that a page shares with its nearest page, of pages that have some, as a checkpoint.
    ``pages`` (key, url, html)."""
    spark = pages.sparkSession
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)"
    # Below every character of a path is the mark between its segments, so that a folder's pages are neighbours.
    path = F.translate(F.regexp_extract("url", parts, 2), "/", "\x01")
    named = pages.select("key", F.lower(F.regexp_extract("url", parts, 1)).alias("host"), path.alias("path"), "html")
    order = ["host", "path", "key"]
    once = named.mapInArrow(_lines, LINES).dropDuplicates(["key"])
    ordered = checkpoint(once.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order))
    # Ranks: a row's place in its partition, after the sizes of all partitions before it.
    placed = ordered.withColumns({"p": F.spark_partition_id(), "i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = sorted((r["p"], r["n"]) for r in placed.groupBy("p").agg(F.count("*").alias("n")).collect())  # one row a partition
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    ranked = placed.join(F.broadcast(spark.createDataFrame(starts, "p int, start long")), "p").withColumn("rank", F.col("start") + F.col("i"))
    range_of = lambda r: F.floor(r / RANGE)
    copies = F.array_distinct(F.array(*[range_of(F.col("rank") + d) for d in (-2, -1, 0, 1, 2)]))
    dealt = ranked.select("key", "host", "path", "hashes", "kinds", "sizes", "rank", F.explode(copies).alias("part"))
    dealt = dealt.withColumn("home", F.col("part") == range_of(F.col("rank")))
    dealt = dealt.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "rank")
    compared = checkpoint(dealt.mapInArrow(_compare, COMPARED))
    told, among = compared.filter("drop is not null").select("key", "drop"), compared.filter("drop is null")
    if among.isEmpty():
        return told
    return checkpoint(told.unionByName(_among_copies(ranked, among, range_of)))


def _among_copies(ranked: DataFrame, among: DataFrame, range_of) -> DataFrame:
    """(key, drop) of pages ``among`` copies: the first of a run follows a copy that is no such page, so the page two before it
    is no copy, and so at the end. The run's ends are filled in by buckets of ranks; what goes on beyond them is one row a bucket."""
    among = among.select("rank", F.when(F.col("opens"), F.col("rank")).alias("first"), F.when(F.col("ends"), F.col("rank")).alias("last"),
                         F.floor(F.col("rank") / BUCKET).alias("bucket"))
    inside, across = Window.partitionBy("bucket").orderBy("rank"), Window.orderBy("bucket")
    rest = (0, Window.unboundedFollowing)
    buckets = among.groupBy("bucket").agg(F.max("first").alias("first"), F.min("last").alias("last")).select(
        "bucket", F.last("first", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.first("last", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    asks = among.select("rank", "bucket", F.last("first", True).over(inside).alias("first"), F.first("last", True).over(inside.rowsBetween(*rest)).alias("last"))
    asks = asks.join(buckets, "bucket").select(
        "rank", range_of(F.col("rank")).alias("part"), (F.coalesce("first", "earlier") - 2).alias("before"), (F.coalesce("last", "later") + 2).alias("after"))
    asked = asks.select("part", F.explode(F.array("before", "after")).alias("rank")).distinct()
    pages = ranked.select("key", "host", "path", "hashes", "kinds", "sizes", "rank")
    rows = pages.join(asks, "rank").withColumn("home", F.lit(True)).unionByName(pages.join(asked, "rank").withColumn("home", F.lit(False)), allowMissingColumns=True)
    rows = rows.repartition(shuffle_partitions(ranked.sparkSession), "part").sortWithinPartitions("part", "home", "rank")
    return rows.mapInArrow(_compare_run, "key binary, drop array<int>")


def main_text(pages: DataFrame, protect: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared) of every page; n_shared counts the lines that the nearest page shares."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", utf8(pages["html"]).alias("html"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat_ws("\x00", one("page_id"), one("url"), one("html")))))
    drops = shared_lines(rows.select("key", one("url").alias("url"), "html"))
    held = drops.agg(F.sum(F.size("drop") * 4 + 64)).first()[0] or 0
    joined = rows.join(F.broadcast(drops) if held <= SMALL else drops, "key", "left")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return joined.select("page_id", "url", "html", "drop").mapInArrow(
        partial(_texts, ["page_id", "url"], protect), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_shared int")


@query("op12_html")
def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
