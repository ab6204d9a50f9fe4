"""Main text of web pages by nearest-URL page differencing.

Pages with the same lines on one host are one content.  Contents are numbered
in the order of host and URL path over range partitions, and met in blocks of
this order that overlap, so that a host of any size is spread over many tasks
and no border between tasks decides anything.  Each content is paired with the
nearest ones of its host before and after it that are no near copies of it.
All text lines of both pages, menus and notices included, are aligned by their
longest common subsequence, and the lines that the page shares with the partner
of the nearest path are deleted: they belong to the site, not to the page.

Differencing has two blind spots, which markup fills.  Text that two articles
share is no site line: a shared paragraph, heading or the like inside an article
or main element stays, and other lines in there go only if both partners share
them.  And a menu, advert or reader comment that only one page has isn't shared:
lines inside menus, page headers, footers, sidebars, notices, adverts, forms and
comments, told by elements, roles, classes and ids, go as well; inside an article
a word that prose uses, too ("discussion", "notice"), isn't enough as an id or on
a paragraph.  Scripts, styles, drawings and the like are no text; formulas and
what stands in for an object are.

Defined cases: null and empty pages have empty text; a null or odd URL has the
empty host; a page without another content of its host keeps its lines but for
those that the markup names; unclosed and stray tags are tolerated; repeated
rows each give a row, and copies have the same text; near copies share nine
tenths of their paragraphs' and headings' characters, or of all where neither
has any; very long pages are read whole; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, staged, table

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'<>]|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|$)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")

RAW = frozenset("script style noscript template textarea iframe title".split())
CHROME = frozenset("nav footer aside form dialog menu button select fieldset head svg".split())
CONTAINERS = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose lines differencing leaves alone inside an article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dt dd td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCK = frozenset(["p"])
#: Contents that meet at once, and how far a block reaches over its borders at first.
BLOCK_ROWS, REACH = 2000, 50
#: Elements whose start ends an open one of the same group.
PEERS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Parts of classes and ids that mark what isn't the article.
CHROME_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "sidebar sidebars footer masthead topbar cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended comment comments commentlist disqus respond reply replies discussion widget widgets pagination pager toolbar skip alert banner copyright".split()
)
#: Those that are words of prose, too: as an id, or on an element of an article's text, one of them alone tells nothing.
PROSE_NAMES = frozenset("notice notices discussion related recommended social respond reply replies response alert banner copyright subscription signup login share sharing promotion menu skip overlay".split())
ARTICLE_NAMES = frozenset("article main content post entry".split())
HEADER_NAMES = frozenset(["header"])
BOX_WORDS = frozenset(
    "area articles article bar block bottom box btn col column container content desktop entry field footer global group head header icon inner item items label left link links list "
    "main mobile module outer page panel post posts primary right row secondary section site slot sticky text title top unit wrap wrapper zone".split()
)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(raw)} if raw.strip(" /\n\t") else {}


def _named(attrs: dict[str, str], names: frozenset[str], prose: bool = False, in_article: bool = False) -> bool:
    """A class or id consists of these names and of words for boxes and places only: 'ad-slot-2', not 'related-work'.

    Inside an article a single word of ``PROSE_NAMES`` doesn't count as an id, nor on an element of ``prose``.
    """
    for kind in ("class", "id"):
        for token in attrs.get(kind, "").split():
            parts = {p for p in _SPLIT.split(_CAMEL.sub(r"\1-\2", token).lower()) if p and not p.isdigit()}
            if parts & names and parts <= names | BOX_WORDS:
                if not (in_article and len(parts) == 1 and parts <= PROSE_NAMES and (kind == "id" or prose)):
                    return True
    return False


def _is_chrome(name: str, attrs: dict[str, str], in_article: bool) -> bool:
    if name in ("html", "body") or name in CONTAINERS and not attrs:
        return False
    if name in CHROME or name == "header" and not in_article:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if name not in CONTAINERS and attrs.get("role", "").lower() in CHROME_ROLES:
        return True
    if name in CONTAINERS and _named(attrs, ARTICLE_NAMES):
        return False
    return _named(attrs, CHROME_NAMES, name in PROSE or name == "section", in_article) or not in_article and _named(attrs, HEADER_NAMES)


def blocks(page: str) -> list[tuple[str, bool]]:
    """(text, inside an article) of the page's blocks that aren't chrome, in page order."""
    return [(line, inside) for line, hidden, inside, _ in _lines(page) if not hidden]


def _lines(page: str) -> list[tuple[str, bool, bool, bool]]:
    """(text, chrome, inside an article, inside an element of PROSE) of the page's blocks, in page order."""
    out: list[tuple[str, bool, bool, bool]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, chrome, inside an article
    chrome = article = False

    def flush() -> None:
        if text:
            if line := " ".join(html.unescape("".join(text)).split()):
                out.append((line, chrome, article, any(x[0] in PROSE for x in stack)))
            text.clear()

    def pop_to(k: int) -> None:
        nonlocal chrome, article
        now = (stack[k - 1][1], stack[k - 1][2]) if k else (False, False)
        if now[0] != chrome:
            flush()
        del stack[k:]
        chrome, article = now

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        text.append(page[at : m.start() if m else n])
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if stack[k][0] in ("td", "th", "table") and name not in BLOCKS:
                    break
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if name == "br":
            text.append(" ")
            continue
        is_block = name in BLOCKS
        if is_block:
            flush()
            if stack and stack[-1][0] in CLOSED_BY_BLOCK:
                pop_to(len(stack) - 1)
            if name in PEERS and stack and stack[-1][0] in PEERS[name].split():
                pop_to(len(stack) - 1)
                if name == "tr" and stack and stack[-1][0] == "tr":
                    pop_to(len(stack) - 1)
            if name == "body":  # the head ends here at last
                while stack and stack[-1][0] != "html":
                    pop_to(len(stack) - 1)
        if name in VOID or m[3].rstrip().endswith("/") and not is_block:
            continue
        attrs = _attributes(m[3])
        hide = chrome or _is_chrome(name, attrs, article)
        inside = article or name in CONTAINERS or attrs.get("role") == "main" or attrs.get("itemprop") == "articleBody"
        if is_block or hide != chrome or inside != article or name in CHROME:
            if not is_block and hide != chrome:
                flush()
            stack.append((name, hide, inside))
            chrome, article = hide, inside
    flush()
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(a) - tail, len(a))}
    inner, other = a[head : len(a) - tail], b[head : len(b) - tail]
    counts = Counter(other)
    aligned = _aligned_pairs if sum(counts[x] for x in inner) <= PAIRS_A_LINE * (len(a) + len(b)) else _aligned_bits
    return found | {head + i for i in aligned(inner, other)}


#: Above so many equal pairs for each line, lines are aligned by bits, which doesn't list pairs.
PAIRS_A_LINE = 20


def _aligned_pairs(a: list[str], b: list[str]) -> list[int]:
    """By the pairs of equal lines, quick where lines are rarely repeated."""
    where: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    # the last position in b, and the chain that leads to it, of the best subsequence of each length
    ends: list[int] = []
    chains: list[tuple] = []
    for i, line in enumerate(a):
        for j in where.get(line, ()):
            k = bisect_left(ends, j)
            chain = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(chain)
            else:
                ends[k], chains[k] = j, chain
    out, chain = [], chains[-1] if chains else None
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return out


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of ``a`` with each beginning of ``b``, by one sum over a row's bits for each line."""
    places: dict[str, int] = {}
    for j, line in enumerate(b):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for line in a:
        hit = row & places.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _aligned_bits(a: list[str], b: list[str]) -> list[int]:
    """By halves: ``b`` is cut where the halves of ``a`` have most in common with it; memory in proportion to the lines."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append(a0)
            continue
        mid = (a0 + a1) // 2
        before, after = _lengths(a[a0:mid], b[b0:b1]), _lengths(a[mid:a1][::-1], b[b0:b1][::-1])
        cut = b0 + int(np.argmax(before + after[::-1]))
        todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return out


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _near_copy(a: dict, b: dict) -> bool:
    kind = "prose" if a["prose"] or b["prose"] else "all"
    x, y = a[kind], b[kind]
    shared = sum(n for line, n in x.items() if line in y)
    return 10 * shared >= 9 * max(sum(x.values()), sum(y.values()))


def _gone(page: dict, partners: list[dict]) -> list[int]:
    """Positions of the lines that differencing deletes, among those that aren't chrome."""
    if not partners:
        return []
    shared = [shared_lines(page["lines"], x["lines"]) for x in partners]
    near = shared[max(range(len(partners)), key=lambda k: _common_prefix(partners[k]["path"], page["path"]))]
    every = set.intersection(*shared) if len(shared) > 1 else set()
    own = [i for i, hidden in enumerate(page["chrome"]) if not hidden]
    # inside an article prose stays, and the rest goes only if both partners have it
    return [k for k, i in enumerate(own) if (i in every and not page["in_prose"][i] if page["inside"][i] else i in near)]


def _skips(host: list[dict], step: int) -> list[int]:
    """For each content the next one in the direction ``step`` that is no near copy; -1: none."""
    out = [-1] * len(host)
    for i in range(len(host)) if step < 0 else range(len(host) - 1, -1, -1):
        j = i + step if 0 <= i + step < len(host) else -1
        while j >= 0 and _near_copy(host[i], host[j]):
            j = out[j]
        out[i] = j
    return out


def _paired(host: list[dict], whole_left: bool, whole_right: bool):
    """(content, partners, open) of one host's contents in order; open: what a further look over the block's borders may change."""
    left, right = _skips(host, -1), _skips(host, 1)
    for i, page in enumerate(host):
        if not page["mine"]:
            continue
        after, before = right[i], left[i]
        partners, ends = [j for j in (after, before) if j >= 0], after < 0 and not whole_right or before < 0 and not whole_left
        if len(partners) == 1 and not ends:  # the other side has none: a second one of this side
            skip = left if before >= 0 else right
            j = skip[partners[0]]
            while j >= 0 and _near_copy(page, host[j]):
                j = skip[j]
            if j >= 0:
                partners.append(j)
            else:
                ends = not (whole_left if before >= 0 else whole_right)
        yield page, [host[j] for j in partners], ends


def _difference(total: int):
    def run(block: pa.Table) -> pa.Table:
        rows = sorted(block.to_pylist(), key=lambda x: x["idx"])
        out, at = [], 0
        for x in rows:
            own = [(line, n, is_prose) for line, n, hidden, is_prose in zip(x["lines"], x["sizes"], x["chrome"], x["in_prose"], strict=True) if not hidden]
            x["all"] = {line: n for line, n, _ in own}
            x["prose"] = {line: n for line, n, is_prose in own if is_prose}
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end]["host"] == rows[at]["host"]:
                end += 1
            for page, partners, ends in _paired(rows[at:end], at > 0 or rows[0]["idx"] == 0, end < len(rows) or rows[-1]["idx"] == total - 1):
                out.append((page["idx"], page["host"], page["digest"], [] if ends else _gone(page, partners), ends))
            at = end
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.bool_()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["idx", "host", "digest", "gone", "open"])

    return run


def _deleted(contents: DataFrame) -> DataFrame:
    """host, digest, gone of the contents of which lines are deleted."""
    spark = contents.sparkSession
    order = ["host", "path", "page_id", "digest"]
    placed = contents.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    placed = staged(placed.drop("page_id"), "html-contents")
    total, offsets = 0, []
    for part, n in sorted(tuple(x) for x in placed.groupBy("part").count().collect()):
        offsets.append((part, total))
        total += n
    first = F.broadcast(spark.createDataFrame(offsets, "part int, first bigint"))
    rows = placed.join(first, "part").withColumn("idx", F.col("first") + F.col("row").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "row", "first")
    done, todo, reach = None, None, REACH
    while True:
        size = max(BLOCK_ROWS, 4 * reach)
        block = lambda x: F.floor(x / F.lit(size)).cast("bigint")  # noqa: B023, E731
        met = rows.withColumn("mine", F.lit(True)) if todo is None else rows.join(todo.select("idx", F.lit(True).alias("asked")), "idx", "left").withColumn("mine", F.coalesce("asked", F.lit(False))).drop("asked")
        met = met.withColumn("block", F.explode(F.sequence(block(F.greatest(F.col("idx") - reach, F.lit(0))), block(F.col("idx") + reach))))
        if todo is not None:
            met = met.join(todo.select(block(F.col("idx")).alias("block")).distinct(), "block", "left_semi")
        met = met.withColumn("mine", F.col("mine") & (F.col("block") == block(F.col("idx"))))
        out = met.groupBy("block").applyInArrow(_difference(total), "idx bigint, host string, digest string, gone array<int>, open boolean")
        out = staged(out.filter("open OR size(gone) > 0"), "html-deleted", keep=True)
        now = out.filter("NOT open").select("host", "digest", "gone")
        done = now if done is None else done.union(now)
        todo = out.filter("open")
        if todo.isEmpty():
            return done
        reach *= 8


def _parsed(batches):
    for batch in batches:
        rows = []
        for page in batch.column("html").to_pylist():
            own = _lines(page or "")
            lines = [int.from_bytes(blake2b(t.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) for t, *_ in own]
            digest = blake2b(repr([(line, *x[1:]) for line, x in zip(lines, own, strict=True)]).encode(), digest_size=16).hexdigest()
            rows.append((digest, [t for t, hidden, *_ in own if not hidden], lines, [len(x[0]) for x in own], *([x[k] for x in own] for k in (1, 2, 3))))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.list_(pa.bool_())] * 3]
        arrays = [*(batch.column(c) for c in ("page_id", "url", "host", "path")), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "host", "path", "digest", "texts", "lines", "sizes", "chrome", "inside", "in_prose"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    kind = pages.schema[id_col].dataType.simpleString()
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"), path.alias("path"))
    parsed = rows.mapInArrow(_parsed, f"page_id {kind}, url string, host string, path string, digest string, texts array<string>, lines array<bigint>, sizes array<int>, chrome array<boolean>, inside array<boolean>, in_prose array<boolean>")
    one = parsed.filter("size(lines) > 0").groupBy("host", "digest").agg(F.min(F.struct("path", "page_id")).alias("at"), *[F.first(c).alias(c) for c in ("lines", "sizes", "chrome", "inside", "in_prose")])
    with scratch(pages.sparkSession):
        gone = _deleted(one.select("host", "digest", "at.path", "at.page_id", "lines", "sizes", "chrome", "inside", "in_prose"))
    out = parsed.select("page_id", "url", "host", "digest", "texts").join(gone, ["host", "digest"], "left")
    every = F.when(F.size("texts") > 0, F.sequence(F.lit(0), F.size("texts") - 1)).otherwise(F.array().cast("array<int>"))
    left = F.when(F.col("gone").isNull(), F.col("texts")).otherwise(F.transform(F.array_except(every, F.col("gone")), lambda i: F.get("texts", i)))
    return out.select("page_id", "url", F.array_join(left, "\n\n").alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
