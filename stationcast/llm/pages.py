"""Main text of web pages by removal of site templates.

Every container of a page (div, section, list, table and so on) is hashed with its whole subtree: tag, attributes,
text and children. Spark counts for each host on how many differently headed pages a subtree stands. One that
recurs on ``LEAST_PAGES`` such pages and on ``LEAST_SHARE`` of the host's is a part of the site's template and is
deleted, whatever it is called. Pages with the same heading count once, so that copies of one article do not
make its parts look like a template. Paragraphs, headings and other prose go only with a container that goes:
a passage that many articles quote stays.

What names itself goes even where it does not recur: navigation, footers, asides, forms, scripts and styles by
tag or role, adverts, notices, comments and the like by class or id. A name that is only a part of a class
(``with-sidebar``) does not remove an element with most of the page's prose, and nothing that holds the
article is removed. Where a page has an article (else a main part) with text, the rest of the page is left out.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined in page order
by an empty line. Line breaks are white space; a table row is one block. Unclosed and misnested tags are closed
as browsers do for paragraphs, list items and table parts; a tag cut off by the end of the page is dropped.

Null and empty pages, and pages without main text, give the empty text. A null or hostless url is a site of its own
without a template. Repeated rows and ids give a row each. Extra columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from stationcast.llm.common import flat_text, slices, stored

LEAST_PAGES = 3
# A host has at most 1 / LEAST_SHARE times as many template parts as one of its pages has containers.
LEAST_SHARE = 0.01
PROSE_WORDS = 50
# Up to this many template parts of all hosts are sent to every executor (8 bytes each), beyond it pages are joined by host.
BROADCAST_PARTS = 500_000

_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_GONE = frozenset("head script style noscript template iframe svg canvas object embed nav footer aside form button input select option textarea dialog menu menuitem".split())
_GONE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption caption tr address".split())
_BLOCKS = _PROSE | frozenset("html body article main section div header hgroup ul ol dl table thead tbody tfoot figure details summary fieldset legend center hr".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th picture source".split())
_HEADINGS = ("h1", "title")
# Words of a class or id that name what is no article.
_NAMES = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense adslot banner promo promos promotion sponsor
    sponsored sponsors cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter
    subscribe subscription signup login menu menus menubar nav navbar navigation breadcrumb breadcrumbs sidebar sidenav aside
    footer masthead topbar toolbar pagination pager share sharing social related recommended recommendations widget widgets
    comment comments commentlist respond disqus replies""".split()
)
_HEADER_NAMES = frozenset(["header", "pageheader", "siteheader"])
# Tags whose start closes an open element of the second set, up to one of the third.
_LIST, _CELL = frozenset(["ul", "ol", "dl", "menu"]), frozenset(["table"])
_CLOSES = {
    "li": (frozenset(["li"]), _LIST),
    "dt": (frozenset(["dt", "dd"]), _LIST),
    "dd": (frozenset(["dt", "dd"]), _LIST),
    "tr": (frozenset(["tr", "td", "th"]), _CELL),
    "td": (frozenset(["td", "th"]), _CELL | {"tr"}),
    "th": (frozenset(["td", "th"]), _CELL | {"tr"}),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_P_STAYS = frozenset(["table", "td", "th", "button", "object", "caption"])
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?P<close>>|\Z)""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in _RAW}

# An element: tag, attributes as written, index of the parent (-1: none), children (indexes and texts).
Element = tuple[str, str, int, list]


def parse(page: str) -> list[Element]:
    """The elements of a page in document order; a parent stands before its children."""
    elements: list[Element] = [("#page", "", -1, [])]
    open_ = [0]
    # How many elements of each tag are open: no search for one that is not, however deep the page.
    depth: Counter[str] = Counter()

    def text(s: str) -> None:
        if s:
            elements[open_[-1]][3].append(html.unescape(s) if "&" in s else s)

    def shut(which: Collection[str], barrier: frozenset = frozenset()) -> None:
        if not any(depth[tag] for tag in which):
            return
        for k in range(len(open_) - 1, 0, -1):
            tag = elements[open_[k]][0]
            if tag in which:
                depth.subtract(elements[i][0] for i in open_[k:])
                del open_[k:]
                return
            if tag in barrier:
                return

    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            text(page[at:])
            break
        text(page[at : found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None or not found["close"]:
            continue
        tag = tag.lower()
        if found["end"]:
            shut((tag,))
            continue
        if tag in _CLOSES:
            shut(*_CLOSES[tag])
        if tag in _BLOCKS:
            shut(("p",), _P_STAYS)
        me = len(elements)
        attrs = found["attrs"].strip()
        elements.append((tag, attrs, open_[-1], []))
        elements[open_[-1]][3].append(me)
        if tag in _RAW:
            end = _RAW_END[tag].search(page, at)
            inner = page[at : end.start()] if end else page[at:]
            elements[me][3].append(html.unescape(inner) if tag in ("title", "textarea") else inner)
            at = end.end() if end else size
        elif tag not in _VOID and not attrs.endswith("/"):
            open_.append(me)
            depth[tag] += 1
    return elements


def _squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _whole_text(elements: list[Element], i: int) -> str:
    parts, todo = [], [i]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        else:
            todo.extend(reversed(elements[x][3]))
            parts.append(" " if elements[x][0] not in _INLINE else "")
    return _squeezed(parts)


def heading(elements: list[Element]) -> str:
    """The first heading of the page, else its title, else its longest piece of text: what tells its pages apart."""
    for tag in _HEADINGS:
        for i, e in enumerate(elements):
            if e[0] == tag and (found := _whole_text(elements, i)):
                return found
    return max((_squeezed([c]) for e in elements if e[0] not in _RAW for c in e[3] if isinstance(c, str)), key=len, default="")


def subtree_hashes(elements: list[Element]) -> list[int]:
    """A signed 64-bit hash of each element with all below it; white space between texts does not count."""
    hashes = [0] * len(elements)
    for i in range(len(elements) - 1, -1, -1):
        tag, attrs, _, children = elements[i]
        parts = [tag, attrs, *(str(hashes[c]) if isinstance(c, int) else "\x01" + _squeezed([c]) for c in children)]
        hashes[i] = xxhash.xxh3_64_intdigest("\x00".join(parts)) - (1 << 63)
    return hashes


def _is_container(tag: str) -> bool:
    return tag not in _PROSE and tag not in _INLINE and tag not in _RAW and tag not in ("#page", "html", "head", "body", "article", "main", "meta", "link")


def _named(tag: str, attrs: str, in_root: bool) -> int:
    """2: tag, role or a whole class or id says that this is no article; 1: a part of a class or id does; else 0."""
    if tag in _GONE or (tag == "header" and not in_root):
        return 2
    if not attrs:
        return 0
    least = 0
    for name, *values in _ATTR.findall(attrs):
        name = name.lower()
        value = "".join(values)
        if name == "role" and value.lower() in _GONE_ROLES:
            return 2
        if name in ("class", "id"):
            for word in value.split():
                parts = [w.lower() for w in _WORD.findall(_CAMEL.sub("-", word))]
                # The trailing number of comment-12 is no part of the name.
                if len(parts) == 1 and (parts[0] in _NAMES or (parts[0] in _HEADER_NAMES and not in_root)):
                    return 2
                if not _NAMES.isdisjoint(parts) or (not in_root and not _HEADER_NAMES.isdisjoint(parts)):
                    least = 1
    return least


def _is_root(tag: str, attrs: str) -> bool:
    return tag in ("article", "main") or (bool(attrs) and ("articleBody" in attrs or re.search(r"""role\s*=\s*["']?main\b""", attrs) is not None))


def main_text(elements: list[Element], template: frozenset[int] | set[int] = frozenset()) -> str:
    """The article of a page, without what the site repeats and what names itself something else."""
    n = len(elements)
    hashes = subtree_hashes(elements) if template else None
    # Characters of prose below each element, and whether it holds an article or main part.
    prose, own_words, holds = [0] * n, [0] * n, [False] * n
    in_prose, in_root = [False] * n, [False] * n
    for i in range(1, n):
        tag, attrs, parent, _ = elements[i]
        in_prose[i] = tag in _PROSE or in_prose[parent]
        in_root[i] = in_root[parent] or _is_root(tag, attrs)
    for i in range(n - 1, 0, -1):
        tag, attrs, parent, children = elements[i]
        if tag in _GONE:
            continue
        if in_prose[i]:
            prose[i] += sum(len(c) for c in children if isinstance(c, str))
        own_words[i] = sum(len(c.split()) for c in children if isinstance(c, str))
        prose[parent] += prose[i]
        holds[parent] = holds[parent] or holds[i] or _is_root(tag, attrs)
    gone = [False] * n
    for i in range(1, n):
        tag, attrs, parent, _ = elements[i]
        if gone[parent]:
            gone[i] = True
        elif tag in ("html", "body"):
            continue
        elif tag in _RAW or tag in _GONE:
            gone[i] = True
        elif holds[i]:
            continue
        elif hashes is not None and hashes[i] in template and _is_container(tag) and not (in_root[i] and own_words[i] >= PROSE_WORDS):
            gone[i] = True
        else:
            named = _named(tag, attrs, in_root[parent])
            gone[i] = named == 2 or (named == 1 and not _is_root(tag, attrs) and 2 * prose[i] <= prose[0])
    for wanted in (("article",), ("main",), None):
        if wanted is None:
            return "\n\n".join(_blocks(elements, 0, gone))
        blocks: list[str] = []
        inside = [False] * n
        for i in range(1, n):
            tag, attrs, parent, _ = elements[i]
            fits = tag in wanted or (wanted == ("main",) and _is_root(tag, attrs))
            inside[i] = inside[parent] or fits
            if fits and not inside[parent] and not gone[i]:
                blocks += _blocks(elements, i, gone)
        if blocks:
            return "\n\n".join(blocks)
    return ""


def _blocks(elements: list[Element], root: int, gone: list[bool]) -> list[str]:
    """The texts of all blocks below ``root`` in page order. A block ends where another one starts or ends."""
    blocks: list[str] = []
    parts: list[str] = []

    def cut() -> None:
        if parts:
            if found := _squeezed(parts):
                blocks.append(found)
            parts.clear()

    # Texts, elements to open, and None where a block closes.
    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            cut()
        elif isinstance(x, str):
            parts.append(x)
        elif not gone[x]:
            tag, _, _, children = elements[x]
            if tag in _BLOCKS or tag not in _INLINE:
                cut()
                todo.append(None)
            elif tag in ("br", "td", "th"):
                parts.append(" ")
            todo.extend(reversed(children))
    cut()
    return blocks


def _host(url) -> F.Column:
    found = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.when(found != "", found)


def sites(df: DataFrame) -> DataFrame:
    """page_id, url, host, text (the page): what the operator reads."""
    return df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _host(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("text"))


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, part, page): the distinct containers of every page, and 0 for the page itself."""
    for batch in batches:
        for some in slices(batch, "text"):
            hosts, parts, heads = [], [], []
            for host, page in zip(some.column("host").to_pylist(), flat_text(some).to_pylist()):
                elements = parse(page)
                head = xxhash.xxh3_64_intdigest(heading(elements)) - (1 << 63)
                hashes = subtree_hashes(elements)
                found = {0, *(h for h, e in zip(hashes, elements) if _is_container(e[0]))}
                hosts += [host] * len(found)
                parts += found
                heads += [head] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(parts, pa.int64()), pa.array(heads, pa.int64())], ["host", "part", "head"])


def site_templates(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """host, parts: the hashes of the containers that recur on many pages of a host. ``pages``: ``sites``."""
    found = pages.where("host is not null").select("host", "text").mapInArrow(_containers, "host string, part long, head long")
    counted = found.groupBy("host", "part").agg(F.count_distinct("head").alias("n")).where(f"n >= {LEAST_PAGES} or part = 0")
    counted = stored(spark, counted, "containers")
    pages_of = counted.where("part = 0").select("host", F.col("n").alias("pages"))
    often = counted.where("part <> 0").join(pages_of, "host").where(F.col("n") >= F.greatest(F.lit(LEAST_PAGES), F.col("pages") * LEAST_SHARE))
    # Bounded a host, see LEAST_SHARE.
    return often.groupBy("host").agg(F.collect_list("part").alias("parts"))


def extract(spark: SparkSession, df: DataFrame, broadcast_parts: int = BROADCAST_PARTS) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``df`` (page_id, url, html)."""
    pages = sites(df)
    templates = stored(spark, site_templates(spark, pages), "templates")
    size = templates.agg(F.coalesce(F.sum(F.size("parts") + 4), F.lit(0)).alias("n")).first().n
    templates = F.broadcast(templates) if size <= broadcast_parts else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str | None, frozenset[int]] = {}
        for batch in batches:
            for some in slices(batch, "text"):
                out = []
                parts = some.column("parts")
                for k, (host, page) in enumerate(zip(some.column("host").to_pylist(), flat_text(some).to_pylist())):
                    if host not in sets:
                        if len(sets) > 1000:
                            sets.clear()
                        sets[host] = frozenset(parts[k].as_py() or ())
                    out.append(main_text(parse(page), sets[host]))
                yield pa.RecordBatch.from_arrays([some.column("page_id"), some.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    joined = pages.join(templates, "host", "left").select("page_id", "url", "host", "text", "parts")
    texts = joined.mapInArrow(run, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
