"""Main text of pages: site templates against a brute-force count, named parts, markup that is out of order."""

import random
import re
from collections import defaultdict

import pytest

from stationcast.llm import pages

PAGES = "page_id long, url string, html string, text string, host int"


def extracted(spark, rows, **kw):
    df = spark.createDataFrame([(i, u, h, "t", 1) for i, u, h in rows], PAGES)
    return [tuple(r) for r in pages.extract(spark, df.repartition(3), **kw).orderBy("page_id").collect()]


def text_of(page, template=frozenset()):
    return pages.main_text(pages.parse(page), template)


ARTICLE = "<article><header><h1>Head&amp;line</h1></header><p>First  <b>bold</b>\n text.<br>More.<p>Second&nbsp;one</article>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<html><head><title>t</title></head><body><nav>menu</nav>{ARTICLE}<footer>f</footer></body></html>", "Head&line\n\nFirst bold text. More.\n\nSecond one"),
        ("<article><p><b>Open bold.<br><p>Next.</p><ul><li>one<li>two</ul></article>", "Open bold.\n\nNext.\n\none\n\ntwo"),
        ("<header>Site</header><main><p>Main text.</p><aside>side</aside><form>f<p>q</p></form></main>", "Main text."),
        ('<div class="site-header">Site</div><div id="content"><p>Some text of the page.</p><p>More of it.</p></div><div id="comments"><p>First!</p></div>', "Some text of the page.\n\nMore of it."),
        ('<article><p>Text.</p><div class="ad">Buy</div><section class="comment-list"><article class="comment"><p>Nice</p></article></section></article>', "Text."),
        ('<div class="with-sidebar"><p>A long enough paragraph.</p><div class="sidebar">links</div></div>', "A long enough paragraph."),
        ('<div role="navigation">n</div><div role="main"><p>Body</p></div><div role="alert">a</div>', "Body"),
        ("<script>var a = '<p>no</p>';</script><style>p{}</style><p>yes<script>x</script></p><!-- <p>no</p> --><noscript><p>no</p></noscript>", "yes"),
        ("<article><p>a < b &lt; c &am &copy &#8364; &#x41;</p><table><tr><td>1<td>2<tr><td>3</table></article>", "a < b < c &am © € A\n\n1 2\n\n3"),
        ("<article><p>cut off <a href='x", "cut off"),
        ("<article><p>cut off</p><script>never ends <p>no</p>", "cut off"),
        ('<article><p title="a > b" class=\'x\'>quoted</p><p data-x="broken>odd</p></article>', "quoted\n\nodd"),
        ("plain text only", "plain text only"),
        ("<article></article><p>outside</p>", "outside"),
        ("<nav>only</nav>", ""),
        ("", ""),
        ("</p></div>x<br/>y<hr>z", "x y\n\nz"),
        ("<ARTICLE><P>Upper</P><DIV CLASS='AD'>x</DIV></ARTICLE>", "Upper"),
    ],
)
def test_text_of_one_page(page, want):
    assert text_of(page) == want


def test_site_templates_go_and_passages_stay(spark):
    rng = random.Random(3)
    passage = "A passage that is quoted by many articles of this site, word for word."
    rows = []
    for i in range(40):
        body = "".join(f"<p>{' '.join(rng.choices('alpha beta gamma delta'.split(), k=12))} {i}</p>" for _ in range(3))
        shared = '<div class="x1">Read our <b>magazine</b></div>' if i % 2 else "<section><p>All rights are ours.</p></section>"
        rows.append((i, "https://User@Site.example:80/a?b", f"<body><div><h1>Title {i}</h1>{body}<p>{passage}</p></div>{shared}</body>"))
    got = extracted(spark, rows)
    assert all("magazine" not in t and "rights" not in t for _, _, t, _ in got)
    assert all(passage in t and t.startswith(f"Title {i}\n\n") for i, _, t, _ in got)
    assert all(n == len(t) for _, _, t, n in got)
    # The same by a join instead of a broadcast; on pages of one host each, nothing recurs.
    assert extracted(spark, rows, broadcast_parts=-1) == got
    alone = extracted(spark, [(i, f"http://h{i}.example/", h) for i, _, h in rows])
    assert all("magazine" in t or "rights" in t for _, _, t, _ in alone)


def test_copies_of_an_article_are_no_template(spark):
    page = "<body><div><h1>One title</h1><div>First part, without a paragraph tag.</div><div>Second part {}.</div></div></body>"
    rows = [(i, "http://site.example/", page.format(i % 9)) for i in range(30)]
    assert all("First part" in t for _, _, t, _ in extracted(spark, rows))


def test_rare_and_hostless_parts_stay(spark):
    page = "<body><div><h1>T{0}</h1><p>Text {0}.</p></div><div>Part of two pages</div></body>"
    rows = [(i, "http://site.example/", page.format(i)) for i in range(2)] + [(10 + i, None, page.format(i)) for i in range(5)]
    rows += [(20 + i, "no url", page.format(i)) for i in range(5)]
    got = extracted(spark, rows)
    assert len(got) == 12 and all("Part of two pages" in t for _, _, t, _ in got)


def test_template_counts_equal_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(150):
        parts = "".join(f"<div>part {rng.randrange(12)}</div>" for _ in range(rng.randrange(4)))
        rows.append((i, f"http://h{rng.randrange(3)}.example/{i}", f"<h1>t{rng.randrange(60)}</h1><div><p>own {i}</p></div>{parts}"))
    heads, of_host = defaultdict(set), defaultdict(set)
    for _, url, page in rows:
        head = re.search("<h1>(.*?)</h1>", page)[1]
        host = url.split("/")[2]
        of_host[host].add(head)
        for part in re.findall(r"<div>part \d+</div>", page):
            heads[host, part].add(head)
    template = {k for k, v in heads.items() if len(v) >= max(3, 0.01 * len(of_host[k[0]]))}
    assert template and len(template) < len(heads)
    got = {r[0]: r[2] for r in extracted(spark, rows)}
    for i, url, page in rows:
        kept = [p for p in re.findall(r"<div>part \d+</div>", page) if (url.split("/")[2], p) not in template]
        want = [re.search("<h1>(.*?)</h1>", page)[1], f"own {i}", *(p[5:-6] for p in kept)]
        assert got[i] == "\n\n".join(want)


def test_null_empty_repeated_and_very_long_pages(spark):
    long = "<article>" + "<div><p>word " * 30000 + "</article>"
    rows = [(None, None, None), (1, "http://a/", ""), (1, "http://a/", ""), (2, "http://a/", long)]
    got = extracted(spark, rows)
    assert [r[:2] + (r[3],) for r in got] == [(None, None, 0), (1, "http://a/", 0), (1, "http://a/", 0), (2, "http://a/", 30000 * 6 - 2)]
    assert extracted(spark, []) == []
