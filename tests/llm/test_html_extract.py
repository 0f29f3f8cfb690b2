import html
import random
import re

import pytest

from tidemark.llm import html_extract as op
from tidemark.llm.queries import op8_html_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a\n  b</p>\n<p>c<p>d", "a b\nc\nd"),
        ("<body><nav>menu</nav><article><h1>T</h1><p>x <b>y</b>z<br>w</p><div class='ad'>buy</div></article><footer>f</footer>", "T\nx yz w"),
        ("<body><header>site</header><div id=sidebar>s</div><div>text<script>var a='</p>'</script> more</div><form>f</form><section class='comments'>c</section>", "text more"),
        ("<article><p>keep</p><section id='comments'><article>reader</article></section></article>", "keep"),
        ("<ul><li>a<li>b</ul><!-- gone --><table><tr><td>1<td>2</table>", "a\nb\n1\n2"),
        ("<div class='cookie-notice'>c</div><main><p>m</p><aside>x</aside></main><p>outside</p>", "m"),
        ("<ul><li><a href=1>x</a><li><a href=2>y</a><li><a href=3>z</a></ul><p>body</p>", "body"),
        ("<p><b>bold<br><p>next</b> on</p></div>tail", "bold\nnext on\ntail"), ("a < b &lt; c &#233;&nbsp;d <", "a < b < c é d <"),
        ("<div " + "x" * 50_000 + "<div>" * 3000 + "deep", "deep"), ("<title>t</title><style>s</style><p hidden>h</p><p style='display: none'>n</p>v", "v"),
        ("<p data-x='a>b'>q</p><!-- open", "q"), ("<textarea>never closed <p>x", ""),
        ("<article><p>a</p><p class='notice-period'>The notice period is long.</p></article>", "a\nThe notice period is long."),
        ("<article><div class='header-image'>cap</div><p id='login-section'>How to login.</p></article>", "cap\nHow to login."),
        ("<main><p>lead</p><article>inner <i>part</i></article><p>after</p></main><article>teaser</article>", "lead\ninner part\nafter"),
        ("<article><p>x</p><main>y</main></article>", "x\ny"), ("<article class='post comment'>reader</article><p>left</p>", "left"),
        ("<div id='site-header'>h</div><p class='search-results'>found</p><div class='ad-300x250 box'>ad</div><div class='adbox'>b</div><h2 class='header'>t</h2>", "found\nb\nt"),
        ("<article><div class='related links'>r</div><div class='Ad'>a</div><section class='share-buttons'>s</section><p class='alert'>kept</p></article>", "kept"),
        ("<ul><li><a>one of the long links that say something</a><li><a>b</a><li><a>c</a></ul>", "one of the long links that say something\nb\nc"), ("<ol><li>x <a>b</a><li><a>c</a><li><a>d</a></ol>", "x b\nc\nd"), ("<p>one</p><p></p><p> &#32; </p><p>two</p>", "one\ntwo"),
        ("<article><p class='comment'>The comment of the court was short.</p><h2 id='related'>Related work</h2><p id='cookie'>How to bake a cookie.</p><p class='share'>The share of apples rose.</p></article>", "The comment of the court was short.\nRelated work\nHow to bake a cookie.\nThe share of apples rose."),
        ("<article><p class='comment'>Only this.</p></article>", "Only this."), ("<article><div class='comment'><p>All of it, in a container.</p></div></article>", "All of it, in a container."),
        ("<article><p>a</p><div class='cookie-notice'>We use cookies</div><div class=notice>We use cookies</div><div id=gdpr>g</div><section class='consent-banner'>c</section><div class='subscribe'>s</div></article>", "a"),
        ("<article><p>a</p><div class='user-comments'>u</div><ul class='reader-comments'><li>r</ul><section id='comments-section'>c</section><div class='comment-thread'>t</div><div id='disqus_thread'>d</div><ol class='comment-list'><li>x</ol></article>", "a"),
        ("<p>Ingredients:</p><ul><li><a>flour</a><li><a>sugar</a><li><a>eggs</a></ul><p>Bake.</p>", "Ingredients:\nflour\nsugar\neggs\nBake."),
        ("<article><blockquote class='social'>quoted</blockquote><li class='nav'>point</li><span class='ad'>in line</span><td id='menu'>cell</td></article>", "quoted\npoint\nin line\ncell"),
        ("<article><div class='ad'>only an advert</div><nav>n</nav></article>", ""), ("<article><div class='notice board'><p>x</p></div><p>y</p></article>", "y"),
    ],
)
def test_pages(page, text):
    assert op.main_text(page) == text


def site(host, n, shared):
    return [(i, f"http://{host}/{i}", f"<body><div><p>{shared}</p><i>go</i></div><p>Own text number {i} of {host}.</p>") for i in range(n)]


def test_template_is_deleted_where_it_recurs(spark):
    pages = site("a.org", 12, "All rights reserved here") + site("b.org", 3, "All rights reserved here")
    pages += [(100 + i, "http://c.org/x", "<p>copied page</p><p>with two parts</p>") for i in range(40)] + [(200, None, None), (201, "http://a.org/e", ""), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame([(*p, 9) for p in pages], "page_id long, url string, html string, TEXT int").repartition(3)
    for options in ({}, {"broadcast_hashes": 0}):
        rows = op.extract(df, **options).collect()
        assert len(rows) == len(pages)
        for r in rows:
            if r.url and "a.org" in r.url and r.html:
                assert r.text == f"Own text number {r.page_id} of a.org."
            elif r.url and "b.org" in r.url:
                assert r.text == f"All rights reserved here\ngo\nOwn text number {r.page_id} of b.org."
            elif r.url and "c.org" in r.url:
                assert r.text == "copied page\nwith two parts"
            else:
                assert r.text == ""
            assert r.n_chars == len(r.text)
    assert op.extract(df.limit(0)).collect() == []


def test_query_over_whole_table(spark):
    d = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    rows = op8_html_text(spark, d).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_template_of_a_part_of_a_host(spark):
    notice = lambda i: "<div><p>Shared section notice</p></div>" if i % 10 < 3 else "<div class='ad'><p>Marked in places</p></div>" if i % 10 < 9 else "<div><p>Marked in places</p></div>"
    pages = [(i, f"http://d.org/{i}", f"<body>{notice(i)}<p>Own text {i}.</p></body>") for i in range(60)]
    pages += [(100 + i, f"http://e.org/{i}", f"<article><p>Own text {i}.</p>{'<p>Said again.</p>' if i % 2 else ''}</article>") for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for options in ({}, {"broadcast_hashes": 0}):
        got = {r.page_id: r.text for r in op.extract(df, **options).collect()}
        assert got == {i: f"Own text {i}." for i in range(60)} | {100 + i: f"Own text {i}." + "\nSaid again." * (i % 2) for i in range(60)}


def test_template_against_a_count_of_all_pages(spark):
    """Pages of a few hosts, made of shared and own blocks: what stands often enough on a host goes, and nothing else does."""
    rng = random.Random(6)
    shared = [f"<div><p>Shared block {k} of the site.</p><i>more</i></div>" for k in range(14)]
    pages = []
    for n in range(400):
        host = rng.choice(["a.org", "a.org", "a.org", "b.org", "c.org"])
        own = f"<p>Own text {n // 2 if host == 'c.org' else n} here.</p>"
        blocks = [b for k, b in enumerate(shared) if rng.random() < 0.3 / (k + 1)]
        pages.append((n, f"https://{host}/p/{n}", [*blocks, own, *blocks[:1]]))
    strip = lambda b: re.sub(r" *<[^>]+> *", "\n", b).split("\n")
    text = lambda blocks: "\n".join(x for b in blocks for x in strip(b) if x)
    contents = {}
    for _, url, blocks in pages:
        contents.setdefault(url.split("/")[2], {}).setdefault(text(blocks), set()).update(blocks)
    gone = set()
    for host, found in contents.items():
        for block in [*shared, *{b for s in found.values() for b in s}]:
            n = sum(block in s for s in found.values())
            if n >= 8 and n >= 0.05 * len(found):
                gone.add((host, block))
    assert 5 < len(gone) < 30
    df = spark.createDataFrame([(i, u, f"<body>{''.join(b)}</body>") for i, u, b in pages], "page_id long, url string, html string").repartition(4)
    inner = {"<i>more</i>"} | {re.sub(r"</?div>|<i>.*</i>", "", b) for b in shared}
    for options in ({}, {"broadcast_hashes": 0}):
        got = {r.page_id: r.text for r in op.extract(df, **options).collect()}
        for i, url, blocks in pages:
            host = url.split("/")[2]
            holds = lambda part: sum(any(part in b for b in s) for s in contents[host].values())  # noqa: B023, E731
            often = {part for part in inner if holds(part) >= 8 and holds(part) >= 0.05 * len(contents[host])}
            left = [b for b in blocks if (host, b) not in gone]
            left = ["".join(p for p in re.findall(r"<p>.*?</p>|<i>.*?</i>", b) if p not in often) for b in left]
            assert got[i] == text(left)
