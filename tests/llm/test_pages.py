"""Page texts against the article's blocks, differencing on pages without an article, alignment against brute force."""

from __future__ import annotations

import html
import random
import re
from functools import lru_cache

from cuespark.llm import pages

SCHEMA = "page_id bigint, url string, html string, path string, host string, text string"


def article(source):
    body = re.search("<article>(.*?)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", body)
    texts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_every_page(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {r.page_id: (r.url, article(r.html)) for r in table.collect()}
    got = pages.extract_text(table).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got) and sum(r.n_shared for r in got) > 0


def test_alignment():
    def length(a, b):
        @lru_cache(None)
        def go(i, j):
            if i == len(a) or j == len(b):
                return 0
            return 1 + go(i + 1, j + 1) if a[i] == b[j] else max(go(i + 1, j), go(i, j + 1))
        return go(0, 0)

    rng = random.Random(8)
    for _ in range(400):
        a, b = rng.sample(range(14), rng.randint(0, 12)), rng.sample(range(14), rng.randint(0, 12))
        at = pages.shared_positions(a, b)
        assert len(at) == length(tuple(a), tuple(b)) and at == sorted(at)
        it = iter(b)
        assert all(any(x == y for y in it) for x in (a[i] for i in at))
    assert pages.shared_positions([1, 1, 2], [1, 2, 1]) in ([0, 1], [0, 2])
    assert len(pages.shared_positions([7] * 50_000, [7] * 40_000)) == 40_000


def test_structure():
    text = lambda s: "\n".join(t for _, t, _ in pages.candidate_lines(pages.page_lines(s)))
    assert text("<body><header>H</header><article><header>x</header><h1>T</h1><p>a<br>b<i>c</i>&amp;&eacute;&#233;<aside>no</aside><p>d</article>"
                "<div id=comments><article class='comment'>me</article></div><footer>f</footer>") == "T\na bc&éé\nd"
    assert text("<div class='has-sidebar'><p>one</p><div class=sidebar>two</div><p class='ad'>x<p>three</div>") == "one\nthree"
    assert text("<main><p>x</p><form>q<input></form><script>var a='</p>'</script><ul class=\"share-links\"><li>s</ul><!-- c --><p>y &lt; z</main>") == "x\ny < z"
    assert text(None) == text("") == text("<p") == "" and text("a < b") == "a < b" and text("<article>1 &am 2 &amp 3") == "1 &am 2 & 3"
    assert text('<p title="a > b">t</p><p title="open>u</p>') == "t\nu"
    assert len(text("<p>" + "word " * 300_000)) == 5 * 300_000 - 1
    assert text("<a " + '"' * 4001) == ""


def test_nothing_of_a_page_is_lost_to_a_name():
    text = lambda s: "\n".join(t for _, t, _ in pages.candidate_lines(pages.page_lines(s)))
    assert text("<article><p>one</p><svg/><p>two</p><math display='x' /><p>three</p><svg><text>no</text></svg></article>") == "one\ntwo\nthree"
    assert text("<body><title-card>a</title-card><p>b</p></body>") == "a\nb"
    body = "<p>The story goes on.</p><p>And ends.</p>"
    story = "The story goes on.\nAnd ends."
    assert text(f"<form id=aspnet><nav>m</nav><main>{body}</main></form>") == story
    assert text(f"<div class='menu-open page'><header>h</header><article>{body}</article><footer>f</footer></div>") == story
    assert text(f"<form><div class='nav-open'><nav><a>one</a></nav><div>{body}</div></div></form>") == story
    assert text(f"<form action=find><input><label>Find</label></form><div>{body}</div>") == story
    long = "Results differ by " + "more and less, " * 20
    assert text(f"<article>{body}<section class='discussion'><p>{long}</p></section><div class='promo-text'>Buy now</div></article>") == f"{story}\n{long.strip()}"
    assert text(f"<article>{body}<section class='comments'><p>{long}</p></section></article>") == story
    assert text(f"<article>{body}</article><div id='comments'><article>{long}</article></div>") == story
    assert text(f"<div>{body}</div><div id='comments'><p>{long}</p></div><nav>{long}</nav>") == story
    assert len(text("<form>" * 20_000 + "deep" + "</form>" * 20_000)) in (0, 4)


def test_differencing(spark):
    page = lambda own, rest="": f"<div>Menu of the site</div><div>{own}</div>{rest}<div>Made by us</div>"
    rows = [(1, "http://A.com/x/1?q=1", page("first"), "", "", ""), (2, "https://a.com/x/2", page("second"), "", "", ""), (3, "http://b.com/x/1", page("alone"), "", "", ""),
            (4, None, page("no url", "<div>more</div>"), None, None, None), (5, "http://a.com/y", None, "", "", ""), (None, "http://a.com/x/10", page("ten"), "", "", ""),
            (2, "https://a.com/x/2", page("second"), "", "", ""), (6, "http://a.com/z/9", "<article>kept</article>", "", "", ""), (7, "http://a.com/z/8", "<article>kept</article>", "", "", "")]
    table = spark.createDataFrame(rows, SCHEMA)
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted(((r.page_id or 0), r.text, r.n_shared) for r in pages.extract_text(table).collect())
        assert got == [(0, "ten", 2), (1, "first", 2), (2, "second", 2), (2, "second", 2), (3, "Menu of the site\nalone\nMade by us", 0),
                       (4, "Menu of the site\nno url\nmore\nMade by us", 0), (5, "", 0), (6, "kept", 1), (7, "kept", 1)]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert pages.extract_text(table.limit(0)).count() == 0


def test_equal_pages_keep_their_text(spark):
    page = lambda own: f"<div>Menu</div><p>{own}</p><div>Made by us</div>"
    rows = [(1, "http://a.com/x/1", page("same")), (2, "http://a.com/x/1/print", page("same") + "<!-- -->"), (3, "http://a.com/y", page("else")), (4, "http://b.com/1", page("same")), (5, "http://b.com/2", page("same"))]
    got = {r.page_id: (r.text, r.n_shared) for r in pages.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[2] == ("same", 3) and got[3] == ("else", 2) and got[1][0] == got[4][0] == got[5][0] == "Menu\nsame\nMade by us"
