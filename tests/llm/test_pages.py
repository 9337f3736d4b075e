"""Main text against what the pages were made of; the style tree's counts against a plain merge."""

import html as escape
import re

import pytest

from conftest import SF_DIR
from memoloom.llm import pages
from memoloom.llm.dom import Page


def texts(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, nodes string")
    return {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.main_text(df).collect()}


def blocks(html):
    return [b.text for b in Page(html).blocks]


@pytest.mark.parametrize(
    "html, want",
    [
        ("", []),
        ("plain &amp; text", ["plain & text"]),
        ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]),
        ("<p><b>one.<br><p>two</p>", ["one.", "two"]),
        ("<p>a<br>b  \n c&nbsp;d</p>", ["a b c d"]),
        ("<script>var t='</p>';</script><style>x</style><p>x<i>y</i>z</p>", ["xyz"]),
        ("<ul><li>1<li>2<ul><li>3</ul></ul>", ["1", "2", "3"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<nav>m</nav><header>h</header><aside>s</aside><form>f<p>g</form><footer>z</footer>t", ["t"]),
        ('<div class="ad">x</div><div class="cookieNotice">x</div><div id="comments"><p>x</div><div class="text">y</div>', ["y"]),
        ('<div hidden>x</div><div style="display: none">x</div><div role="navigation">x</div><p>y', ["y"]),
        ("<p>&#233;&eacute;&lt;b&gt; &am &copy</p>", ["éé<b> &am ©"]),
        ("<p>cut &amp", ["cut &"]),
        ("<!-- a <p>b</p> --><p>c</p></div></p><p>d", ["c", "d"]),
        ('<div class="with-sidebar">a</div><body class="ad"><p>b', ["a", "b"]),
    ],
)
def test_blocks(html, want):
    assert blocks(html) == want


def test_supplied_pages(spark):
    """Their articles hold a heading and paragraphs, some without end tags."""
    df = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    rows = {r["page_id"]: r["text"] for r in pages.main_text(df).collect()}
    assert len(rows) == df.count()
    for r in df.collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S).group(1)
        parts = (escape.unescape(re.sub("<[^>]*>", " ", p)).split() for p in re.split("</?(?:h1|p)>", article))
        assert rows[r["page_id"]] == "\n".join(" ".join(p) for p in parts if p)


def test_furniture_without_names(spark):
    """No element says what it is; what all pages of the host share goes, what differs stays."""
    page = "<body><div class=x1>Our shop, our rules</div><div class=x2><h2>T{0}</h2><p>Story {0} goes on</p></div><div class=x3><p>Write to us</p></div></body>"
    rows = [(i, f"http://A.example/{i}", page.format(i)) for i in range(12)]
    rows += [(100, "http://b.example/", page.format(5)), (101, None, page.format(6)), (102, "::", "<p>x</p>"), (103, None, None), (None, "u", "<p>n</p>")]
    got = texts(spark, rows)
    assert all(got[i][0] == f"T{i}\nStory {i} goes on" for i in range(12))
    assert got[100][0] == "Our shop, our rules\nT5\nStory 5 goes on\nWrite to us"  # a single page says nothing
    assert got[102] == ("x", 1) and got[103] == ("", 0) and got[None] == ("n", 1)


def test_copies_of_one_article_stay(spark):
    page = "<body><nav><a>home</a></nav><article><h1>Same</h1><p>Same text</p><div class=share>tell</div></article><article class=comment>no</article></body>"
    got = texts(spark, [(i, "http://c.example/x", page) for i in range(20)])
    assert set(got.values()) == {("Same\nSame text", 14)}


def test_text_at_one_place_of_many_pages(spark):
    page = "<body><p>Subscribe now for more</p><p>Body of {0}</p><p>And {0} again</p></body>"
    got = texts(spark, [(i, "http://d.example/x", page.format(i)) for i in range(30)])
    assert all(got[i][0] == f"Body of {i}\nAnd {i} again" for i in range(30))


@pytest.mark.parametrize("own", ["<h2>Title {0}</h2>", "<p>2 May, no. {0}</p>", ""])
def test_unmarked_copies_of_an_article_stay_on_a_large_host(spark, own):
    """300 of 1,000 distinct pages have one article's paragraphs at the place where the others have their own."""
    page = "<body><div class=a>Our shop, our rules</div><div class=b>" + own + "<p>{1}</p><p>{2}</p></div></body>"
    copied = [(i, f"http://g.example/{i}", page.format(i, "A much copied story", "and how it ends")) for i in range(300)]
    others = [(i, f"http://g.example/{i}", page.format(i, f"Story {i}", f"End {i}")) for i in range(300, 1000)]
    got = texts(spark, copied + others)
    head = own.replace("<h2>", "").replace("</h2>", "\n").replace("<p>", "").replace("</p>", "\n")
    assert all(got[i][0] == head.format(i) + "A much copied story\nand how it ends" for i in range(300))
    assert all(got[i][0] == head.format(i) + f"Story {i}\nEnd {i}" for i in range(300, 1000))


def test_copies_in_a_place_of_their_own_stay(spark):
    page = "<body><p>Subscribe now</p><p>No. {0}</p><div class={1}><p>{2}</p></div></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i, "copied" if i < 8 else "own", "One story" if i < 8 else f"Story {i}")) for i in range(40)]
    got = texts(spark, rows)
    assert all(got[i][0] == f"No. {i}\n" + ("One story" if i < 8 else f"Story {i}") for i in range(40))


def test_equal_pages_count_once(spark):
    """Copies of one page, however many, do not make its texts furniture of the host."""
    page = "<body><p>Subscribe now</p><p>Story {0}</p><p>{0} ends</p></body>"
    rows = [(i, f"http://i.example/{i}", page.format(max(i, 90))) for i in range(100)]
    assert all(text == f"Story {max(i, 90)}\n{max(i, 90)} ends" for i, (text, _) in texts(spark, rows).items())


def test_long_and_none(spark):
    got = texts(spark, [(1, "http://e.example", "<article><p>" + "word " * 200_000 + "</article>")])
    assert got[1][1] == 200_000 * 5 - 1
    assert texts(spark, []) == {}


def test_tree_merges_pages_of_a_host(spark):
    df = spark.createDataFrame([(i, "http://f.example/", f"<body><p>{i % 2}</p></body>") for i in range(6)], "page_id long, url string, html string")
    tree = pages.site_style_tree(pages.parsed(df)).collect()
    assert {r["host"] for r in tree} == {"f.example"}
    assert sorted(r["n"] for r in tree if r["kind"] == pages._TEXT) == [3, 3]
    assert all(r["n"] == 6 for r in tree if r["kind"] == pages._PAGES)
