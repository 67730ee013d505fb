import html
import re

import pytest

from probefleet.llm import main_text as M


def one(source, path=None):
    page = M.parse(source)
    return page.text(M.chosen(page, path))


PROSE = "Some prose that is long enough to count as the article of this page, with a comma or two. "


def test_corpus_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in M.main_text(pages).collect()}
    assert len(got) == 250
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


@pytest.mark.parametrize(
    "around",
    [
        "<nav>Menu {}</nav>", "<header>Head {}</header>", "<footer>Foot {}</footer>", "<aside>Side {}</aside>",
        "<div class='cookie-notice'>We use cookies {}</div>", "<div class='ad'>Buy {}</div>", "<form>Name {}<input></form>",
        "<script>var a = '</p>{}'</script>", "<style>p{{}}</style>", "<!-- {} -->", "<div id=sidebar><p>{}</div>",
        "<section class='user-comments'><p>{}</p></section>", "<article class='comment'><p>{}</p></article>",
        "<ul class='menu'><li>{}<li>{}</ul>", "<noscript>{}</noscript>", "<svg><text>{}</text></svg>",
    ],
)
def test_parts_that_are_not_the_article(around):
    part = around.format(PROSE, PROSE)
    page = f"<html><body>{part}<div class='content'><h1>Title</h1>{part}<p>{PROSE}</p><p>End &amp; &eacute;&#33;</p></div>{part}</body>"
    assert one(page) == f"Title {PROSE}End & é!"


def test_blocks_inline_and_broken_markup():
    assert one("<article><p>a<b>b</b>c<br>d<i> e </i>\n f<p>g<li>h</article>") == "abc d e f g h"
    assert one("<article><p>one <a href='x>y'>two</a> three four five six") == "one two three four five six"
    assert one("text only, &lt;no&gt; markup") == "text only, <no> markup"
    assert one("<div class='has-sidebar wide'><p>words here</p></div>") == "words here"
    assert one("a < b and c > d") == "a < b and c > d"
    assert one("") == "" and one("<nav>menu</nav>") == ""
    assert one('<p title="never closed>text') != None  # noqa: E711
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert one(deep) == "deep"
    # Quick on long pages of unclosed and stray tags.
    tangled = "<div>x<b>y</i><li>z" * 30_000
    assert one(tangled) == " ".join(["xy z"] * 30_000)


def test_hosts_agree_on_a_path(spark):
    usual = f"<div class='main'><p>{PROSE}</p></div><div class='extra'><p>{{}}</p></div>"
    rows = [(i, f"http://h.example/{i}", usual.format("short")) for i in range(8)]
    # On this page the other container is larger, but the host's path still wins.
    rows.append((8, "http://H.example/8", usual.format(PROSE + PROSE)))
    rows.append((9, "http://other.example/9", usual.format(PROSE + PROSE)))
    rows += [(10, None, f"<p>{PROSE}</p>"), (11, "http://h.example/x", None), (12, "bad", ""), (None, "http://h.example/", "x y")]
    rows.append(rows[0])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as host", "3 as path")
    got = [(r.page_id, r.text) for r in M.main_text(pages).collect()]
    by_id = dict(got)
    assert len(got) == len(rows) and got.count(got[0]) >= 1
    assert by_id[8] == by_id[0] == by_id[10] == PROSE.strip()
    assert by_id[9] == (PROSE + PROSE).strip()
    assert by_id[11] == by_id[12] == "" and by_id[None] == "x y"
    assert M.main_text(pages.limit(0)).count() == 0


def test_classes_are_generalised(spark):
    votes = spark.createDataFrame([("h", "/b", 5), ("h", "/a", 5), ("h", "/c", 4), ("g", "/c", 1)], "host string, path string, vote long")
    assert dict(M.winning_paths(votes).collect()) == {"h": "/a", "g": "/c"}
    page = M.parse("<div class='post-17 B a'><p>text</p></div>")
    assert page.path(page.nodes[1]) == "/div.a.b.post-#"


def parts(n, part="<section><h2>Part {}</h2><p>{}</p></section>"):
    return "".join(part.format(k, PROSE * (1 + k % 3)) for k in range(n))


def plain(source):
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", source)).split())


@pytest.mark.parametrize("n", [2, 3, 8, 30])
@pytest.mark.parametrize("outer", ["<article><h1>Title</h1>{}</article>", "<div class='post'><h1>Title</h1>{}</div>", "<article><h1>Title</h1><div class='wrap'>{}</div></article>"])
@pytest.mark.parametrize("part", ["<section><h2>Part {}</h2><p>{}</p></section>", "<div class='c'><h2>Part {}</h2><p>{}</p></div>"])
def test_articles_of_several_parts(n, outer, part):
    article = outer.format(parts(n, part))
    source = f"<html><body><nav>Menu</nav><div class='more'>{PROSE}</div>{article}</body></html>"
    paths = M.votes_of(M.parse(source))
    for path in [None, *paths]:
        if path is None or not path.endswith(("body", "more")):
            assert one(source, path) == plain(article)


def test_several_parts_in_the_body():
    source = f"<body><div>{PROSE}</div><h2>Between</h2><div>{PROSE}</div><div class='x'>Short</div></body>"
    assert one(source) in (plain(source), f"{PROSE}Between {PROSE}".strip())


@pytest.mark.parametrize("outer", ["article", "div"])
def test_long_quotes_and_cells(outer):
    for inside in ("<blockquote><p>{}</p></blockquote>", "<table><tr><td>{}</td><td>1</td></tr></table>"):
        source = f"<body><{outer}><h1>Title</h1><p>{PROSE}</p>{inside.format(PROSE * 5)}<p>The end.</p></{outer}></body>"
        assert one(source) == plain(source)
    layout = f"<body><div><table><tr><td>Side words</td><td><p>{PROSE * 5}</p></td></tr></table></div></body>"
    assert one(layout) == (PROSE * 5).strip()


def test_hosts_of_sectioned_articles(spark):
    page = "<html><body><div class='top'>Words</div><article><h1>Title</h1>{}</article></body></html>"
    rows = [(n, f"http://h.example/{n}", page.format(parts(n))) for n in (1, 2, 3, 3, 8)]
    for r in M.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text == plain(f"<h1>Title</h1>{parts(r.page_id)}")


def test_a_page_votes_once_for_a_path():
    votes = M.votes_of(M.parse(f"<body><article>{parts(3, '<section>{1}</section>')}</article></body>"))
    assert max(votes, key=votes.get) == "/body/article" and len(votes) == len(set(votes)) == 3


ARTICLE = f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p>"


@pytest.mark.parametrize(
    "source",
    [
        "<body><div class='market-share'>{}</div></body>",
        "<body><section class='promotion-of-trade'>{}</section></body>",
        "<body><div id='page' class='has-sidebar search'>{}</div></body>",
        "<body><form action='/'>{}<input></form></body>",
        "<body><form><nav>Menu</nav><div class='c'>{}</div><footer>Foot</footer></form></body>",
        "<body><nav><ul><li><a href='/'>Home</a><li>About</ul><div class='c'>{}</div></body>",
        "<body><nav><a href='/'>Home</a> <a href='/x'>More</a><main>{}</main></body>",
        "<body><div class='social'><article>{}</article></div><div class='cookie-notice'>We use cookies. " + PROSE * 9 + "</div></body>",
        "<body><div class='search'>{}</div><div class='comments'><p>" + PROSE * 9 + "</p></div></body>",
        "<body><article class='search'>{}</article><aside>" + PROSE * 9 + "</aside></body>",
    ],
)
def test_articles_in_parts_with_other_names(source):
    assert one(source.format(ARTICLE)) == plain(ARTICLE)


def test_the_title_in_an_article_header():
    source = f"<body><article><div class='article-header'><h1>Title</h1></div><p>{PROSE}</p></article></body>"
    assert one(source) == plain(f"<h1>Title</h1> {PROSE}")


@pytest.mark.parametrize("mark", ["share", "cookie-notice", "site-footer", "user-comments", "sidebar left", "main_menu", "related-links"])
def test_marked_parts_beside_an_article_go_whatever_they_hold(mark):
    source = f"<body><article>{ARTICLE}</article><div class='{mark}'><p>{PROSE * 20}</p></div></body>"
    assert one(source) == plain(ARTICLE)


def test_votes_equal_counting_them(spark):
    """Votes of hosts against adding up each page's shares in Python."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url", "html")
    counted = {}
    for r in pages.collect():
        at = re.match(r"[^/?#]*?://([^/?#]*)", r.url or "")
        for path, vote in M.votes_of(M.parse(r.html or "")).items():
            key = ((at[1] if at else "").lower(), path)
            counted[key] = counted.get(key, 0) + vote
    best = {}
    for (host, path), votes in counted.items():
        best[host] = min(best.get(host, (0, "")), (-votes, path))
    assert {r.host: r.path for r in M.winning_paths(M.page_votes(pages)).collect()} == {h: path for h, (_, path) in best.items()}
