from stagewise.llm.html_text import Page, extract, path_key

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>
<body><nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad --><div class="ad">buy this now</div>
<article><h1>Head&nbsp;line</h1><p><b>One &lt;b&gt; &#233;.<br><p>Two
  <i>words</i> <a href="y">link</a></p><aside>side</aside><ul><li>x<li>y</ul>
<div class="comments"><p>nice post, thanks a lot for it</p></div><form><button>go</button></form></article>
<footer>&copy; me</footer></body></html>"""


def test_article():
    assert Page(PAGE).main_text(None) == "Head line\nOne <b> é.\nTwo words link\nx\ny"


def test_odd_markup():
    assert Page("").main_text(None) == ""
    assert Page("just text").main_text(None) == "just text"
    assert Page("<p>a < b &amp; c<p>d").main_text(None) == "a < b & c\nd"
    assert Page("<div>a<!-- never closed").main_text(None) == "a"
    assert Page("<div>x<script>open").main_text(None) == "x"
    assert Page("<table><tr><td>a<td>b<tr><td>c</table>").main_text(path_key("table>tr>td")) == "a\nb\nc"
    assert Page("</div></p>").main_text(None) == ""
    assert Page('<div class="x" hidden>no</div><div style="display: none">no</div><p>yes').main_text(None) == "yes"


STORY = "<p>" + "Once there was a story that went on and on. " * 8 + "</p><p>It ended well.</p>"
TOLD = "Once there was a story that went on and on. " * 7 + "Once there was a story that went on and on.\nIt ended well."


def test_wrappers_keep_their_article():
    """One word in a name, or a form around the page, isn't the article's fault; judged by hand, page by page."""
    for before, after in [
        ('<form id="aspnetForm"><div class="article">', "</div></form>"),
        ('<div class="post has-sidebar">', "</div>"),
        ('<div id="page-header-fixed"><div class="content no-comments">', "</div></div>"),
        ('<div class="layout-with-rail"><form><div class="post share-enabled">', "</div></form></div>"),
        ('<nav>Home News Sport</nav><p>Hi</p><div class="body-sidebar-left">', '<div class="site-footer">Imprint and more</div></div>'),
        ('<form action="/s"><input name="q"><label>Search the archive</label></form><div class="post">', "</div>"),
        ('<div class="post">', '</div><div class="comment-list">' + "<p>I liked it a lot, thanks.</p>" * 99 + "</div>"),
        ('<div class="post">', '</div><div class="sidebar">' + "<p>Read this one, too.</p>" * 99 + "</div>"),
        ('<div class="post">', '</div><form class="newsletter-box"><p>Write us your name and get letters.</p></form>'),
    ]:
        page = Page(f"<html><body>{before}{STORY}{after}</body></html>")
        assert page.main_text(None) == TOLD, before
    assert Page('<div class="sidebar"><p>only this</p></div>').main_text(None) == ""
    assert Page('<div class="comment-list"><p>only this</p></div>').main_text(None) == "only this"


def test_deep_pages_take_time_in_proportion(spark):
    import time

    for n in (4000, 40_000):
        source = "<div>" * n + "<span>" * n + "<p>text</p>" + "</i>" * n
        start = time.process_time()
        page = Page(source)
        assert page.main_text(page.key[page.choices()[0][0]]) == "text"
        assert time.process_time() - start < 8 * n / 40_000 + 1
    rows = [(1, "http://h.example/", "<div>" * 8000 + "<p>text</p>")]
    assert extract(spark.createDataFrame(rows, "page_id long, url string, html string")).first().text == "text"


def test_paths_are_general():
    page = Page('<body><div class="post-12 b a"><p>' + "words " * 30 + "</p></div></body>")
    assert page.path(page.choices()[0][0]) == "body>div.a.b.post-#"


def test_consensus(spark):
    body = lambda main, more: f'<html><body><div class="story">{main}</div><div class="more">{more}</div></body></html>'
    rows = [(i, "http://h.example/a", body(f"<p>story {i} " + "word " * 40 + "</p>", "<p>short</p>")) for i in range(5)]
    # alone this page would choose the longer block; its host's pages say where the story is
    rows.append((9, "http://H.example/b", body("<p>brief story</p>", "<p>" + "other " * 60 + "</p>")))
    rows += [(10, None, None), (11, "::", "<p>x</p>"), (11, "::", "<p>x</p>"), (12, "http://big.example/", "<article>" + "<p>long text</p>" * 20_000 + "</article>")]
    df = spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in extract(df).collect()]
    by = {i: t for i, t, _ in got}
    assert by[9] == "brief story" and by[10] == "" and by[11] == "x"
    assert by[0] == ("story 0 " + "word " * 40).strip() and by[12].count("\n") == 19_999
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert extract(df.limit(0)).count() == 0


def test_every_container_votes(spark):
    # the common path ranks fourth on each page, behind three whose classes no other page has
    block = lambda name, n: f'<div class="o{name}"><div class="i{name}"><div class="{name}">' + "word " * n + "</div></div></div>"
    rows = [(i, "http://h.example/", "<html><body>" + "".join(block(f"{c}x{'abcdef'[i]}", 90 - k) for k, c in enumerate("pqr")) + block("story", 80) + "</body></html>") for i in range(6)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: " ".join(["word"] * 80) for i in range(6)}


def test_joined_hosts_and_odd_cases(spark, monkeypatch):
    from stagewise.llm import html_text

    body = lambda a, b: f'<html><body><div class="a">{a}</div><div class="b">{b}</div></body></html>'
    word = lambda n: "<p>" + "word " * n + "</p>"
    rows = [(1, "http://t.example/", body(word(30), "")), (2, "http://t.example/", body("", word(30))), (2, "http://t.example/", body("", word(30))), (3, None, body(word(3), word(30))), (4, "mailto:x", body(word(30), word(3))), (5, "http://t.example/", "")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "page_id long, url string, html string, n_chars int, path string")
    got = sorted((r.page_id, r.text) for r in extract(df).collect())
    # both paths of the host are as frequent as their pages; pages without a host choose by themselves
    assert got == [(i, " ".join(["word"] * 30) if i < 5 else "") for i in (1, 2, 2, 3, 4, 5)]
    monkeypatch.setattr(html_text, "BROADCAST_HOSTS", 0)
    assert sorted((r.page_id, r.text) for r in extract(df).collect()) == got
