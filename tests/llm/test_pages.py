import json

from tracewell.llm import html

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href=x>{0}</a><li>two</ul></nav>
<!-- <p>no</p> --><div class="cookie-notice">We use cookies</div><article class="post"><header><p>by {0}</p></header><h1>Head &amp; {0}</h1>
<p>First&nbsp;<b>bold</b> part<br>next
 line<p>Second {0}</p><div class="ad-box">Buy</div><ul><li>item {0}</ul><form><p>mail</p></form><aside>more</aside>
<script>var t="</p>";</script></article><section id="comments"><p>nice {0}</p></section><footer>(c)</footer>"""
WANT = "Head & {0}\nFirst bold part next line\nSecond {0}\nitem {0}"


def _extract(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, __host string")
    return {r.page_id: r.text for r in html.page_report(df).collect()}


def test_furniture_goes_and_the_article_stays(spark):
    rows = [(i, f"https://h{i % 2}.example.org/{i}", PAGE.format(f"n{i}"), "clash") for i in range(10)]
    assert _extract(spark, rows) == {i: WANT.format(f"n{i}") for i in range(10)}


def test_pages_without_article(spark):
    page = "<body><div class=menu>m</div><div><p>Fixed claim</p></div><div class=text><p>{}</p><p>{}</p></div><div>short</div></body>"
    rows = [(i, "http://x.org/a", page.format(f"Long text of page {i} " * 10, f"More text {i} " * 10), "") for i in range(5)]
    got = _extract(spark, rows)
    assert got[3] == " ".join(["Long text of page 3"] * 10) + "\n" + " ".join(["More text 3"] * 10)


def test_edge_pages(spark):
    rows = [
        (0, None, None, ""), (1, "no url", "", ""), (2, "http://y.org", "plain text only", ""), (3, "http://z.org", "<article><p>open <b>end", ""),
        (4, "http://z.org", "<article><p>a</article></p></div>", ""), (5, "http://z.org", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 10, ""),
        (6, "http://q.org", "<article><p title=\"a > b\">x &lt;y&gt; &#233;&bogus;</p><script>unclosed", ""), (6, "http://q.org", "<article><p>again</p></article>", ""),
        (7, "http://w.org", "<article>" + "<p>x</p>" * 20_000 + "</article>", ""), (None, "http://w.org", "< <<a <p", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, __host string")
    got = [(r.page_id, r.text) for r in html.page_report(df).collect()]
    assert len(got) == len(rows)
    by = dict(got)
    assert by[0] == by[1] == "" and by[3] == "open end" and by[4] == "a" and by[5] == "deep"
    assert (6, "x <y> é&bogus;") in got and (6, "again") in got
    assert by[7] == "\n".join(["x"] * 20_000)
    assert html.page_report(df.limit(0)).collect() == []


def _wrapper(*pages):
    w, seen = html._element(), set()
    for p in pages:
        html.align_page(w, p, seen)
    return w


def test_mismatches_become_optional_and_repeated_groups():
    w = _wrapper("<div><h1>a</h1><p>x</p></div>", "<div><h1>b</h1><p>x</p><p>y</p><hr></div>")
    assert html.expression(w) == "<div><h1>#text</h1>(<p>#text</p>)+(<hr></hr>)?</div>"
    mixed = _wrapper("<div><h2>a</h2><p>x</p><h2>b</h2><p>y</p></div>")
    assert html.expression(mixed) == "<div>((<h2>#text</h2>)?(<p>#text</p>)?)+</div>"
    assert w["kids"]["div"]["kids"]["h1"]["kids"]["#"]["const"] is None


def test_partial_wrappers_merge_to_the_wrapper_of_all_pages():
    pages = [f"<div><p>{i}</p>" + "<ul><li>x</ul>" * (i % 3) + "<b>t</b>" * (i % 2) + "</div>" for i in range(12)]
    left, right, whole = _wrapper(*pages[:5]), _wrapper(*pages[5:]), _wrapper(*pages)
    merged = html.align_wrappers(json.loads(json.dumps(left)), right)
    assert html.expression(merged) == html.expression(whole) and html.content_paths(merged) == html.content_paths(whole)


def test_a_wrapper_stays_small():
    pages = [f"<div class='{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}x{chr(97 + i // 676)}'><p>t</p></div>" for i in range(3000)]
    w = _wrapper(*["<main>" + p + "</main>" for p in pages])
    assert len(w["kids"]["main"]["kids"]) <= html.MAX_KINDS + 10
    assert html.extract("<main>" + pages[-1] + "</main>", *[frozenset(x) for x in html.content_paths(w).values()]) == "t"


def _text(page, wrapper):
    return html.extract(page, *[frozenset(x) for x in html.content_paths(wrapper).values()])


def test_kinds_beyond_the_bound_keep_their_text():
    kinds = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)]
    for top, end in (("<main class=content><div id=page>", "</div></main>"), ("<div class=content><div id=page>", "</div></div>")):
        pages = [f"{top}<div id={k}><p>text of {k}</p></div><h2 id=h{k}>head {k}</h2>{end}" for k in kinds]
        left, right = _wrapper(*pages[:100]), _wrapper(*pages[100:])
        for w in (_wrapper(*pages), html.align_wrappers(left, right)):
            assert [_text(p, w) for p in pages] == [f"text of {k}\nhead {k}" for k in kinds]


def test_text_after_more_levels_than_the_wrapper_holds():
    for top in ("main", "div"):
        page = f"<{top}>" + "<div>" * 60 + "<p>a{0}</p><form>no</form><p>b{0}</p>" + "</div>" * 60 + f"<p>after {{0}}</p></{top}><footer>f</footer>"
        pages = [page.format(i) for i in range(5)]
        w = _wrapper(*pages)
        assert [_text(p, w) for p in pages] == [f"a{i}\nb{i}\nafter {i}" for i in range(5)]


def test_one_dropped_instance_leaves_the_others():
    for top in ("article", "div"):
        rows = [f"<{top}><p>first {i}</p><div>second {i}</div><section class='a b c d'>third {i}</section></{top}>" for i in range(6)]
        odd = f"<{top}><p>own</p><p hidden>h</p><div style='display: none'>d</div><section class='a b c d sidebar'>s</section></{top}>"
        w = _wrapper(odd, *rows)
        assert [_text(p, w) for p in rows] == [f"first {i}\nsecond {i}\nthird {i}" for i in range(6)]
        assert _text(odd, w) == "own"


def test_attributes_are_read_by_name():
    kept = ["title='The hidden valley'", 'alt="class=ad"', "data-class=ad", "title='style=\"display:none\"'", "data-hidden", "href=/id=menu"]
    gone = ["hidden", "HIDDEN=''", "title='x'class=ad", "id = 'menu'", "aria-hidden=true", "data-x style='display:none'"]
    assert [html._label("p", a) for a in kept] == [("p", False)] * len(kept)
    assert all(html._label("p", a)[1] for a in gone)


def test_names_count_as_a_whole():
    gone = ["ad-box", "adBox", "cookie-notice", "sidebar", "nav_links", "related-posts", "share-buttons", "newsletter-signup", "top ad-slot", "comments-area"]
    kept = ["social-history", "related-work", "notice-of-1789", "search-tree", "share-price", "ad-free", "headerless", "commentary", "advertising-law"]
    assert all(html._label("div", f'class="{c}"')[1] and html._label("section", f"id='{c.split()[-1]}'")[1] for c in gone)
    assert not any(html._label("div", f'class="{c}"')[1] or html._label("section", f"id='{c}'")[1] for c in kept)
    assert not any(html._label("h2", f"id='{c.split()[-1]}'")[1] for c in gone + kept)


def test_sections_and_headings_with_any_id_keep_their_text(spark):
    page = ('<article><h2 id="social-history">Social history</h2><p>one {0}</p><section id="related-work"><p>two</p></section><h3 id="comments">On comments</h3>'
            '<div id="search-tree"><p>three</p></div><p class="share-price">four</p><p>Sum <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here</p>'
            '<section id="comments"><p>a reader</p></section></article><article class="teaser"><p>other story</p></article>')
    rows = [(i, "http://ids.org/", page.format(i), "") for i in range(4)]
    assert _extract(spark, rows) == {i: f"Social history\none {i}\ntwo\nOn comments\nthree\nfour\nSum x=2 here" for i in range(4)}


def _words(word, n):
    return " ".join([f"{word}{n}"] * 12)


def test_two_templates_without_article(spark):
    side = "<section><p>Same on all pages</p></section><div class=links><a href=x>first link {0}</a> <a href=y>second link {0}</a></div><p>note {0}</p>"
    rows = []
    for i in range(20):
        kind = "post" if i % 10 < 7 else "story"
        rows.append((i, "http://two.org/x", f"<body><div class={kind}><h2>{kind} {i}</h2><p>{_words('long', i)}</p></div>{side.format(i)}</body>", ""))
    # one page of the host has no text in its template's element, one has most of it elsewhere
    rows += [(20, "http://two.org/x", f"<body><div class=post></div><div class=rare><p>{_words('rare', 20)}</p></div></body>", ""),
             (21, "http://two.org/x", f"<body><div class=post><p>brief</p></div><div class=odd><p>{_words('odd', 21)}</p></div></body>", "")]
    got = _extract(spark, rows)
    assert [got[i] for i in range(20)] == [f"{'post' if i % 10 < 7 else 'story'} {i}\n{_words('long', i)}" for i in range(20)]
    assert got[20] == _words("rare", 20) and got[21] == "brief\n" + _words("odd", 21)


def test_copies_do_not_make_a_text_fixed(spark):
    page = "<body><nav>visit {}</nav><div><h2>Short head</h2><p>One short block</p><p>" + _words("text", 1) + "</p></div></body>"
    rows = [(i, "http://copies.org/", page.format(i), "") for i in range(30)]
    want = "Short head\nOne short block\n" + _words("text", 1)
    assert _extract(spark, rows) == {i: want for i in range(30)}
    # copies of one page do not outweigh the others either
    rows += [(30 + i, "http://copies.org/", f"<body><div><h2>Head {i}</h2><p>{_words('own', i)}</p></div><ul><li>{_words('more', i)}</ul></body>", "") for i in range(2)]
    got = _extract(spark, rows)
    assert got[3] == want and got[30] == f"Head 0\n{_words('own', 0)}\n{_words('more', 0)}"
