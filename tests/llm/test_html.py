import html
import re

import duckdb
import pytest

from storelens.llm import html_extract as H

DIR = "/root/testdata/sf0.01"


def text(page, tree=None):
    return H.extract(page, tree)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a<p>b</p>c", "a b c"),
        ("<article><h1>T</h1><p>x &amp; y &lt;z&gt; &eacute;&#233;&amp</p></article>", "T x & y <z> éé&"),
        ("<article><p>one<br>two <b>bo</b>ld\n\t line</p></article>", "one two bold line"),
        ("<body><nav>menu</nav><main>m1<aside>s</aside> m2</main><footer>f</footer></body>", "m1 m2"),
        ("<body><div class='ad'>buy</div><div id=cookie-notice>c</div><p>t</p><div class='comments'>r</div></body>", "t"),
        ("<script>var t='</p>';if(a<b){}</script><style>p{}</style><p>t</p><!-- c --><form>f</form>", "t"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"),
        ("<article><p>a</p></article><div>x</div><article>b</article>", "a b"),
        ("<p>unclosed <b>bold <i>it", "unclosed bold it"),
        ("<div hidden>h</div><div style='display: none'>n</div><div role=navigation>r</div><p>a &nbsp; b</p>", "a b"),
        ("<article>trunc<p>ated &am", "trunc ated &am"),
    ],
)
def test_markup(page, want):
    assert text(page) == want


def page(i, title, body):
    return (
        f"<html><body><div class=top>Site of the year</div><div class=x1><a>Home</a> <a>About</a></div>"
        f"<div class=c><h2>{title}</h2>{body}</div><div class=x9>All rights kept</div></body></html>"
    )


def test_constant_nodes_are_template():
    pages = [page(i, f"Title {i}", f"<p>Text {i}</p>" * (i + 1)) for i in range(8)]
    tree = H.overlay(H.parse(pages[0]))
    for p in pages[1:]:
        tree = H.merge(tree, H.overlay(H.parse(p)))
    assert tree["n"] == 8
    assert text(pages[2], tree) == "Title 2 Text 2 Text 2 Text 2"
    few = H.merge(H.overlay(H.parse(pages[0])), H.overlay(H.parse(pages[1])))
    assert text(pages[0], few).startswith("Site of the year")  # two pages are no evidence
    same = H.overlay(H.parse(pages[0]))
    for _ in range(9):
        same = H.merge(same, H.overlay(H.parse(pages[0])))
    assert text(pages[0], same) == text(pages[0])  # copies of one page say nothing of what varies


def test_simple_tree_matching():
    t = lambda label, *kids: {"l": label, "k": list(kids)}
    a = t("r", t("a", t("b")), t("c"), t("d"))
    assert H.match_size(a, a) == 5
    assert H.match_size(a, t("r", t("c"), t("a", t("b")), t("d"))) == 4  # order counts: a with b and d, not c
    assert H.match_size(a, t("s")) == 0 and H.match_size(a, t("r")) == 1


def test_pages_of_the_test_data(spark):
    rows = duckdb.sql(f"SELECT page_id, html FROM '{DIR}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in H.extract_pages(spark.read.parquet(f"{DIR}/pages.parquet")).collect()}
    assert len(got) == len(rows)
    for i, source in rows:
        inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
        plain = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))
        want = re.sub(r"\s+", " ", html.unescape(plain)).strip()
        assert got[i].text == want and got[i].n_chars == len(want)


def test_edge_cases(spark):
    schema = "page_id long, url string, html string, tree string, host string, salt string"
    rows = [(1, "http://A.example/x", page(1, "t", "<p>b</p>"), "x", "x", "x")] * 2 + [
        (2, None, None, "x", "x", "x"), (None, "no host", "<p>é😀</p>", "x", "x", "x"), (3, "http://a.example", "<div>" * 3000 + "deep", "x", "x", "x"),
    ]
    got = H.extract_pages(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5
    by = {r.page_id: r for r in got}
    assert by[2].text == "" and by[2].n_chars == 0 and by[2].url is None
    assert (by[None].text, by[None].n_chars) == ("é😀", 2) and by[3].text == "deep"
    assert H.extract_pages(spark.createDataFrame([], schema)).collect() == []


def test_one_host_with_all_pages(spark):
    rows = [(i, "http://one.example/p", page(i, f"Title {i}", f"<p>Text {i}</p>")) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    assert {r.text for r in H.extract_pages(df).collect()} == {f"Title {i} Text {i}" for i in range(300)}


def marked(i, tag, more=""):
    return (
        f"<body><div class=top>Site</div><{tag}><div class=by>Written for Site</div><h1>Title {i}</h1><p>Text {i}</p>"
        f"<div class=box><p>Read more on Site</p></div>{more}</{tag}><div class=x9>Kept</div></body>"
    )


@pytest.mark.parametrize("tag", ["article", "main"])
def test_template_within_the_article(spark, tag):
    rows = [(i, "http://one.example/p", marked(i, tag)) for i in range(12)]
    got = H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Title {i} Text {i}" for i in range(12)}


def host_pages(spark, pages):
    df = spark.createDataFrame([(i, "http://one.example/p", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in H.extract_pages(df).collect()}


def test_template_at_any_place(spark):
    def many(i):  # a constant line behind a varying number of alternating elements, and one below 30 levels
        runs = "".join(f"<h2>Head {i} {k}</h2><p>Par {i} {k}</p><ul><li>Item {i} {k}</ul>" for k in range(30 + i))
        return f"<body>{runs}<p>All rights kept</p>{'<section>' * 30}<p>Printed here</p><p>Note {i}</p>{'</section>' * 30}</body>"

    got = host_pages(spark, [many(i) for i in range(9)])
    for i, text in got.items():
        want = " ".join(f"Head {i} {k} Par {i} {k} Item {i} {k}" for k in range(30 + i))
        assert text == f"{want} Note {i}"


def test_template_beside_alike_elements(spark):
    def alike(i):  # no class tells the menu, the content and the footer from each other
        return f"<body><div>Home About</div><div>Text {i}</div><div id=foot>Imprint</div><div>All rights kept</div></body>"

    assert host_pages(spark, [alike(i) for i in range(9)]) == {i: f"Text {i}" for i in range(9)}


def test_induction_on_spark_equals_that_in_memory(spark):
    pages = [page(i, f"Title {i % 4}", f"<p>Text {i}</p>" * (i % 3 + 1)) for i in range(20)]
    tree = H.overlay(H.parse(pages[0]))
    for p in pages[1:]:
        tree = H.merge(tree, H.overlay(H.parse(p)))
    df = spark.createDataFrame([("http://a.example/", p) for p in pages * 3], "url string, html string")
    assert [set(r["keys"]) for r in H.induce(df).collect()] == [H.template_keys(tree)]


def test_inline_words_are_part_of_their_line(spark):
    got = host_pages(spark, [f"<body><p>See <b>the</b> text {i}</p><p><b>Tags</b> <a>t{i}</a></p></body>" for i in range(6)])
    assert got == {i: f"See the text {i} t{i}" for i in range(6)}


def test_deviating_pages_do_not_hide_template(spark):
    pages = [page(i, f"Title {i}", f"<p>Text {i}</p>") for i in range(40)]
    pages[3] = pages[3].replace("All rights kept", "All rights lost")
    pages[7] = pages[7][: pages[7].index("</div><div class=x9>")]  # cut off
    pages[9] = pages[9].replace("Site of the year", "Site of the month")
    got = host_pages(spark, pages)
    assert got[3] == "Title 3 Text 3 All rights lost" and got[9] == "Site of the month Title 9 Text 9"
    assert all(got[i] == f"Title {i} Text {i}" for i in range(40) if i not in (3, 9))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class='content no-sidebar'><p>a</p></div>", "a"),
        ("<div id=page class='has-header with-sidebar'><article>a</article></div>", "a"),
        ("<article><p>a</p><div class='widget-content'>b</div><p class=notice>c</p><div class=related>d</div></article>", "a b c d"),
        ("<article><p>a</p><div class=ads>x</div><div class='comment-list'>r</div></article>", "a"),
        ("<form id=aspnetForm><nav>m</nav><div><p>a</p></div></form><form><input>f</form>", "a"),
        ("<body><div class=widget><article>a</article></div><p>b</p></body>", "a"),
        ("<article>a</article><div class=comments><article>r</article></div>", "a"),
        ("<div class=overlay><p>a</p></div>", "a"),
        ("<article>x <math><mi>y</mi><mo>=</mo><mn>2</mn></math> z<object>o</object></article><object>p</object>", "x y=2 z o"),
        ("<div class='site-header'>h</div><div class=top-nav>n</div><form hidden><p>f</p></form><p>a</p>", "a"),
    ],
)
def test_names_hide_no_article(page, want):
    assert re.sub(r"\s+", " ", text(page)) == want


def test_content_in_an_element_that_a_name_calls_chrome(spark):
    pages = [f"<body><div class=widget><p>Site</p><p>Text {i}</p><p>Kept</p></div><footer>f</footer></body>" for i in range(6)]
    assert host_pages(spark, pages) == {i: f"Text {i}" for i in range(6)}


def test_near_copies_of_one_article_keep_their_text(spark):
    """Six edited copies of a long story among forty short pages: places that only they have prove nothing."""
    def layout(title, paragraphs):
        return f"<body><div class=top>Site</div><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "<div class=end>Imprint</div></body>"

    pages = [layout(f"Title {i}", [f"Own {i} {k}" for k in range(3)]) for i in range(40)]
    pages += [layout(f"Story version {i}", [f"Story paragraph {k}" for k in range(10)]) for i in range(6)]
    got = host_pages(spark, pages)
    for i in range(6):
        assert got[40 + i] == f"Story version {i} " + " ".join(f"Story paragraph {k}" for k in range(10))
    assert all(got[i] == f"Title {i} Own {i} 0 Own {i} 1 Own {i} 2" for i in range(40))


def test_header_of_an_article_is_its_text():
    assert text("<header>Site</header><article><header><h1>Title</h1></header><p>x</p></article>") == "Title x"
