"""Pages: deep containers, comments inside articles, pages without semantic tags, repeated rows and long pages."""

from __future__ import annotations

import pytest

from pairspan.llm import html_extract as he

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def network(spark):
    return he.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def deep(inner, name, levels=10):
    """Ten levels of elements with many classes between a named container and its blocks."""
    for k in range(levels):
        inner = f'<div class="grid col-{k} u-flex u-wrap box shadow-{k} px{k}">{inner}</div>'
    return f'<div class="{name}">{inner}</div>'


def text_of(page, network):
    return he.main_texts([page], network, {})[0]


def test_deep_sidebar_and_comments_go(network):
    body = "".join(f"<p>Thonre ingea wasti anher enthe, ndble the onat of reing {k}.</p>" for k in range(6))
    side = deep("<p>Thoned inghe andre, it was the onble of an ting.</p>" * 3, "sidebar widget-area")
    talk = deep("<p>Hean the ndre was ti onhe, ed of ingre thst.</p>" * 3, "comments")
    got = text_of(f"<html><body><nav><a href='/a'>Home</a></nav>{side}<article><h1>Title of it</h1>{body}</article>{talk}<footer>c 2020</footer></body></html>", network)
    assert got.startswith("Title of it Thonre") and got.count("Thonre") == 6
    assert "Thoned" not in got and "Hean" not in got and "Home" not in got and "2020" not in got


def test_deep_article_stays(network):
    body = deep("".join(f"<p>Thonre ingea wasti anher enthe, ndble the onat of reing {k}.</p>" for k in range(6)), "wrap")
    got = text_of(f"<html><body><nav><a href='/a'>Home</a></nav><article>{body}</article></body></html>", network)
    assert got.count("Thonre") == 6 and "Home" not in got


def test_labels_see_tags_and_class_words():
    found = he.blocks(
        "<article><p>a</p><section class='comments'><p>b</p></section><article class='comment'><p>c</p></article><aside><p>d</p></aside><div class='ad'>e</div><div class=x><p>f</p></div></article><p>g</p>"
    )
    assert dict(zip((b.text for b in found), he.page_labels(found), strict=True)) == {"a": 1, "b": 0, "c": 0, "d": 0, "e": 0, "f": 1, "g": 0}
    named = he.blocks("<div id=top>x</div><div class='post-body entry'><p>a</p><div class=share>b</div></div><div class=sidebar>c</div>")
    assert dict(zip((b.text for b in named), he.page_labels(named), strict=True)) == {"x": 0, "a": 1, "b": 0, "c": 0}
    assert he.page_labels(he.blocks("<div><p>a</p></div>")) is None


def test_table_without_semantic_tags(spark):
    rows = []
    for k in range(60):
        body = "".join(f"<p>Thonre ingea wasti anher {k} enthe, ndble the onat of reing {i}.</p>" for i in range(4))
        rows.append((k, f"<body><ul class='menu'><li><a href=x>Home {k}</a></li></ul><div class='post'><h1>T{k}</h1>{body}</div><div class='footer'>about us {k}</div></body>"))
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("page_id", "null as url", "html")
    network = he.fit(pages)
    got = {r.page_id: r.text for r in he.extract(pages, network).collect()}
    assert all("Home" not in t and "about" not in t and t.count("Thonre") == 4 for t in got.values())


def test_nothing_to_learn_from(spark):
    page = "<body><nav>menu</nav><div class='comments'><p>talk</p></div><div><p>text here</p></div><footer>end</footer></body>"
    pages = spark.createDataFrame([(1, None, page), (1, None, page), (2, None, None)], "page_id long, url string, html string")
    assert he.fit(pages) is None
    assert sorted((r.page_id, r.text) for r in he.extract(pages, None).collect()) == [(1, "text here"), (1, "text here"), (2, "")]


def test_clashing_columns_and_long_page(spark, network):
    long = "<article>" + "<p>Thonre ingea wasti, anher the.</p>" * 20_000 + "</article>"
    rows = [(1, "u", long, "x", 3), (1, "u", long, "y", 4)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = [(r.text.count("Thonre"), r.n_chars) for r in he.extract(pages, network).collect()]
    assert got == [(20_000, len("Thonre ingea wasti, anher the. " * 20_000) - 1)] * 2
