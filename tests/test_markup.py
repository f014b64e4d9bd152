"""Quoted angle brackets, roles on inline tags, links around blocks, and tables."""

import pytest
from pyspark.sql import functions as F

from pagesheaf.functions import markup
from pagesheaf.operators import assets, blocks, links, tokens
from pagesheaf.plans.markdown import pages_to_blocks, pages_to_markdown

PAGE = "https://ws.notion.site/P-0123456789abcdef0123456789abcdef"

# Page and Markdown; all of them are converted by one plan.
CASES = {
    "quoted angle bracket": ('<a title="x>y" href="https://e.org">t</a>', "[t](https://e.org)"),
    "tags in a value": ("<p title='a<p>b</div>'>q</p><p>r</p>", "q\n\nr"),
    "a quote that never ends": ('<p a="open>q</p><p>z</p>', "q\n\nz"),
    "an apostrophe that is no value": ("<p don't>q</p><p it's>z</p>", "q\n\nz"),
    "brackets in a script": ('<script>if (a<b) s="</p>";</script><p x="a>b">x</p>', "x"),
    "inline root": ('<i>no</i><span class="a notion-collection-view"><p>in <span>s</span></p></span><p>out</p>', "in s"),
    "inline leaf": ('<div class="notion-text-block"><span data-content-editable-leaf>leaf <span>x</span></span>outside</div>', "leaf x"),
    "inline marker": (
        '<div class="notion-bulleted_list-block"><span class="notion-list-item-box-left">o</span><div data-content-editable-leaf="1">item</div></div>',
        "* item"),
    "linked card": ('<a href="/x"><p>card</p></a><p>out</p>', "[card](/x)\n\nout"),
    "linked blocks": ('<a href="/u"><h2>H</h2><p>p <b>q</b></p></a>r', "## [H](/u)\n\n[p **q**](/u)\n\nr"),
    "bold around a block": ("<b><p>in</p></b><p>out</p>", "in\n\nout"),
    "anchors without address or text": ('<a name="n"></a><p>z</p>r <a href="/e"> </a><p><a>t</a></p>', "z\n\nr\n\nt"),
    "head": ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", "| A | B |\n| --- | --- |\n| 1 | 2 |"),
    "head section, spans": (
        "<table><thead><tr><td>A</td><td>B</td></tr></thead><tr><td rowspan=2>1</td><td>2 | x</td></tr><tr><td><p>3</p><p>4</p></td></tr></table><p>after</p>",
        "| A | B |\n| --- | --- |\n| 1 | 2 \\| x |\n|  | 3 4 |\n\nafter"),
    "no head, nested": (
        '<p>x</p><table><tr><td colspan="2">w</td><td>c</td></tr><tr><td></td><td>e<table><tr><td>n1</td><td>n2</td></tr></table></td></tr></table>',
        "x\n\n|  |  |  |\n| --- | --- | --- |\n| w |  | c |\n|  | e n1 n2 |  |"),
    "no close tags, span to the end": ("<table><tr><td rowspan=0>r<td>a<tr><td>b</table>q", "|  |  |\n| --- | --- |\n| r | a |\n|  | b |\n\nq"),
    "crossing spans": (
        "<table><tr><th>a<th rowspan=3>b<th>c</tr><tr><td colspan=2>d</tr><tr><td>e<td>f</tr></table>",
        "| a | b | c |\n| --- | --- | --- |\n| d |  |  |\n| e |  | f |"),
    "odd spans": ("<table><tr><td colspan=x rowspan=-1>a</td><td colspan=99999999>b</td></tr></table>", "|  |  |\n| --- | --- |\n| a | b |"),
    "two tables": ("<table><tr><th>a</table><table><tr><th>b</table>", "| a |\n| --- |\n\n| b |\n| --- |"),
    "table in an item": ("<ul><li>i<table><tr><th>h</th></tr></table></li></ul>", "* i\n\n| h |\n| --- |"),
    "marks and code in cells": ("<table><tr><th><b>a</b></th><th><pre>x  y</pre></th></tr></table>", "| **a** | x y |\n| --- | --- |"),
    "no rows": ("<table></table><p>k</p>", "k"),
}


@pytest.fixture(scope="module")
def written(spark):
    rows = [(i, PAGE, html) for i, (html, _) in enumerate(CASES.values())]
    return {r.page_id: r.md for r in pages_to_markdown(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}


@pytest.mark.parametrize("name", CASES)
def test_markdown(written, name):
    assert written[list(CASES).index(name)] == CASES[name][1] + "\n"


def test_quoted_angle_brackets_in_every_table(page):
    html = '<a title="x>y<b" href="https://ws.notion.site/B-11111111111111111111111111111111">t</a><img alt=\'p>q\' src="/a.png">'
    df = page(html)
    assert [(r.kind, r.tag) for r in tokens.html_tokens(df).orderBy("pos").collect()] == [("open", "a"), ("text", None), ("close", "a"), ("open", "img")]
    assert [r.text for r in links.page_links(df).collect()] == ["t"]
    assert [(r["pass"], r.src) for r in assets.asset_refs(df).where("pass = 1").collect()] == [(1, "/a.png")]
    attrs = tokens.html_tokens(df).where("pos = 0").select(markup.attr(F.col("attrs"), "title").alias("t")).first().t
    assert attrs == "x>y<b"


def test_plain_tags_leaves_other_pages_alone(value):
    for html in ["<p a='b'>x > y</p>", "<!-- a=\"<\" -->", "a = 'b' < c", "", "<p =\"x\">"]:
        assert value(markup.plain_tags(F.col("x")), x=html) == html
    assert value(markup.plain_tags(F.col("x")), x='<!-- "> --><p t="<a>">"<"</p><script>a="<b>"</script>') == (
        '<!-- "> --><p t="&lt;a&gt;">"<"</p><script>a="<b>"</script>')


def test_tokens_and_segments_give_the_same_root(page):
    df = page('<p>a</p><span class="notion-collection-view"><p>in</p>tail</span><main>out</main>')
    by_tokens = tokens.content_root(tokens.html_tokens(df, cluster=True)).where("kind = 'text'")
    by_segments = tokens.content_root(blocks.block_segments(df), keep_close=False)
    assert [r.text for r in by_tokens.orderBy("pos").collect()] == ["in", "tail"]
    assert [r.body for r in by_segments.orderBy("pos").collect() if r.body] == ["in", "tail"]


def test_rows_are_blocks(page):
    rows = pages_to_blocks(page("<p>x</p><table><tr><th>A</tr><tr><td>1</tr></table>")).orderBy("block_no").collect()
    assert [(r.kind, r.level, r.text) for r in rows] == [
        ("paragraph", None, "x"), ("table_row", 1, "| A |\n| --- |"), ("table_row", 2, "| 1 |")]


def test_long_unclosed_quotes_are_read_once(value):
    """A tag with thousands of attributes and a quote that never ends takes one pass."""
    html = "<p " + "a='b' c=\"d\" " * 20_000 + 'e="<' + "x" * 200_000
    assert len(value(markup.plain_tags(F.col("x")), x=html)) == len(html)
