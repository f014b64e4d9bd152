"""Tokens, blocks, code and chunks."""

import re

from pyspark.sql import functions as F

from catalog.queries import QUERIES
from pagesheaf.operators import blocks, chunks, code, tokens
from pagesheaf.plans.markdown import markdown_documents, pages_to_blocks, pages_to_markdown
from pagesheaf.sources.pages import scan_pages

SF = "/root/testdata/sf0.001"


def md(page, html):
    rows = pages_to_markdown(page(html)).collect()
    return rows[0].md if rows else None


def test_token_lengths_cover_the_page(spark):
    pages = tokens.strip_noncontent(scan_pages(spark, f"{SF}/pages.parquet"))
    cover = tokens.html_tokens(pages, keep_raw=True).groupBy("page_id").agg(F.sum(F.length("raw")).alias("n"))
    assert pages.join(cover, "page_id").where(F.length("html") != F.col("n")).count() == 0


def test_extents_with_unclosed_and_stray_tags(page):
    html = "<div><p><b>x<br><p>y</p></div></div><div id='2'>z</div>"
    spans = tokens.element_spans(tokens.html_tokens(page(html)), F.col("tag").isin("div", "p")).orderBy("start").collect()
    assert [(s.tag, s.start, s.end) for s in spans] == [("div", 0, 8), ("p", 1, 8), ("p", 5, 7), ("div", 10, 12)]


def test_root_follows_selector_order(page):
    html = "<article>a</article><main>m</main>"
    kept = tokens.content_root(tokens.html_tokens(page(html))).where("kind = 'text'").collect()
    assert [r.text for r in kept] == ["m"]
    whole = tokens.content_root(tokens.html_tokens(page("<p>x</p>"))).count()
    assert whole == 3
    assert md(page, '<p>out</p><div class="x notion-collection-view y"><p>in</p></div>after') == "in\n"


def test_semantic_html(page):
    html = """<div><h2>T <b>x</b></h2>text <i>em</i> <a href="/u?a=1&amp;b">l</a><br>next<ul><li>a</li><li>b</li></ul>
      <ol><li>c</li><li>d</li></ol><hr>after<blockquote>q</blockquote><pre><code class="language-py">x = 1
 y</code></pre><p>un<p>closed <b>bold</div> </div> stray"""
    assert md(page, html) == (
        "## T **x**\n\ntext *em* [l](/u?a=1&b)  \nnext\n\n* a\n* b\n\n1. c\n2. d\n\n---\n\nafter\n\n> q\n\n"
        "```\nx = 1\n y\n```\n\nun\n\nclosed **bold**\n\nstray\n"
    )


def block(kind, inner):
    return f'<div class="notion-selectable notion-{kind}-block" data-block-id="{kind}">{inner}</div>'


LEAF = '<div data-content-editable-leaf="true">{}</div>'


def test_block_vocabulary(page):
    html = '<div class="notion-page-content">' + "".join([
        block("header", "<div><h2 data-content-editable-leaf>H</h2></div>"),
        block("bulleted_list", '<div class="notion-list-item-box-left">•</div>' + LEAF.format("i1")) + " \n ",
        block("bulleted_list", LEAF.format("i2") + block("numbered_list", LEAF.format("n"))),
        block("callout", '<img src="icon.png">' + LEAF.format('call <img class="notion-emoji" alt="😊 s"> <img src="p.png" alt="p">')),
        block("toggle", "<button>Sum</button><div>" + block("text", LEAF.format("member")) + "</div>"),
        block("divider", "<div></div>"),
        block("text", "no leaf"),
    ]) + "</div>tail"
    assert md(page, html) == (
        "# H\n\n* i1\n* i2\n\n1. n\n\n> call 😊 ![p](p.png)\n\nSum\n\nmember\n\n---\n\nno leaf\n"
    )
    rows = {r.text: r for r in pages_to_blocks(page(html)).collect()}
    assert rows["n"].parent_block is not None and rows["member"].parent_block is not None
    assert rows["i1"].run_id == rows["i2"].run_id != rows["n"].run_id
    leaf_only = [r.text for r in pages_to_blocks(page(html), leaf_only=True).orderBy("block_no").collect()]
    assert "n" not in leaf_only and "member" in leaf_only


def test_separated_lists_are_two_runs(page):
    html = block("numbered_list", LEAF.format("a")) + block("text", LEAF.format("t")) + block("numbered_list", LEAF.format("b"))
    assert md(page, html) == "1. a\n\nt\n\n1. b\n"


CODE = '<div class="line-numbers notion-code-block" data-language="js"><span>git</span><span> x</span><span>=</span><span>1 &amp;lt;</span></div>'


def test_code_blocks(page):
    rows = code.code_blocks(tokens.html_tokens(page("<p>t</p>" + CODE))).collect()
    assert [(r.lang, r.text) for r in rows] == [("js", "git x = 1 <")]
    assert md(page, CODE) == "```\ngit x = 1 <\n```\n"
    kept = CODE.replace("<span>git</span>", "<pre>git</pre>")
    assert code.code_blocks(tokens.html_tokens(page(kept))).count() == 0


def test_code_fallback_takes_the_innermost(page):
    html = "<div><p>t</p><section><span>a</span><span>=</span><span>b</span><span>c</span></section></div>"
    t = tokens.html_tokens(page(html))
    assert code.code_blocks(t).count() == 0
    assert [r.text for r in code.code_blocks(t, span_fallback=True).collect()] == ["a = bc"]


def test_code_by_pattern(page):
    html = '<div class="line-numbers"><span>a</span><span> = </span><br>b</div><div class="x">n</div>'
    assert [r.text for r in code.code_blocks_regex(page(html)).collect()] == ["a = b"]


def test_selectables(page):
    inner = '<div class="notion-selectable" id="in">b</div>'
    html = f'<p>x</p><div class="notion-page-content"><div class="notion-selectable" data-block-id="out">a{inner}</div><div class="notion-selectable">c</div></div>'
    rows = chunks.selectable_chunks(page(html)).orderBy("pos").collect()
    assert [r.block_id for r in rows] == ["out", None] and inner in rows[0].html
    assert {r.block_id for r in chunks.selectable_chunks(page(html), nested=True).collect()} == {"out", "in", None}


def test_document_table(page):
    row = markdown_documents(page("<title>A: b</title><body><p>é</p></body>"), "/o", F.lit("2024-01-02 03:04:05").cast("timestamp")).collect()[0]
    assert row.out_path == "/o/A b - 20240102-030405/A b.md" and row.status == "ok" and row.n_bytes == len(row.md.encode())


def test_an_element_that_never_ends_takes_no_sort_of_its_own(spark, page):
    plan = pages_to_markdown(page("<h2>a<div>b</div><p>c"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Sort \[[^\]]*lost_no", plan)
    html = "<div><h2>a<div>b</div></div><p>c</p><div><blockquote>d<p>e</p></div>f<h3>g"
    assert [r.md for r in pages_to_markdown(page(html)).collect()] == ["## a\n\n## b\n\nc\n\n> d\n\n> e\n\nf\n\n### g\n"]


def test_partitions_follow_the_size_of_the_pages(spark, page):
    """A partition holds so many bytes of HTML whatever the table holds, also where adaptive execution would merge them."""
    rows = spark.range(64).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("<p>same</p>"), 50_000).alias("html"))
    size = 64 * 11 * 50_000
    for df in (tokens.html_tokens(rows, cluster=True), blocks.block_segments(rows)):
        used = df.select("page_id").distinct().select(F.spark_partition_id().alias("p")).distinct().count()
        assert tokens.page_partitions(rows) >= size / tokens.PARTITION_BYTES and used > 8
    assert tokens.page_partitions(page("<p>x</p>")) is None


def test_marked_elements_are_made_once_for_the_fallback(page):
    html = "<section><span>a</span><span>=</span><span>b</span><span>c</span></section>"
    found = code.code_blocks(tokens.html_tokens(page(html), cluster=True), span_fallback=True)
    assert "starts" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert len(found.collect()) == 1


def test_words_meet_behind_one_exchange_of_whole_texts(spark):
    plan = QUERIES["dedup_matches_ci"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert [k.split("#")[0] for k in re.findall(r"hashpartitioning\(([^)]*)\)", plan)] == ["doc_id"] and "_w0" not in re.search(r"hashpartitioning\(([^)]*)\)", plan).group(1)


def test_one_exchange_serves_the_whole_plan(spark):
    df = pages_to_markdown(scan_pages(spark, f"{SF}/pages.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange\b", plan)) == 1
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan
    assert "Python" not in plan


def test_lists_nest_and_items_hold_paragraphs(page):
    assert md(page, "<ol><li><p>a</p><p>b</p></li><li>c</li></ol>") == "1. a\n\n    b\n2. c\n"
    assert md(page, "<ol><li>a<ol><li>b</li><li>d</li></ol></li><li>c</li></ol>") == "1. a\n    1. b\n    2. d\n2. c\n"
    assert md(page, "<ul><li>a<ul><li>b<ul><li>x</li></ul></li></ul></li></ul><p>end</p>") == "* a\n    * b\n        * x\n\nend\n"
    assert md(page, "<ul><li>a<li>b</ul><ol><li>c</ol>") == "* a\n* b\n\n1. c\n"


def test_elements_without_a_close_tag_end_with_their_surroundings(page):
    assert md(page, "<div><h2>T</div><p>text</p><p>more</p>") == "## T\n\ntext\n\nmore\n"
    assert md(page, "<div><blockquote>q</div><p>text</p>") == "> q\n\ntext\n"
    assert md(page, "<div><blockquote>q<p>r</p></div><p>t</p><blockquote>z</blockquote>u") == "> q\n\n> r\n\nt\n\n> z\n\nu\n"
    assert md(page, "<section><div><h3>T</div><p>text</section><h1>H</h1>x") == "### T\n\ntext\n\n# H\n\nx\n"


def test_own_tag_of_a_code_element_does_not_count(page):
    html = '<pre class="line-numbers notion-code-block"><span>x = 1</span></pre>'
    assert [r.text for r in code.code_blocks(tokens.html_tokens(page(html))).collect()] == ["x = 1"]


# Page, tags asked for, and their extents; NULL where an element lasts to the end of the page.
ENDS = {
    "siblings without a close": ("<ul><li>a<li>b</ul>c", ["li"], [("li", 1, 5), ("li", 3, 5)]),
    "closest closed element around": ("<section><div><p>a</div><p>b</section>", ["p"], [("p", 2, 4), ("p", 5, 7)]),
    "surroundings without a close": ("<main><div><p>a<b>c</main>d", ["div", "p", "b"], [("div", 1, 6), ("p", 2, 6), ("b", 4, 6)]),
    "nothing around": ("<p>a<div>b</div>c", ["p", "div"], [("p", 0, None), ("div", 2, 4)]),
    "stray closes": ("</p></div><div><p>a</span></div><i>x", ["div", "p", "i"], [("div", 2, 6), ("p", 3, 6), ("i", 7, None)]),
    "crossing marks": ("<b><i><u>x</b>y</i>z", ["b", "i", "u"], [("b", 0, 4), ("i", 1, 6), ("u", 2, 4)]),
    "void and self-closed": ("<div><img><br/>a<p>b</div>", ["p", "img"], [("p", 4, 6)]),
}


def test_ends_of_elements(spark):
    rows = [(name, html) for name, (html, *_) in ENDS.items()]
    pages = spark.createDataFrame([*rows, ("empty", ""), ("null", None)], "page_id string, html string")
    got = tokens.element_spans(tokens.html_tokens(pages), F.lit(True)).collect()
    for name, (_, tags, extents) in ENDS.items():
        found = sorted((r.start, r.tag, r.end) for r in got if r.page_id == name and r.tag in tags)
        assert [(tag, start, end) for start, tag, end in found] == extents, name
    assert not [r for r in got if r.page_id in ("empty", "null")]


def test_tokens_inside_elements_without_a_close(page):
    html = "<div><p x>a<p x>b</div>c<p x>d</p>e<div><p>f</div>"
    kept = tokens.inside_elements(tokens.html_tokens(page(html)), F.col("attrs") == "x").orderBy("pos").collect()
    assert [(r.pos, r.around, r.starts) for r in kept] == [
        (1, 1, True), (2, 1, False), (3, 2, True), (4, 2, False), (7, 1, True), (8, 1, False), (9, 1, False)]


def test_code_candidates_by_their_content(page):
    cls = 'class="line-numbers notion-code-block"'
    inner = f'<div {cls}><span>x</span><span>=</span>1</div>'

    def texts(html, **options):
        return [r.text for r in code.code_blocks(tokens.html_tokens(page(html)), **options).orderBy("pos").collect()]

    assert texts(f"<div {cls}><pre>a</pre>{inner}</div>") == ["x = 1"]
    assert texts(f"<div {cls}>{inner}<p>after</p></div>") == ["x = 1after"]
    assert texts(f"<div {cls}><code>a</code>{inner}{inner.replace('x', 'y')}</div>") == ["x = 1", "y = 1"]
    assert texts(f"<div {cls}><div {cls}><pre>a</pre>{inner}</div>tail</div>") == ["x = 1"]
    assert texts(f"<pre {cls}><span>k</span></pre><p>t</p><pre>z</pre>") == ["k"]
    assert texts(f"<section><div {cls}>u</section><code>v</code>") == ["u"]
    assert texts(f"<div {cls}>u<code>v</code>") == []
    spans = "<section><span>a</span><span>b</span><span>c</span><span>d</span></section>"
    assert texts(f"<div {cls}><pre>a</pre>{spans}</div>", span_fallback=True) == ["abcd"]
