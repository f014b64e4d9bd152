"""Scalar expressions against literal rows and the Python standard library."""

import html
from urllib.parse import quote, urljoin

import pytest
from pyspark.sql import functions as F

from pagesheaf.functions import markup, names, text, urls

X = F.col("x")


@pytest.mark.parametrize("url,key", [
    ("https://www.notion.so/Some-Title-abcdef123456", "abcdef123456"),
    ("file:///C:/pages/Some-Title-abcdef123456", "abcdef123456"),
    ("", ""), ("https://a.com/plain/", "/plain"), ("https://a.com/a-b?x=c-d#e-f", "b"),
])
def test_page_key(value, url, key):
    assert value(urls.page_key(X), x=url) == key


def test_page_hex_id(value):
    h = "AABBccdd11223344aabbccdd11223344"
    assert value(urls.page_hex_id(X), x=f"https://notion.so/My-{h}?v=1") == h.lower()
    assert value(urls.page_hex_id(X), x=f"https://notion.so/{h}/sub") == h.lower()
    assert value(urls.page_hex_id(X), x="https://notion.so/help") == ""


def test_unescape_equals_standard_library(spark):
    samples = ["a&amp;b", "&copy2024", "&notit;", "&#39;&#x41;&#65 z", "&#128;&#0;&#xD800;&#x110000;&#1;x", "&amp;lt;",
               "R&D & x", "&nbsp;&hellip;&bogus;", "&", "&&amp", "no", "&NewLine;&Tab;|", "&vert;&equals;", "&Aacute&AElig",
               "&CounterClockwiseContourIntegral;", "&#99999999999999999999;", "a &lt b"]
    df = spark.createDataFrame([(s,) for s in samples], "x string")
    for row in df.select("x", text.html_unescape(X).alias("v")).collect():
        assert row.v == html.unescape(row.x), row.x


def test_resolve_url_equals_standard_library(spark):
    bases = ["https://example.com/base/page", "http://a/b/c/d;p?q", "https://e.com", "https://e.com/x/?q=1#f"]
    refs = ["g", "./g", "g/", "/g", "//g/h", "?y", "g?y", "#s", "g#s", "", ".", "./", "..", "../", "../g", "../..", "../../g",
            "../../../g", "/./g", "/../g", "g.", "..g", "./../g", "g/./h", "g/../h", "http://z/y", "mailto:a@b",
            "data:image/png;base64,aGk=", "a//b", "/a//b", "../a//b/./c", "?", "#", "/path/image.png"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for row in df.select("b", "r", urls.resolve_url(F.col("b"), F.col("r")).alias("v")).collect():
        assert row.v == urljoin(row.b, row.r), (row.b, row.r)


@pytest.mark.parametrize("raw", ["a b/c~*+é", "(x)[y].png", "a%b&c=d"])
def test_quote_path(value, raw):
    assert value(urls.quote_path(X), x=raw) == quote(raw, safe="/")


def test_attributes(value):
    a = """class="a b" data-x="src=1 src='no'" src='/u?a=1&amp;b=2' SRC="/last" disabled alt=plain"""
    assert value(markup.attr(X, "src"), x=a) == "/last"
    assert value(markup.attr(X, "alt"), x=a) == "plain"
    assert value(markup.attr(X, "disabled"), x=a) == ""
    assert value(markup.has_attr(X, "disabled"), x=a) is True
    assert value(markup.attr(X, "none"), x=a) == ""


def test_image_source_and_emoji(value):
    assert value(markup.image_src(X), x='srcset="/images/a.png 1x, /images/b.png 2x"') == "/images/a.png"
    assert value(markup.image_src(X), x='src="" data-src="/d.png"') == "/d.png"
    assert value(markup.emoji_text(X), x='class="notion-emoji" alt="😊 smile"') == "😊"
    assert value(markup.emoji_text(X), x='class="notion-emoji" alt="emoji"') == ""
    assert value(markup.is_emoji_img(X), x='class="x notion-emoji"') is True
    assert value(markup.is_emoji_img(X), x='class="notion-emoji2" src="/a.png"') is False


@pytest.mark.parametrize("html_text,title", [
    ("<title> T &amp; U </title><h1>H</h1>", "T & U"), ("<title> </title><h1><b>H</b></h1>", "H"), ("<h1></h1><h2>H2</h2>", "H2"),
    ("<h3>H3</h3>", "H3"), ('<meta property="og:title" content="OG"><p>x</p>', "OG"), ("<p> </p>\n<p>first</p><p>second</p>", "first"),
    ("<script>var a</script>", None), ("", None),
])
def test_title_chain(value, html_text, title):
    assert value(markup.extract_title(X), x=html_text) == title


@pytest.mark.parametrize("parts,expected", [
    (("git commit --author=\"PR &lt;p@x.com&gt;\"", True), 'git commit --author = "PR <p@x.com>"'),
    (("Carregando código de Plain Text...", False), ""),
    (("Carregando def x=1", False), " def x=1"),
    (("foo&nbsp;&lt;bar&gt;", False), "foo <bar>"),
])
def test_code_text(value, parts, expected):
    assert value(text.code_text(X, F.lit(parts[1])), x=parts[0]) == expected


def test_placeholders_in_text(value):
    for sample in ("Carregando...", "Some Loading code here", "Loading"):
        assert value(text.placeholder_matches(X).getField("has"), x=sample) is True
    assert value(text.placeholder_matches(X).getField("matches"), x="LOADING loading Loading code") == ["LOADING", "Loading code"]
    assert value(text.placeholder_matches(X, ["FOO", "bar"]).getField("matches"), x="foo happened, Foo") == ["foo"]
    assert value(text.placeholder_matches(X, use_regex=False).getField("matches"), x="downloading") == ["Loading"]
    assert value(text.placeholder_matches(X).getField("matches"), x="écarregando") == []
    assert value(text.placeholder_matches(X).getField("has"), x="") is False


def test_names(value):
    assert value(names.sanitize_filename(X), x='  a/b:\t c?"  ') == "ab c"
    url = F.lit("https://n.so/T-abc")
    assert value(names.output_name(X, url), x="?*") == "abc.md"
    assert value(names.output_name(X, F.lit("")), x="") == "notion_page.md"
    assert len(value(names.output_name(X, url), x="y" * 300)) == 163
    assert value(names.safe_asset_name(X), x="a  (b).x y") == "a_b.x y"
    assert value(names.safe_asset_name(X), x="é.png") == "asset.png"
    assert value(names.safe_asset_name(X), x=".png") == ".png"


def test_output_paths(value):
    folder = names.output_folder(F.lit("/out"), X, F.lit("http://example.com"), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    assert value(folder, x="Title") == "/out/Title - 20240102-030405"
    assert value(names.output_path(F.lit("/out/f"), X), x="Title.md") == "/out/f/Title.md"
    assert value(names.assets_folder(F.lit("/out/f"), X, F.lit(None)), x="/out/f/Title.md") == "/out/f/Title_assets"
    assert value(urls.asset_rel_path(F.lit("page_assets"), X), x="img.png") == "page_assets/img.png"


def test_data_uri(value):
    parts = urls.data_uri_parts(X)
    assert value(parts, x="data:image/png;base64,aGk=") == ("embedded.png", bytearray(b"hi"))
    assert value(parts, x="data:x/none;base64,aGk=").name == "embedded.bin"
    assert value(parts.getField("content"), x="data:image/png;base64") is None


def test_loading_phrase(value):
    assert value(text.is_loading_phrase(X), x=" Loading code ") is True
    assert value(text.is_loading_phrase(X), x="loading") is False


def test_comments_scripts_and_unclosed_elements(value):
    removed = markup.remove_elements(X)
    assert value(removed, x="<!-- <script> --><p>Hello</p><script>x</script><p>end</p>") == "<!-- <script> --><p>Hello</p><p>end</p>"
    assert value(removed, x="<p>body</p><script>var leak=1;") == "<p>body</p>"
    assert value(removed, x="<style-guide>a</style-guide><link-card>b</link-card>") == "<style-guide>a</style-guide><link-card>b</link-card>"
    assert value(removed, x="<noscript>a<p>b</p>") == "<noscript>a<p>b</p>"
    title = markup.extract_title(X)
    assert value(title, x="<!-- <h1>old</h1> --><h1>new</h1>") == "new"
    assert value(title, x="<script>var s=\"<title>js</title>\"</script><h1>T</h1>") == "T"
    assert value(title, x="<!-- open <h1>never</h1>") is None


def test_every_named_reference(value):
    import html.entities

    names = sorted(html.entities.html5)
    text_ = " ".join(f"&{n}" for n in names)
    import html as h

    assert value(text.html_unescape(X), x=text_) == h.unescape(text_)
