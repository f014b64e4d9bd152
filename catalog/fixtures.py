"""Tables Spark derives from the bundled ones, because those hold no images, code or block markup.

Every rule is row-local or a plain filter, uses whole tables and grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesheaf.operators.snapshots import number_attempts
from pagesheaf.sources.pages import scan_pages

EXAMPLE_HOSTS = r"^https?://[^/]*\.example\.(com|net|org)/"
BLOCK_CLASSES = [
    "header", "sub_header", "sub_sub_header", "text", "bulleted_list", "bulleted_list", "numbered_list", "quote",
    "divider",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pages(spark, f"{sf_dir}/pages.parquet")


def in_article(html: Column, extra: Column) -> Column:
    return F.replace(html, F.lit("</article>"), F.concat(extra, F.lit("</article>")))


def block_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block page per conversation turn, one block per line that is not blank."""
    talk = table(spark, sf_dir, "conversations")
    kinds = F.array(*[F.lit(k) for k in BLOCK_CLASSES])

    def block(line: Column, i: Column) -> Column:
        k = (F.col("conv_id") + F.col("turn") + F.floor(i / 2)) % 9
        return F.when(F.trim(line) == "", "").otherwise(
            F.concat(
                F.lit('<div class="notion-selectable notion-'), F.get(kinds, k.cast("int")),
                F.lit('-block" data-block-id="b'), F.concat_ws("-", F.col("conv_id"), F.col("turn"), i),
                F.lit('"><div data-content-editable-leaf="true">'), line, F.lit("</div></div>"),
            )
        )

    body = F.array_join(F.transform(F.split("text", "\n"), block), "")
    return talk.select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("page_id"),
        F.concat(F.lit("https://ws.notion.site/Talk-"), "conv_id", F.lit("-"), "turn").alias("url"),
        F.concat(F.lit('<html><body><div class="notion-page-content">'), body, F.lit("</div></body></html>")).alias("html"),
    )


def blank_line_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which some lines are blanked: ``doc_id, md``."""
    docs = table(spark, sf_dir, "documents")

    def line(x: Column, i: Column) -> Column:
        blank = ((F.col("doc_id") + F.floor(i / 4)) % 3 == 0) | (i % 5 == 4)
        return F.when(blank, "").otherwise(x)

    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("md"))


def asset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with images, a background, a file link and an embedded image in the article."""
    i = F.col("page_id")
    extra = F.concat(
        F.lit('<img src="/img/'), (i % 7).cast("string"), F.lit('.png">'),
        F.lit('<img data-src="/img/'), (i % 7).cast("string"), F.lit('.png">'),
        F.lit('<img srcset="/img/a.png 1x, /img/b.png 2x">'),
        F.lit("<div style=\"background-image:url('/bg/"), (i % 5).cast("string"), F.lit(".jpg')\"></div>"),
        F.lit('<a href="/files/'), (i % 3).cast("string"), F.lit('.pdf">file</a>'),
        F.lit('<img src="data:image/png;base64,aGk=">'),
        F.lit('<img class="notion-emoji" alt="😊 smile" src="/e.png">'),
    )
    return pages(spark, sf_dir).withColumn("html", in_article(F.col("html"), extra))


def _link_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, pos, word`` of the links stored pages hold."""
    words = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))
    return pages(spark, sf_dir).select("page_id", F.posexplode(words).alias("pos", "word"))


def repeated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, pass, pos, name``: a picture for each link, twice, and between them some with a natural number."""
    number = F.explode(F.array(*[F.lit(n) for n in (1, 2, 3)])).alias("pass")
    found = _link_words(spark, sf_dir).select("page_id", number, "pos", "word").where((F.col("pass") != 2) | (F.col("pos") % 2 == 0))
    return found.select("page_id", "pass", "pos", F.concat("word", F.when(F.col("pass") == 2, "-1.png").otherwise(".png")).alias("name"))


def odd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, name``: three files for each link, two of which have one safe name."""
    endings = F.explode(F.array(*[F.lit(e) for e in (" x.png", "(x.png", ".txt")]))
    return _link_words(spark, sf_dir).select("page_id", "word", endings.alias("ending")).select("page_id", F.concat("word", "ending").alias("name")).distinct()


def file_texts(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """``page_id, md``: every file of a page by its path and bare, in name order."""
    entry = F.concat(F.lit(f"![x]({folder}/"), "name", F.lit(") ("), "name", F.lit(" "), "name")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", entry.alias("entry")))), lambda e: e.getField("entry")), "\n")
    return odd_files(spark, sf_dir).groupBy("page_id").agg(whole.alias("md"))


def doc_url(number: Column) -> Column:
    return F.concat(F.lit("https://ws.notion.site/Doc-"), F.md5(number.cast("string")))


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that link to each other.

    Every third page links to page 0, so one target is hot; one link of each page goes nowhere, one
    to the page itself, and one repeats.
    """
    i = F.col("page_id")
    targets = [3 * i + 1, F.when(i % 3 == 0, 0).otherwise(F.floor(i / 2)), i, -1 - i, 3 * i + 1]
    anchors = F.concat(
        *[
            F.concat(F.lit('<a href="'), doc_url(t), F.lit(f'">Doc <b>{pos}</b></a>'))
            for pos, t in enumerate(targets)
        ]
    )
    return pages(spark, sf_dir).select("page_id", doc_url(i).alias("url"), in_article(F.col("html"), anchors).alias("html"))


def variant_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that link to numbered variants of themselves and, every second one, to a stored one.

    Page ``2m`` has the address ``…/V-k<m>``, page ``2m + 1`` the address ``…/V-k<m>-7``.
    """
    i = F.col("page_id")
    base = F.concat(F.lit("https://ws.notion.site/V-k"), F.floor(i / 2).cast("string"), F.lit("z"))
    url = F.when(i % 2 == 1, F.concat(base, F.lit("-7"))).otherwise(base)
    anchors = F.concat(
        *[F.concat(F.lit('<a href="'), base, F.lit(f'{tail}">v</a>')) for tail in ("", "-7", "-8", "-7")],
        F.lit('<a href="https://other.example.com/x">o</a>'),
    )
    return pages(spark, sf_dir).select("page_id", url.alias("url"), in_article(F.col("html"), anchors).alias("html"))


def corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an image, a file, a link to another page and, on every even one, a numbered variant of the page.

    Page ``2m`` has the address of document ``m``, page ``2m + 1`` that of its variant 7654321.
    The number is the variant's key, and no document's address ends with it. Every third page links to document 0.
    """
    i = F.col("page_id")
    own = doc_url(F.floor(i / 2))
    target = F.when(i % 3 == 0, 0).otherwise(F.floor(i / 4))
    extra = F.concat(
        F.lit('<p><img src="/img/'), (i % 7).cast("string"), F.lit('.png"><img src="/other/'), (i % 7).cast("string"),
        F.lit('.png"> <a href="https://files.example.org/'), (i % 3).cast("string"), F.lit('.pdf">file</a> <a href="'), doc_url(target),
        F.lit('">doc</a> <a href="'), own, F.lit('-7654321">v</a></p>'),
    )
    url = F.when(i % 2 == 1, F.concat(own, F.lit("-7654321"))).otherwise(own)
    return pages(spark, sf_dir).select("page_id", url.alias("url"), in_article(F.col("html"), extra).alias("html"))


def loading_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which three in four carry one trace of content that had not loaded."""
    i = F.col("page_id")
    extra = (
        F.when(i % 4 == 0, '<div class="x nds-shimmer-text"></div>')
        .when(i % 4 == 1, '<div aria-busy="true"></div>')
        .when(i % 4 == 2, "<p>Carregando agora</p>")
        .otherwise("")
    )
    return pages(spark, sf_dir).withColumn("html", in_article(F.col("html"), extra))


def pending_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with ``page_id % 4`` unknown and ``page_id % 3`` shimmering blocks."""
    i = F.col("page_id").cast("int")
    extra = F.concat(
        F.repeat(F.lit('<div class="notion-unknown-block"></div>'), i % 4),
        F.repeat(F.lit('<div class="a nds-shimmer-text"></div>'), i % 3),
    )
    return pages(spark, sf_dir).withColumn("html", in_article(F.col("html"), extra))


def code_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with one spanned code block whose text depends on the page."""
    i = F.col("page_id").cast("string")
    extra = F.concat(
        F.lit('<div class="line-numbers notion-code-block language-py" data-x="1"><span>var'), i,
        F.lit("</span><span>=</span><span>f(&amp;lt;"), i, F.lit(")</span><br><span>Carregando</span><span>end</span></div>"),
    )
    return pages(spark, sf_dir).withColumn("html", in_article(F.col("html"), extra))


CODE_CLASS = 'class="line-numbers notion-code-block"'


def nested_code_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code elements around others: the outer one with a ``pre``, without one, a ``pre`` itself, or never closed."""
    i = F.col("page_id").cast("string")
    inner = F.concat(F.lit(f"<div {CODE_CLASS}><span>in"), i, F.lit("</span><span>=</span>1</div>"))
    extra = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(f"<div {CODE_CLASS}><pre>p</pre>"), inner, F.lit("<i>"), inner, F.lit("</i></div>")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit(f"<div {CODE_CLASS}>out;"), inner, F.lit("</div>")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit(f"<pre {CODE_CLASS}><span>root"), i, F.lit("</span></pre>")))
        .otherwise(F.concat(F.lit(f"<section><div {CODE_CLASS}>open"), i, F.lit("</section><code>c</code>")))
    )
    return pages(spark, sf_dir).withColumn("html", in_article(F.col("html"), extra))


def many_span_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose code is only known by its many spans; every third one holds a marked element as well."""
    i = F.col("page_id")
    spans = F.concat(
        F.lit('<section class="lang-sql"><span>select</span><span> n'), i.cast("string"), F.lit("</span><br><span>=</span><span> 1</span></section>")
    )
    marked = F.when(i % 3 == 0, F.lit(f"<div {CODE_CLASS}>marked</div>")).otherwise("")
    return pages(spark, sf_dir).withColumn("html", in_article(F.col("html"), F.concat(spans, marked)))


def title_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose title sits in the title, in h1, in h2 or nowhere, by ``page_id % 4``."""
    case = F.col("page_id") % 4
    no_title = F.regexp_replace("html", "(?s)<title>.*?</title>", "")
    second = F.replace(F.replace(no_title, F.lit("h1>"), F.lit("h2>")), F.lit("<h2>"), F.lit("<h2> "))
    none = F.replace(no_title, F.lit("h1>"), F.lit("p>"))
    html = F.when(case == 0, F.col("html")).when(case == 1, no_title).when(case == 2, second).otherwise(none)
    return pages(spark, sf_dir).withColumn("html", html)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("page_id"), "event_id", "ts",
        (F.col("event_type") != "error").alias("clean"),
        F.floor(F.col("value") / 20).cast("bigint").alias("height"),
        F.col("props").alias("html"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All observations of each page, numbered; what an operator leaves out it cuts itself."""
    return number_attempts(events(spark, sf_dir), ["ts", "event_id"])


def commented_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a comment that names a script, an old heading in a comment and one in a script, and a script cut off
    at the end of the page."""
    first = '<!-- <script> --><!-- <title>old</title> --><style-guide>s</style-guide><script>var t = "<title>js</title>"</script>'
    last = '<p>end</p><script>var leak = "<p>leak</p>";'
    return pages(spark, sf_dir).withColumn("html", F.concat(F.lit(first), F.col("html"), F.lit(last)))


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page with a table for each order, a row for each of its lines.

    The first column is one cell that spans all rows. By ``l_orderkey % 3`` the page has a head of ``th`` with a cell over
    two columns, a head section, or no head and no close tags of cells and rows; the last column holds a nested table
    in every fifth page.
    """
    lines = table(spark, sf_dir, "lineitem")
    key, case = F.col("l_orderkey"), F.col("l_orderkey") % 3
    head = F.when(case == 0, '<tr><th colspan="2">line</th><th>part</th></tr>').when(
        case == 1, "<thead><tr><td>order</td><td>line</td><td>part</td></tr></thead>").otherwise("")
    end = F.when(case == 2, "").otherwise("</td>")
    part = F.col("l_partkey").cast("string")
    inner = F.when(key % 5 == 0, F.concat(F.lit("<table><tr><td>p</td><td>"), part, F.lit("</td></tr></table>"))).otherwise(part)
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    of_order = lines.select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", number.alias("i"),
                            F.count("*").over(Window.partitionBy("l_orderkey")).alias("n"))
    row = F.concat(
        F.lit("<tr>"),
        F.when(F.col("i") == 1, F.concat(F.lit('<td rowspan="'), F.col("n").cast("string"), F.lit('">'), key.cast("string"), end)).otherwise(""),
        F.lit("<td><b>"), F.col("l_linenumber").cast("string"), F.lit("</b> | "), "l_returnflag", end,
        F.lit("<td>"), inner, end, F.when(case == 2, "").otherwise("</tr>"))
    rows = of_order.withColumn("row", row).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", "row"))).alias("rows"))
    html = F.concat(F.lit("<html><body><main><p>before</p><table>"), head,
                    F.array_join(F.transform("rows", lambda r: r.getField("row")), ""), F.lit("</table><p>after</p></main></body></html>"))
    return rows.select(key.alias("page_id"), F.concat(F.lit("https://ws.notion.site/O-"), key.cast("string")).alias("url"), html.alias("html"))


def role_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that end with a link whose quoted title holds angle brackets, a linked card and a block with an inline leaf.

    On pages with an even ``page_id`` the content root is a ``span``.
    """
    i = F.col("page_id").cast("string")
    extra = F.concat(
        F.lit('<p><a title="a > b <p>c" href="/q/'), i, F.lit('">q '), i, F.lit('</a></p><a href="/c/'), i, F.lit('"><p>card '), i,
        F.lit('</p></a><div class="notion-text-block"><span data-content-editable-leaf="true">leaf <span>'), i, F.lit("</span></span>outside</div>"))
    html = in_article(F.col("html"), extra)
    span = F.replace(F.replace(html, F.lit("<article>"), F.lit('<span class="x notion-collection-view-y">')), F.lit("</article>"), F.lit("</span>"))
    return pages(spark, sf_dir).withColumn("html", F.when(F.col("page_id") % 2 == 0, span).otherwise(html))


def quoted(pages: DataFrame, tag: str) -> DataFrame:
    """The same pages with a quoted angle bracket in every tag of one name."""
    return pages.withColumn("html", F.replace("html", F.lit(f"<{tag} "), F.lit(f'<{tag} title="x > y" alt=\'p<i>q\' ')))
