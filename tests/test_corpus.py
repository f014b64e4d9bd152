"""Links, assets, placeholders, lines and snapshots, hot keys included."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagesheaf.operators import assets, chunks, lines, links, placeholders, skew, snapshots
from pagesheaf.plans import corpus
from pagesheaf.sources import pages as io

PARENT = "https://notion.so/Start-" + "0a" * 16
SUB = "https://notion.so/Part-One-" + "1b" * 16
SUB2 = "https://www.notion.so/Part-Two-" + "2C" * 16
SITE = "https://team.notion.site/Part-Three-" + "3d" * 16


@pytest.mark.parametrize("hrefs,expected", [
    ([SUB], [SUB]), ([SITE], [SITE]), ([PARENT, SUB], [SUB]), ([SUB, SUB + "?p=7"], [SUB]),
    (["https://o.example.org/a", "https://notion.so.example.org/" + "4e" * 16, SUB], [SUB]), (["https://notion.so/no/id"], []),
    ([SUB, SUB2, SITE], [SUB, SUB2, SITE]), ([], []),
])
def test_page_links(page, hrefs, expected):
    html = "".join(f'<a href="{h}">go</a>' for h in hrefs)
    assert [r.url for r in links.page_links(page(html, PARENT)).orderBy("pos").collect()] == expected


def test_link_text_and_relative_links(page):
    html = f'<!-- <a href="{SUB2}">c</a> --><a class=x href="/Rel-1b1b1b1b1b1b1b1b1b1b1b1b1b1b1b1b">My <b>Sub</b></a><a href="{SITE}"> </a>'
    rows = links.page_links(page(html, PARENT)).orderBy("pos").collect()
    assert [(r.url, r.text) for r in rows] == [
        ("https://notion.so/Rel-1b1b1b1b1b1b1b1b1b1b1b1b1b1b1b1b", "MySub"), (SITE, SITE)]


def test_a_target_of_many_links_is_one_document(spark):
    hub = f"https://ws.notion.site/H-{'a' * 32}"
    html = F.when(F.col("id") == 0, "<title>Hub</title>").otherwise(f'<a href="{hub}">x</a>')
    url = F.when(F.col("id") == 0, hub).otherwise(F.concat(F.lit("https://ws.notion.site/P-"), F.md5(F.col("id").cast("string"))))
    pages = spark.range(2000).select(F.col("id").alias("page_id"), url.alias("url"), html.alias("html"))
    parents, members, documents = corpus.pages_with_subdocuments(pages, pages.select("page_id", F.lit("text").alias("md")))
    assert members.count() == 1999 and "child_md" not in members.columns
    assert [(r.child_id, r.folder, r.child_md) for r in documents.collect()] == [(0, "Hub", "text")]


def test_convert_corpus(spark):
    a, b = (f"https://ws.notion.site/A-{c * 32}" for c in "ab")
    pages = spark.createDataFrame([
        (1, a, f'<title>A: one</title><main><img src="/i/x.png"><img src="/j/x.png"><p><a href="{b}">to b</a> <a href="https://o.example.org/d.pdf">d</a></p>'
               f'<p><a href="{a}-2">v</a></p></main>'),
        (2, a + "-2", '<title>V</title><main><p><img src="y.png"></p></main>'),
        (3, b, '<title>B b</title><main><p><img src="/i/x.png">t</p></main>'),
        (4, "https://o.example.org/", ""), (5, "https://o.example.org/5", None)], "page_id bigint, url string, html string")
    got = corpus.convert_corpus(pages, "/out", F.lit("2024-05-06 07:08:09").cast("timestamp"))
    docs = {r.page_id: r for r in got.documents.collect()}
    assert docs[1].out_path == "/out/A one - 20240506-070809/A one.md" and docs[1].n_subpages == 1
    assert docs[1].md == (
        "![](A%20one_assets/x.png)![](A%20one_assets/x-1.png)\n\n[to b](B%20b/B%20b.md) [d](A%20one_assets/d.pdf)\n\n"
        f"[v]({a}-2)\n\n\n---\n\n## Subpage: {a}-2\n\n![](subpage_1/y.png)\n")
    assert docs[2].md == "![](V_assets/y.png)\n" and docs[2].n_subpages == 0
    assert [(docs[i].status, docs[i].md) for i in (3, 4, 5)] == [("ok", "![](B%20b_assets/x.png)t\n"), ("empty", "\n"), ("empty", "\n")]
    assert [(r.parent_id, r.child_id, r.child_path) for r in got.members.collect()] == [(1, 3, "B b/B b.md")]
    assert [(r.child_id, r.child_md) for r in got.children.collect()] == [(3, "![](B%20b_assets/x.png)t\n")]
    assert sorted((r.page_id, r.rel_path) for r in got.assets.collect()) == [
        (1, "A%20one_assets/d.pdf"), (1, "A%20one_assets/x-1.png"), (1, "A%20one_assets/x.png"), (2, "V_assets/y.png"), (3, "B%20b_assets/x.png")]


def test_only_linked_pages_are_rendered(spark, monkeypatch):
    url = [f"https://ws.notion.site/D-{i:032x}" for i in range(40)]
    html = [f'<title>T{i}</title><main><p><img src="/i/x.png">text {i} <a href="{url[i // 20]}">up</a></p></main>' for i in range(40)]
    pages = spark.createDataFrame([(i, url[i], html[i]) for i in range(40)] + [(None, None, html[1])], "page_id bigint, url string, html string")
    rendered = []
    plan = corpus.pages_to_markdown
    monkeypatch.setattr(corpus, "pages_to_markdown", lambda pages, *a, **b: rendered.append(pages.count()) or plan(pages, *a, **b))
    members, documents = corpus.linked_documents(pages)
    children = corpus.corpus_children(pages)
    assert rendered == [2, 2]
    parents, all_members, all_documents = corpus.pages_with_subdocuments(pages, plan(pages))
    whole = corpus.convert_corpus(pages, "/out", F.lit("2024-05-06 07:08:09").cast("timestamp"))
    for few, all_of in ((members, all_members), (members, whole.members), (documents, all_documents), (children, whole.children)):
        assert few.columns == all_of.columns and sorted(few.collect(), key=str) == sorted(all_of.collect(), key=str) != []


def test_variant_links_and_subpages(spark):
    own = "https://ws.notion.site/A-k1"
    html = "".join(f'<a href="{h}">x</a>' for h in (own + "-2", own, own + "-2", "https://o.com/zk1", "https://o.com/k2"))
    pages = spark.createDataFrame(
        [(1, own, html), (2, own + "-2", "b"), (3, own + "-2", "copy")], "page_id bigint, url string, html string")
    found = links.variant_links(pages).where("page_id = 1").orderBy("pos").collect()
    assert [r.href for r in found] == [own + "-2", "https://o.com/zk1"]
    md = pages.select("page_id", F.concat(F.lit("m"), F.col("page_id").cast("string")).alias("md"))
    out = {r.page_id: r.md for r in corpus.pages_with_subpages(pages, md).collect()}
    assert out[1] == f"m1\n\n---\n\n## Subpage: {own}-2\n\nm2" and out[2] == "m2"


def test_hot_key_join_is_whole(spark):
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), "id")
    lookup = facts.select("k").distinct().where("k <> 'k1'").withColumn("v", F.concat(F.lit("v"), "k"))
    expected = sorted(map(tuple, facts.join(lookup, "k", "left").select("k", "id", "v").collect()), key=str)
    spread = skew.skew_safe_join(facts, lookup, "k", ["id"], "left", parts=8)
    assert sorted(map(tuple, spread.select("k", "id", "v").collect()), key=str) == expected
    assert [(r.k, r.slices) for r in skew.hot_keys(facts, "k", 8).collect()] == [("hot", 3)]


def test_join_with_many_hot_keys_and_null_keys(spark):
    facts = spark.range(30_000).select(
        F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), (F.col("id") % 1500).cast("string"))).alias("k"), "id")
    lookup = spark.range(1500).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    hot = skew.hot_keys(facts, "k", 2000)
    assert hot.count() == 1350 and hot.agg(F.sum("slices")).first()[0] <= 4000
    got = skew.skew_safe_join(facts, lookup, "k", ["id"], "left", parts=2000)
    assert got.count() == 30_000 and got.where("k is null and v is null").count() == 3000
    assert got.where("concat('k', v) <> k").count() == 0


def test_subdocuments(spark):
    h = ["%032x" % i for i in range(3)]
    url = [f"https://ws.notion.site/D-{x}" for x in h]
    link = lambda i: f'<a href="{url[i]}">x</a>'
    pages = spark.createDataFrame([
        (0, url[0], "<title>Zero</title>" + link(1) + link(2) + f'<a href="https://ws.notion.site/D-{"f" * 32}">n</a>'),
        (1, url[1], "<title>One / 1</title>" + link(1)), (2, url[2], "<title></title>")], "page_id bigint, url string, html string")
    md = spark.createDataFrame([(0, f"[a]({url[1]}) [b]({url[2]}) {url[1]}"), (1, "one"), (2, "two")], "page_id bigint, md string")
    parents, members, documents = corpus.pages_with_subdocuments(pages, md)
    assert sorted((r.child_id, r.folder, r.child_md) for r in documents.collect()) == [(1, "One 1", "one"), (2, h[2], "two")]
    assert {(r.parent_id, r.child_id, r.child_path, r.child_md) for r in links.subdocument_files(members, documents).collect()} == {
        (0, 1, "One 1/One 1.md", "one"), (0, 2, f"{h[2]}/{h[2]}.md", "two")}
    assert parents.where("page_id = 0").collect()[0].md == f"[a](One%201/One%201.md) [b]({h[2]}/{h[2]}.md) {url[1]}"
    assert corpus.resolved_links(pages)[1].count() == 1


def test_seen_links(spark):
    df = spark.createDataFrame([(1, 0, "a", "p"), (1, 1, "p", "p"), (1, 2, "b", "p"), (1, 3, "a", "p")], "page_id int, pos int, href string, page_url string")
    assert [r.href for r in links.filter_seen(df).orderBy("pos").collect()] == ["a", "b"]


def test_assets(page):
    html = ('<script>"<img src=no>"</script><img src="/a.png"><img src="/a.png"><img src="data:image/png;base64,aGk=">'
            '<img src="data:image/png;base64,aGk="><img src="data:image/png;base64"><div style="background: url(/b.jpg), url(/c.jpg)">'
            '</div><a href="f.pdf">f</a><a href="#x">x</a><a href="mailto:a@b">m</a><a href="https://x.notion.site/y">n</a>')
    source = page(html, "https://e.com/d/p")
    rows = assets.asset_manifest(source).orderBy("pass", "pos").collect()
    assert [(r["pass"], r.name, r.status) for r in rows] == [
        (1, "a.png", "ok"), (1, "a-1.png", "ok"), (1, "embedded.png", "ok"), (1, "embedded-1.png", "ok"), (1, None, "failed"),
        (2, "b.jpg", "ok"), (3, "f.pdf", "ok")]
    out = assets.rewrite_assets(source, assets.asset_manifest(source)).collect()[0].html
    assert '<img src="assets/a-1.png">' in out and "url('assets/b.jpg'), url('assets/b.jpg')" in out
    assert '<a href="assets/f.pdf">' in out and '<a href="#x">' in out


def test_natural_name_meets_numbered_name(spark):
    df = spark.createDataFrame([(1, 1, i, n) for i, n in enumerate(["a.png", "a.png", "a-1.png", "a.png"])], "page_id int, pass int, pos int, name string")
    got = [r.name for r in assets.unique_names(df).orderBy("pos").collect()]
    assert got == ["a.png", "a-1.png", "a-1-1.png", "a-2.png"] and len(set(got)) == 4


def _first_free(wanted, separator):
    """The names one after the other, each taking the first free number."""
    taken = []
    for name in wanted:
        if name is None:
            taken.append(None)
            continue
        dot = name.rfind(".")
        stem, suffix = (name[:dot], name[dot:]) if 0 < dot < len(name) - 1 else (name, "")
        tries = (f"{stem}{separator}{n}{suffix}" for n in range(1, len(wanted) + 1))
        taken.append(name if name not in taken else next(t for t in tries if t not in taken))
    return taken


def test_names_against_one_by_one(spark):
    rng = random.Random(7)
    pool = ["a.png", "a-1.png", "a-2.png", "a-1-1.png", "b", "b-1", ".x", "c.", None, "d.e.f", "a_1.png"]
    pages = {i: [rng.choice(pool[: rng.randint(1, len(pool))]) for _ in range(rng.randint(0, 40))] for i in range(60)}
    rows = [(p, 1 + i * 3 // max(len(ns), 1), i, n) for p, ns in pages.items() for i, n in enumerate(ns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id int, pass int, pos int, name string")
    got = {}
    for r in assets.unique_names(df).orderBy("page_id", "pass", "pos").collect():
        got.setdefault(r.page_id, []).append(r.name)
    assert got == {p: _first_free(ns, "-") for p, ns in pages.items() if ns}
    assert assets.unique_names(df.limit(0)).columns == df.columns and assets.unique_names(df.limit(0)).count() == 0


def test_a_thousand_files_of_one_name(spark):
    df = spark.range(1000).select(F.lit(1).alias("page_id"), F.lit(1).alias("pass"), F.col("id").alias("pos"), F.lit("image.png").alias("name"))
    got = [r.name for r in assets.unique_names(df).orderBy("pos").collect()]
    assert got == ["image.png"] + [f"image-{n}.png" for n in range(1, 1000)]


def test_an_address_saved_once(page):
    html = '<img src="/x/a.png"><img src="/y/a.png"><img src="/x/a.png"><a href="/y/a.png">f</a><img src="data:image/png;base64">'
    rows = assets.asset_manifest(page(html, "https://e.com/d"), dedupe_urls=True).orderBy("pass", "pos").collect()
    assert [(r["pass"], r.name, r.status) for r in rows] == [
        (1, "a.png", "ok"), (1, "a-1.png", "ok"), (1, "a.png", "ok"), (1, None, "failed"), (3, "a-1.png", "ok")]


def test_names_take_one_scan_and_one_exchange(spark):
    source = io.scan_pages(spark, "/root/testdata/sf0.001/pages.parquet")
    for options in ({}, {"dedupe_urls": True}):
        plan = assets.asset_manifest(source, **options)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bExchange\b", plan)) <= 1 and plan.count("FileScan") == 1
        assert "Python" not in plan and "Window" not in plan


def test_renames_apply_in_name_order(spark):
    files = spark.createDataFrame([(1, "b c.png"), (1, "a b c.png"), (1, "ok.png")], "page_id int, name string")
    renames = assets.unique_renames(files)
    md = spark.createDataFrame([(1, "(b c.png) /a b c.png ok.png")], "page_id int, md string")
    assert assets.rewrite_renamed(md, renames).collect()[0].md == "(b_c.png) /a_b_c.png ok.png"


@pytest.mark.parametrize("html,kinds", [
    ('<div class="nds-shimmer-text"></div>', {"class", "attribute"}), ('<div aria-busy="true"></div>', {"attribute"}),
    ("<div>(click to open)</div>", {"regex"}), ('<div class="shimmer">Carregando código...</div>', {"class", "attribute", "regex"}),
    ("<script>loading</script><p>fine</p>", set()), ("", set()),
])
def test_placeholders_in_html(page, html, kinds):
    rows = placeholders.placeholders_html(page(html)).collect()
    assert {r.match_type for r in rows} == kinds
    assert placeholders.placeholder_summary(page(html)).collect()[0].has_placeholders == bool(kinds)


def test_placeholder_context_and_literals(page):
    html = "x" * 100 + "<p>Loading (click to open) loading</p>" + "y" * 100
    rows = placeholders.placeholders_html(page(html), use_regex=False).orderBy("pos").collect()
    assert [r.selector_or_snippet for r in rows] == ["Loading", "(click to open)"]
    assert rows[0].context == "x" * 59 + " Loading (click to open) loading " + "y" * 35
    short = placeholders.placeholders_html(page("é<p>Loading</p>")).collect()[0]
    assert short.context == "é Loading"
    attrs = placeholders.placeholders_html(page('<img loading="lazy">'), exclude_attrs=["loading"])
    assert attrs.count() == 0


def test_pending_order(page):
    from pagesheaf.operators.tokens import html_tokens

    html = '<div class="notion-unknown-block"></div>' * 2 + '<div class="nds-shimmer-text"></div>' * 2
    pending = placeholders.pending_blocks(html_tokens(page(html)))
    top = placeholders.first_n_pending(pending, 3).orderBy("nth").collect()
    assert [r.pending for r in top] == ["shimmer", "shimmer", "unknown"]


@pytest.mark.parametrize("n,left", [(1, 1), (2, 2), (3, 2), (7, 2)])
def test_blank_runs(value, n, left):
    run = lines.collapse_blank_runs(F.col("x"))
    assert value(run, x="a\n" + "\n" * n + "b") == "a\n" + "\n" * left + "b\n"
    assert value(run, x="\n" * n + "b") == "\n" * left + "b\n"
    assert value(run, x="b" + "\n" * n) == "b" + "\n" * left
    assert value(run, x="\n" * (n - 1)) == "\n" * max(left - 1, 1)
    twice = lines.collapse_blank_runs(run)
    assert value(twice, x="a\n" + "\n" * n + "b") == "a\n" + "\n" * left + "b\n"


def test_normalize(value):
    raw = "T &amp; x  \r\n\r\nCarregando código\rdownloading\n\n\n\nend"
    assert value(lines.normalize_text(F.col("x")), x=raw) == "T & x\n\n\nend\n"


def test_text_files(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("é".encode())
    (tmp_path / "b.md").write_bytes(b"\x80x")
    rows = {r.path[-4:]: r for r in io.scan_text_files(spark, f"{tmp_path}/*.md").collect()}
    assert (rows["a.md"].status, rows["a.md"].text, rows["a.md"].n_bytes) == ("ok", "é", 2)
    assert (rows["b.md"].status, rows["b.md"].text) == ("utf8_error", None)
    good, bad = io.quarantine(io.scan_text_files(spark, f"{tmp_path}/*.md"))
    assert good.count() == bad.count() == 1


def test_many_text_files_are_few_tasks(spark, tmp_path, monkeypatch):
    for i in range(60):
        (tmp_path / f"{i}.md").write_text(str(i))
    monkeypatch.setattr(io, "SCAN_TASKS", 1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        read = io.scan_text_files(spark, str(tmp_path), "*.md").select("text", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(int(r.text) for r in read) == list(range(60))
    assert len({r.task for r in read}) <= spark.sparkContext.defaultParallelism


def snaps(spark, rows):
    return spark.createDataFrame(rows, "page_id int, attempt int, clean boolean, height bigint, html string")


def test_stable_round(spark):
    rows = [(1, i, True, h, "") for i, h in enumerate([5, 7, 7, None, 7, 9])] + [(2, i, True, i, "") for i in range(1, 6)]
    got = {r.page_id: (r.stop_attempt, r.is_stable) for r in snapshots.stable_round(snaps(spark, rows), ["height"], k=2, cap=4 + 1).collect()}
    assert got == {1: (4, True), 2: (4, False)}


def test_pick_attempt(spark):
    rows = [(1, 0, False, 0, "Carregando"), (1, 1, True, 0, "final"), (1, 2, True, 0, "x"), (2, 0, False, 0, "a"), (2, 1, False, 0, "b"), (2, 3, True, 0, "late")]
    got = {r.page_id: (r.attempt, r.html, r.is_clean) for r in snapshots.pick_attempt(snaps(spark, rows)).collect()}
    assert got == {1: (1, "final", True), 2: (1, "b", False)}


def test_dedup_chunks(spark):
    rows = [(1, 0, 0, "a", "Loading"), (1, 1, 0, "a", "done"), (1, 2, 0, "a", "later"), (1, 0, 1, None, "x"), (1, 1, 5, None, "x"), (1, 0, 2, "e", "")]
    df = spark.createDataFrame(rows, "page_id bigint, snap int, pos int, block_id string, html string")

    def kept(keep):
        return [r.html for r in chunks.dedup_chunks(df, keep).orderBy("first_snap", "first_pos").collect()]

    assert (kept("first"), kept("last"), kept("first_clean")) == (["Loading", "x"], ["later", "x"], ["done", "x"])
    once = chunks.dedup_chunks(df).select(df.columns)
    assert chunks.dedup_chunks(once).count() == once.count()
    assert chunks.concat_chunks(chunks.dedup_chunks(df)).collect()[0].html == '<div class="notion-export">\nLoading\nx\n</div>'


def test_rank_filters_run_before_the_exchange(spark):
    df = spark.range(10).select((F.col("id") % 2).alias("page_id"), F.col("id").alias("ts"))
    plan = snapshots.number_attempts(df, ["ts"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_shared_folders(spark, monkeypatch):
    import os

    from pagesheaf import session

    monkeypatch.setattr(session, "_MADE", [])
    kept = session.staged(spark.range(3).toDF("n"), "mine")
    path = session._MADE[0]
    assert kept.count() == 3 and os.path.isdir(path)
    assert session.remove_shared_folders(spark) == 1 and not os.path.exists(path)

    class Cluster:
        conf = {}

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError):
        session.shared_folder(Cluster, "x")
    Cluster.conf = {"spark.checkpoint.dir": "file:/shared/"}
    assert session.shared_folder(Cluster, "x").startswith("file:/shared/x-")


def test_emoji_image_with_a_background_is_no_asset(page):
    html = '<img class="notion-emoji" alt="x" src="/e.png" style="background:url(/b.png)"><img src="/i.png">'
    assert [r.src for r in assets.asset_refs(page(html)).collect()] == ["/i.png"]


def test_files_of_any_path(spark, tmp_path):
    rows = [(1, "a/b/c.md", "é"), (2, "a/b/c.md", "later"), (3, "/abs.md", "x"), (4, "../up.md", "x"), (5, None, "x"), (6, "n.md", None),
            (7, "x" * 300 + ".md", "long"), (8, "", "x"), (9, "e.md", ""), (10, "a/b", "a folder"), (11, "a/./d.md", "x"), (12, "t/", "x")]
    df = spark.createDataFrame(rows, "id int, p string, md string").coalesce(1)
    done = io.write_text_files(df, str(tmp_path / "out"), F.col("p"), F.col("md"), F.col("id"))
    status = sorted((r.path or "", r.status) for r in done.collect())
    assert status == sorted([
        ("a/b/c.md", "ok"), ("a/b/c.md", "repeated"), ("/abs.md", "outside"), ("../up.md", "outside"), ("", "missing"), ("n.md", "missing"),
        ("x" * 300 + ".md", "failed"), ("", "missing"), ("e.md", "ok"), ("a/b", "failed"), ("a/./d.md", "outside"), ("t/", "outside")])
    files = {str(f.relative_to(tmp_path / "out")): f.read_text() for f in (tmp_path / "out").rglob("*") if f.is_file()}
    assert files == {"a/b/c.md": "é", "e.md": ""}
    assert io.quarantine(done)[0].count() == 2 and io.quarantine(done)[1].where("error is not null").count() == 2
    again = io.write_text_files(df.limit(1).withColumn("md", F.lit("new")), f"file:{tmp_path}/out", F.col("p"), F.col("md"), F.col("id"))
    assert again.count() == 1 and (tmp_path / "out/a/b/c.md").read_text() == "new"
    assert io.write_text_files(df.limit(0), str(tmp_path / "none"), F.col("p"), F.col("md"), F.col("id")).count() == 0
