"""Independent SQL for the registered queries, runnable by DuckDB on the same tables.

Each statement computes the expected result from the rule behind the data, not by repeating the
DataFrame code.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    ORACLES[name] = text


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# --- shared fragments -----------------------------------------------------------------------

BARE = (
    r"regexp_replace(html, '<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"|<noscript\b[^>]*>.*?</noscript\s*>|<(?:link|meta)\b[^>]*>', '', 'gis')"
)
NO_SCRIPT = r"regexp_replace(html, '<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'gis')"


def unescape(x: str) -> str:
    # The pages hold these four references only; cut titles may lack the semicolon.
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return x


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{00a0}}]+', ' ', 'g'))"


TOKENS = rf"""
toklists AS (SELECT page_id, regexp_extract_all({BARE}, '(?s)<!--.*?-->|<[^>]+>|[^<]+') AS l FROM pages),
toks AS (SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM toklists),
kinds AS (SELECT *, CASE WHEN raw LIKE '</%' THEN 'close' WHEN regexp_matches(raw, '^<[A-Za-z]') THEN 'open'
    WHEN raw LIKE '<!%' THEN 'comment' ELSE 'text' END AS kind,
    lower(regexp_extract(raw, '^</?([A-Za-z][^\s/>]*)', 1)) AS name FROM toks)"""

# Content pieces of the bundled pages: a block tag, then text and inline tags up to the next one.
PIECES = rf"""
cuts AS (SELECT page_id, regexp_extract_all(regexp_replace({BARE}, '<!.*?>', '', 'g'),
    '(?s)</?(?:html|head|title|body|nav|ul|li|div|article|h1|p|footer)(?:\s[^>]*)?>(?:[^<]|</?(?:a|b|br)(?:\s[^>]*)?>)*') AS l FROM pages),
pieces AS (SELECT page_id, unnest(range(len(l))) + 1 AS block_no, unnest(l) AS piece FROM cuts),
arts AS (SELECT *, sum(CASE WHEN piece LIKE '<article>%' THEN 1 WHEN piece LIKE '</article>%' THEN -1 ELSE 0 END)
    OVER (PARTITION BY page_id ORDER BY block_no) AS depth,
    regexp_replace(piece, '^<[^>]*>', '') AS body FROM pieces),
page_blocks AS (SELECT page_id, block_no, CASE WHEN piece LIKE '<h1>%' THEN 'heading' ELSE 'paragraph' END AS kind,
    CASE WHEN body LIKE '<b>%' THEN '**' || {squeeze(unescape("replace(replace(body, '<b>', ''), '<br>', '')"))} || '**'
        ELSE {squeeze(unescape("replace(body, '<br>', '')"))} END AS text
    FROM arts WHERE depth = 1 AND trim(replace(replace(body, '<b>', ''), '<br>', '')) <> '')"""

PAGE_MD = PIECES + r""",
page_md AS (SELECT page_id, string_agg(CASE WHEN kind = 'heading' THEN '# ' ELSE '' END || text, chr(10) || chr(10) ORDER BY block_no)
    || chr(10) AS md FROM page_blocks GROUP BY page_id)"""

TITLES = rf"""titles AS (SELECT page_id, url, {unescape("trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))")} AS title FROM pages)"""


def safe(x: str) -> str:
    return rf"""regexp_replace(regexp_replace(trim({x}), '[\\/*?:"<>|]', '', 'g'), '\s+', ' ', 'g')"""


# Blocks of the conversation pages, one per line that is not blank.
TALK = r"""
raw_lines AS (SELECT conv_id, turn, unnest(range(len(l))) AS line_no, unnest(l) AS line
    FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)),
talk AS (SELECT conv_id * 100000 + turn AS page_id, conv_id, turn, line_no, line, (conv_id + turn + line_no // 2) % 9 AS k,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY line_no) AS j
    FROM raw_lines WHERE trim(line) <> ''),
talk_blocks AS (SELECT page_id, 3 + 4 * (j - 1) + (CASE WHEN k = 8 THEN 1 ELSE 2 END) AS block_no, conv_id, turn, line_no, line, k, j,
    CASE WHEN k <= 2 THEN 'heading' WHEN k = 3 THEN 'paragraph' WHEN k <= 6 THEN 'list_item' WHEN k = 7 THEN 'quote' ELSE 'divider' END AS kind,
    CASE WHEN k <= 2 THEN k + 1 END AS level,
    CASE WHEN k IN (4, 5) THEN false WHEN k = 6 THEN true END AS ordered,
    CASE WHEN k = 8 THEN '' ELSE trim(regexp_replace(line, '\s+', ' ', 'g')) END AS text FROM talk),
talk_marks AS (SELECT *, CASE WHEN kind = 'list_item'
    AND lag(kind) OVER w = 'list_item' AND lag(ordered) OVER w = ordered THEN 0 ELSE 1 END AS fresh
    FROM talk_blocks WINDOW w AS (PARTITION BY page_id ORDER BY block_no)),
talk_runs AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY block_no) AS run_id FROM talk_marks),
talk_items AS (SELECT *, row_number() OVER (PARTITION BY page_id, run_id ORDER BY block_no) AS item_no FROM talk_runs),
classes AS (SELECT ['header','sub_header','sub_sub_header','text','bulleted_list','bulleted_list','numbered_list','quote','divider'] AS c),
talk_html AS (SELECT page_id, line_no, j, 'b' || conv_id || '-' || turn || '-' || line_no AS block_id,
    '<div class="notion-selectable notion-' || c[k + 1] || '-block" data-block-id="b' || conv_id || '-' || turn || '-' || line_no
    || '"><div data-content-editable-leaf="true">' || line || '</div></div>' AS html FROM talk, classes)"""

BLANKED = r"""
blanked AS (SELECT doc_id, i AS line_no, CASE WHEN (doc_id + i // 4) % 3 = 0 OR i % 5 = 4 THEN '' ELSE line END AS line
    FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line
          FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def collapsed(source: str) -> str:
    return rf"""
flags AS (SELECT *, trim(line) = '' AS blank FROM {source}),
steps AS (SELECT *, CASE WHEN blank = lag(blank) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 0 ELSE 1 END AS chg FROM flags),
islands AS (SELECT *, sum(chg) OVER (PARTITION BY doc_id ORDER BY line_no) AS isl FROM steps),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, isl ORDER BY line_no) AS rn FROM islands),
joined AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM ranked WHERE NOT blank OR rn <= 2 GROUP BY doc_id),
final AS (SELECT doc_id, CASE WHEN t LIKE '%' || chr(10) THEN t ELSE t || chr(10) END AS md FROM joined)"""


DOC = "'https://ws.notion.site/Doc-' || md5(CAST({} AS VARCHAR))"

LINKED = r"""
five AS (SELECT page_id, pos, CASE pos WHEN 1 THEN CASE WHEN page_id % 3 = 0 THEN 0 ELSE page_id // 2 END WHEN 2 THEN page_id
    WHEN 3 THEN -1 - page_id ELSE 3 * page_id + 1 END AS target FROM pages, range(5) r(pos)),
linked AS (SELECT page_id, target, min(pos) AS pos FROM five WHERE target <> page_id GROUP BY ALL)"""

OBS = r"""
obs AS (SELECT user_id AS page_id, event_id, ts, event_type <> 'error' AS clean, CAST(floor(value / 20) AS BIGINT) AS height, props AS html,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS attempt FROM events)"""


def stable(measure: str, cap: int, k: int, initial: str) -> str:
    return rf"""
seen AS (SELECT page_id, attempt, {measure} AS m FROM obs WHERE attempt < {cap}),
diffs AS (SELECT *, CASE WHEN m = coalesce(lag(m) OVER (PARTITION BY page_id ORDER BY attempt), {initial}) THEN 0 ELSE 1 END AS chg FROM seen),
isl AS (SELECT *, sum(chg) OVER (PARTITION BY page_id ORDER BY attempt) AS g FROM diffs),
run AS (SELECT *, sum(1 - chg) OVER (PARTITION BY page_id, g ORDER BY attempt) AS same FROM isl),
stops AS (SELECT page_id, min(CASE WHEN same >= {k} THEN attempt END) AS stop, max(attempt) AS last FROM run GROUP BY page_id)"""


# --- sources and sinks ----------------------------------------------------------------------

sql("scan_pages", "SELECT page_id, url, html FROM pages")
sql("write_text_files", """SELECT CASE WHEN doc_id % 11 = 0 THEN '../' || name WHEN doc_id % 7 = 0 THEN 'same/name.md' ELSE name END AS path,
    strlen(text) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n_bytes, CASE WHEN doc_id % 11 = 0 THEN 'outside' WHEN doc_id % 7 = 0 AND doc_id > least
    THEN 'repeated' ELSE 'ok' END AS status FROM (SELECT doc_id, text, coalesce(lang, 'none') || '/' || doc_id || '.md' AS name,
    min(doc_id) FILTER (WHERE doc_id % 7 = 0 AND doc_id % 11 > 0) OVER () AS least FROM documents)""")
sql("scan_text_files", """SELECT doc_id, strlen(text) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n_bytes, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text END AS text,
    CASE WHEN doc_id % 5 = 0 THEN 'utf8_error' ELSE 'ok' END AS status FROM documents""")
sql("write_markdown", "SELECT doc_id, text AS md, lang FROM documents")
sql("write_side_html", "SELECT page_id, html FROM pages")
sql("quarantine", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'bad' ELSE 'good' END AS side FROM documents")

# --- projections ----------------------------------------------------------------------------

sql("strip_noncontent", f"SELECT page_id, {BARE} AS html FROM pages")
sql("strip_noncontent_comments", f"""SELECT page_id, '<!-- <script> --><!-- <title>old</title> --><style-guide>s</style-guide>'
    || {BARE} || '<p>end</p>' AS html FROM pages""")
sql("extract_title_comments", with_(TITLES) + "SELECT page_id, title FROM titles")
sql("content_root", with_(TOKENS, """bounds AS (SELECT page_id, min(CASE WHEN raw LIKE '<article%' THEN pos END) AS a,
    min(CASE WHEN raw = '</article>' THEN pos END) AS b FROM toks GROUP BY page_id)""")
    + "SELECT page_id, pos, raw FROM toks JOIN bounds USING (page_id) WHERE pos BETWEEN a AND b")
sql("first_by_priority", with_(TOKENS, """bounds AS (SELECT page_id, min(CASE WHEN raw LIKE '<article%' THEN pos END) AS a,
    min(CASE WHEN raw = '</article>' THEN pos END) AS b FROM toks GROUP BY page_id)""")
    + """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'main' ELSE 'article' END AS root,
    CASE WHEN page_id % 2 = 0 THEN CAST(3 AS BIGINT) ELSE b - a + 1 END AS n_tokens FROM bounds""")
sql("extract_title", rf"""SELECT page_id, CASE WHEN page_id % 4 < 3 THEN {squeeze(unescape("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))}
    ELSE trim(regexp_extract(html, '(?s)<li><a [^>]*>(.*?)</a>', 1)) END AS title FROM pages""")
sql("extract_title_regex", r"""SELECT page_id, CASE WHEN page_id % 4 < 2 THEN trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) END AS title FROM pages""")
sql("strip_tags_text", rf"SELECT page_id, regexp_replace({NO_SCRIPT}, '<[^>]+>', '', 'g') AS text FROM pages")
PATH = r"regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
sql("page_key", f"SELECT page_id, rtrim({PATH}, '/') AS key, md5(CAST(page_id AS VARCHAR)) AS doc_key FROM pages")
sql("page_hex_id", "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN md5(CAST(page_id AS VARCHAR)) ELSE '' END AS hex_id FROM pages")
sql("is_page_host", r"SELECT page_id, regexp_matches(url, '^https?://[^/]*\.example\.(com|net|org)/') AS is_page, true AS is_doc FROM pages")
sql("is_fetchable_href", "SELECT page_id, page_id % 6 = 5 AS fetchable FROM pages")
SRC = """CASE page_id % 5 WHEN 1 THEN 'https://x.com/notion-emojis/1.png' WHEN 2 THEN 'data:image/gif;base64,R0' ELSE '/i.png' END"""
sql("is_emoji_img", "SELECT page_id, page_id % 5 = 0 OR (page_id % 3 = 0 AND page_id % 5 IN (1, 2)) AS is_emoji FROM pages")
sql("emoji_to_text", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '😊' ELSE '' END AS text FROM pages")
sql("image_src", f"SELECT page_id, CASE WHEN page_id % 3 < 2 THEN {SRC} ELSE '/images/a.png' END AS src FROM pages")
sql("attr", f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '😊 smile' ELSE 'emoji' END AS alt,
    CASE WHEN page_id % 3 = 1 THEN {SRC} ELSE '' END AS data_src, '' AS none FROM pages""")
sql("is_placeholder_literal", "SELECT doc_id, contains(lower(text), 'the') OR contains(lower(text), 'xyz') AS hit FROM documents")
sql("is_loading_phrase", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false
    ELSE regexp_matches(lower(trim(text)), '^(carregando|loading)') AND regexp_matches(lower(text), 'plain|codigo|loading code') END AS hit FROM documents""")

# --- structure ------------------------------------------------------------------------------

sql("html_tokens", with_(TOKENS) + rf"""SELECT page_id, pos, kind, CASE WHEN kind IN ('open', 'close') THEN name END AS tag,
    CASE WHEN kind = 'open' THEN trim(regexp_extract(raw, '(?s)^<[A-Za-z][^\s/>]*(.*?)/?>$', 1)) END AS attrs,
    CASE WHEN kind = 'text' THEN {unescape('raw')} WHEN kind = 'comment' THEN raw END AS text FROM kinds""")
sql("token_context", with_(TOKENS) + """SELECT page_id, pos,
    CAST(sum(CASE WHEN name = 'ul' THEN CASE kind WHEN 'open' THEN 1 ELSE -1 END ELSE 0 END) OVER w AS BIGINT) AS in_ul,
    CAST(sum(CASE WHEN name = 'a' THEN CASE kind WHEN 'open' THEN 1 ELSE -1 END ELSE 0 END) OVER w AS BIGINT) AS in_a,
    CAST(sum(CASE WHEN name = 'article' THEN CASE kind WHEN 'open' THEN 1 ELSE -1 END ELSE 0 END) OVER w AS BIGINT) AS in_article
    FROM kinds WINDOW w AS (PARTITION BY page_id ORDER BY pos)""")
sql("element_spans", with_(TOKENS) + """SELECT page_id, name AS tag, pos AS first_pos, next_pos AS last_pos FROM (
    SELECT page_id, name, kind, pos, lead(pos) OVER (PARTITION BY page_id, name ORDER BY pos) AS next_pos FROM kinds
    WHERE name IN ('article', 'nav', 'li')) WHERE kind = 'open'""")
sql("element_ends", with_(TOKENS, """
marks AS (SELECT page_id, name, kind, pos, min(pos) FILTER (WHERE kind = 'close' AND name = 'article') OVER (PARTITION BY page_id) AS art_end,
    lead(kind) OVER (PARTITION BY page_id, name ORDER BY pos) AS next_kind, lead(pos) OVER (PARTITION BY page_id, name ORDER BY pos) AS next_pos
    FROM kinds WHERE name IN ('b', 'p', 'body', 'html', 'article'))""") + """SELECT page_id, name AS tag, pos AS first_pos,
    CASE WHEN next_kind = 'close' THEN next_pos WHEN name IN ('b', 'p') THEN art_end END AS last_pos
    FROM marks WHERE kind = 'open' AND name <> 'article'""")
sql("page_blocks", with_(TALK) + "SELECT page_id, block_no, kind, level, ordered, text FROM talk_blocks")
sql("page_blocks_html", with_(PIECES) + "SELECT page_id, block_no, kind, CASE WHEN kind = 'heading' THEN CAST(1 AS BIGINT) END AS level, text FROM page_blocks")
sql("leaf_text", with_(TALK) + "SELECT page_id, block_no, text FROM talk_blocks")
sql("group_list_runs", with_(TALK) + "SELECT page_id, block_no, CAST(run_id AS BIGINT) AS run_id, item_no FROM talk_items WHERE kind = 'list_item'")
sql("block_stats", with_(TALK) + "SELECT page_id, kind, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM talk_blocks GROUP BY page_id, kind")
sql("render_markdown", with_(TALK, r"""
bits AS (SELECT page_id, block_no, run_id, CASE kind WHEN 'heading' THEN repeat('#', CAST(level AS INTEGER)) || ' ' || text
    WHEN 'list_item' THEN CASE WHEN ordered THEN item_no || '. ' ELSE '* ' END || text WHEN 'quote' THEN '> ' || text
    WHEN 'divider' THEN '---' ELSE text END AS bit FROM talk_items),
runs AS (SELECT page_id, run_id, string_agg(bit, chr(10) ORDER BY block_no) AS bit FROM bits GROUP BY page_id, run_id)""")
    + "SELECT page_id, string_agg(bit, chr(10) || chr(10) ORDER BY run_id) || chr(10) AS md FROM runs GROUP BY page_id")
sql("pages_to_markdown", with_(PAGE_MD) + "SELECT page_id, md FROM page_md")
sql("markdown_documents", with_(PAGE_MD, TITLES) + f"""SELECT page_id, title,
    '/out/' || substr({safe('title')}, 1, 160) || ' - 20240506-070809/' || substr({safe('title')}, 1, 160) || '.md' AS out_path,
    md, sha256(md) AS sha256, CAST(strlen(md) AS BIGINT) AS n_bytes, 'ok' AS status FROM page_md JOIN titles USING (page_id)""")
sql("selectable_chunks", with_(TALK) + "SELECT page_id, block_id, html FROM talk_html")
sql("code_blocks", "SELECT page_id, 'py' AS lang, 'var' || page_id || ' = f(<' || page_id || ')' || chr(10) || 'end' AS text FROM pages")
sql("code_blocks_nested", """SELECT page_id, NULL AS lang, CASE page_id % 4 WHEN 1 THEN 'out;in' || page_id || ' = 1'
    WHEN 2 THEN 'root' || page_id WHEN 3 THEN 'open' || page_id ELSE 'in' || page_id || ' = 1' END AS text
    FROM pages, range(2) r(nth) WHERE nth = 0 OR page_id % 4 = 0""")
sql("code_blocks_by_spans", """SELECT page_id, CASE WHEN page_id % 3 > 0 THEN 'sql' END AS lang,
    CASE WHEN page_id % 3 = 0 THEN 'marked' ELSE 'select n' || page_id || ' = 1' END AS text FROM pages""")
sql("code_blocks_regex", "SELECT page_id, 'py' AS lang, 'var' || page_id || ' = f(&lt;' || page_id || ')' || chr(10) || 'end' AS text FROM pages")
sql("code_lang", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'js' WHEN 1 THEN 'Go' WHEN 2 THEN 'sql' END AS lang FROM pages")
sql("code_text", r"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 2 = 0 THEN
    regexp_replace('x =' || url, '\s*=\s*', ' = ', 'g') || ' < code> ' ELSE 'x =' || url || ' < code> ' END AS text FROM pages""")

# --- links ----------------------------------------------------------------------------------

sql("page_links", with_(LINKED) + f"""SELECT page_id, {DOC.format('target')} AS href, {DOC.format('target')} AS url, 'Doc' || pos AS text,
    md5(CAST(target AS VARCHAR)) AS target_id FROM linked""")
VARIANTS = r"""variants AS (SELECT page_id, pos, 'https://ws.notion.site/V-k' || (page_id // 2) || 'z-' || (pos + 6) AS href
    FROM pages, range(1, 3) r(pos) WHERE page_id % 2 = 0)"""
sql("variant_links", with_(VARIANTS) + "SELECT page_id, pos, href FROM variants")
sql("subpage_index", with_(VARIANTS) + "SELECT page_id, href, 'subpage_' || pos AS folder FROM variants")
sql("link_counts", with_(LINKED) + "SELECT page_id, count(*) AS n_links FROM linked GROUP BY page_id")
sql("unresolved_links", with_(LINKED) + "SELECT page_id, md5(CAST(target AS VARCHAR)) AS target_id FROM linked WHERE target NOT IN (SELECT page_id FROM pages)")
SAFE_TITLES = TITLES + f""",
folders AS (SELECT page_id, substr({safe('title')}, 1, 160) AS f FROM titles)"""
sql("subdocuments", with_(PAGE_MD, SAFE_TITLES, LINKED) + """SELECT l.page_id AS parent_id, target AS child_id, f || '/' || f || '.md' AS child_path, md AS child_md
    FROM linked l JOIN folders f ON f.page_id = target JOIN page_md m ON m.page_id = target""")
sql("linked_documents", with_(PAGE_MD, SAFE_TITLES, LINKED) + """SELECT m.page_id AS child_id, f AS folder, md AS child_md
    FROM page_md m JOIN folders USING (page_id) WHERE page_id IN (SELECT target FROM linked)""")
sql("append_subpages", """SELECT p.page_id, 'page ' || p.page_id || chr(10) || CASE WHEN c.page_id IS NULL THEN '' ELSE
    chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Subpage: https://ws.notion.site/V-k' || (p.page_id // 2) || 'z-7' || chr(10) || chr(10)
    || 'page ' || c.page_id || chr(10) END AS md, CAST(CASE WHEN c.page_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_subpages
    FROM pages p LEFT JOIN pages c ON p.page_id % 2 = 0 AND c.page_id = p.page_id + 1""")
sql("rewrite_links", with_(SAFE_TITLES) + f"""SELECT p.page_id, '[a](' || {DOC.format('p.page_id')} || ') [b](' ||
    CASE WHEN p.page_id % 3 = 0 THEN {DOC.format('p.page_id // 2')} ELSE replace(url_encode(f || '/' || f || '.md'), '%2F', '/') END
    || ') [c](' || {DOC.format('-1 - p.page_id')} || ')' || chr(10) AS md
    FROM pages p JOIN folders f ON f.page_id = p.page_id // 2""")
sql("filter_seen", """SELECT user_id AS page_id, min(event_id) AS pos, props AS href FROM events WHERE props <> '{"k": 1}' GROUP BY user_id, props""")

# --- assets ---------------------------------------------------------------------------------

ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
REFS = f"""
refs AS (SELECT page_id, 1 AS pass, '/img/' || page_id % 7 || '.png' AS src, {ORIGIN} AS o, page_id % 7 || '.png' AS name FROM pages
    UNION ALL SELECT page_id, 1, '/img/' || page_id % 7 || '.png', {ORIGIN}, page_id % 7 || '-1.png' FROM pages
    UNION ALL SELECT page_id, 1, '/img/a.png', {ORIGIN}, 'a.png' FROM pages
    UNION ALL SELECT page_id, 1, 'data:image/png;base64,aGk=', '', 'embedded.png' FROM pages
    UNION ALL SELECT page_id, 2, '/bg/' || page_id % 5 || '.jpg', {ORIGIN}, page_id % 5 || '.jpg' FROM pages)"""
ANCHORS = rf"""SELECT page_id, src, {ORIGIN} || src AS url FROM (
    SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS src FROM pages
    UNION ALL SELECT page_id, url, '/files/' || page_id % 3 || '.pdf' FROM pages)"""
sql("asset_refs", with_(REFS) + f"""SELECT page_id, CAST(pass AS BIGINT) AS pass, src, o || src AS url FROM refs
    UNION ALL SELECT page_id, CAST(3 AS BIGINT), src, url FROM ({ANCHORS})""")
sql("anchor_refs", ANCHORS)
sql("background_refs", with_(REFS) + "SELECT page_id, src, o || src AS url FROM refs WHERE pass = 2")
sql("union_of_asset_passes", """SELECT CAST(1 AS BIGINT) AS pass, 4 * count(*) AS n, count(*) AS n_pages FROM pages
    UNION ALL SELECT 2, count(*), count(*) FROM pages
    UNION ALL SELECT 3, CAST(sum(1 + len(regexp_extract_all(html, '<a href='))) AS BIGINT), count(*) FROM pages""")
ALL_REFS = rf"""RECURSIVE all_refs AS (
    SELECT page_id, 1 AS pass, 0 AS ord, '/img/' || page_id % 7 || '.png' AS src, {ORIGIN} AS o FROM pages
    UNION ALL SELECT page_id, 1, 1, '/img/' || page_id % 7 || '.png', {ORIGIN} FROM pages
    UNION ALL SELECT page_id, 1, 2, '/img/a.png', {ORIGIN} FROM pages
    UNION ALL SELECT page_id, 1, 3, 'data:image/png;base64,aGk=', '' FROM pages
    UNION ALL SELECT page_id, 2, 0, '/bg/' || page_id % 5 || '.jpg', {ORIGIN} FROM pages
    UNION ALL SELECT page_id, 3, unnest(range(len(l))), unnest(l), o FROM (SELECT page_id, {ORIGIN} AS o,
        list_append(regexp_extract_all(html, '<a href="([^"]*)"', 1), '/files/' || page_id % 3 || '.pdf') AS l FROM pages)),
plain AS (SELECT page_id, pass, ord, o || src AS url, CASE WHEN src LIKE 'data:%' THEN 'embedded.png'
    ELSE regexp_replace(regexp_extract(rtrim(split_part(src, '?', 1), '/'), '([^/]*)$', 1), '[\\:*"<>|]', '_', 'g') END AS name FROM all_refs)"""


def first_free(rows: str, separator: str) -> str:
    """Names of ``rows`` (``page_id, name`` in order of ``place``), each the first free one after those before it."""
    stem, suffix = "regexp_extract(l[i + 1], '^(.+)(\\.[^.]+)$', 1)", "regexp_extract(l[i + 1], '^(.+)(\\.[^.]+)$', 2)"
    numbered = f"""CASE WHEN n = 0 THEN l[i + 1] WHEN {suffix} = '' THEN l[i + 1] || '{separator}' || n ELSE {stem} || '{separator}' || n || {suffix} END"""
    return f"""
walk AS (SELECT page_id, list(name ORDER BY place) AS l, 0 AS i, []::VARCHAR[] AS taken FROM {rows} GROUP BY page_id
    UNION ALL SELECT page_id, l, i + 1, list_append(taken, list_filter(list_transform(range(0, i + 1), lambda n: {numbered}),
        lambda c: NOT list_contains(taken, c))[1]) FROM walk WHERE i < len(l)),
named AS (SELECT page_id, unnest(range(len(l))) + 1 AS place, unnest(l) AS wanted, unnest(taken) AS name FROM walk WHERE i = len(l))"""


PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pass, ord) AS place FROM plain)"
NAMED = with_(ALL_REFS, PLACED, first_free("placed", "-"))
QUOTED = "replace(url_encode({}), '%2F', '/')"
sql("asset_manifest_by_url", with_(ALL_REFS, "firsts AS (SELECT page_id, url, name, row_number() OVER (PARTITION BY page_id ORDER BY pass, ord) AS place FROM"
    " (SELECT * FROM plain QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pass, ord) = 1))", first_free("firsts", "-"))
    + """SELECT p.page_id, CAST(p.pass AS BIGINT) AS pass, p.url, n.name, 'ok' AS status FROM plain p JOIN firsts f USING (page_id, url)
    JOIN named n ON n.page_id = f.page_id AND n.place = f.place""")
sql("asset_manifest", NAMED + f"""SELECT p.page_id, CAST(pass AS BIGINT) AS pass, url, n.name, 'assets/' || {QUOTED.format('n.name')} AS rel_path, 'ok' AS status
    FROM placed p JOIN named n ON n.page_id = p.page_id AND n.place = p.place""")
WORDS = """words AS (SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS word FROM
    (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS l FROM pages))"""
sql("unique_names", with_("RECURSIVE " + WORDS, """placed AS (SELECT page_id, pass, pos, word || CASE pass WHEN 2 THEN '-1.png' ELSE '.png' END AS name,
    row_number() OVER (PARTITION BY page_id ORDER BY pass, pos) AS place FROM words, (VALUES (1), (2), (3)) v(pass) WHERE pass <> 2 OR pos % 2 = 0)""",
    first_free("placed", "-")) + "SELECT page_id, CAST(pass AS BIGINT) AS pass, pos, n.name FROM placed JOIN named n USING (page_id, place)")
ORACLES["write_asset_manifest"] = ORACLES["asset_manifest"]
sql("asset_counts", r"SELECT page_id, CAST(6 + len(regexp_extract_all(html, '<a href=')) AS BIGINT) AS n_assets FROM pages")
# The page cut at its links, each followed by the rest of the page up to the next one.
sql("rewrite_assets", with_(ALL_REFS, PLACED, first_free("placed", "-"), f"""
paths AS (SELECT page_id, ord, 'assets/' || {QUOTED.format('n.name')} AS path FROM placed p JOIN named n USING (page_id, place) WHERE pass = 3),
cut AS (SELECT page_id, string_split(replace({NO_SCRIPT}, '</article>', '<img src="assets/' || page_id % 7 || '.png"><img data-src="/img/' || page_id % 7
    || '.png" src="assets/' || page_id % 7 || '-1.png"><img srcset="/img/a.png 1x, /img/b.png 2x" src="assets/a.png"><div style="background-image:url(''assets/'
    || page_id % 5 || '.jpg'')"></div><a href="/files/' || page_id % 3 || '.pdf">file</a><img src="assets/embedded.png">😊</article>'), '<a href="') AS l FROM pages),
bits AS (SELECT page_id, unnest(range(len(l))) - 1 AS ord, unnest(l) AS bit FROM cut)""")
    + """SELECT b.page_id, string_agg(CASE WHEN b.ord < 0 THEN bit ELSE '<a href="' || path || substr(bit, strpos(bit, '"')) END, '' ORDER BY b.ord) AS html
    FROM bits b LEFT JOIN paths p ON p.page_id = b.page_id AND p.ord = b.ord GROUP BY b.page_id""")
FILES = """files AS (SELECT DISTINCT page_id, word || ending AS old FROM words, (VALUES (' x.png'), ('(x.png'), ('.txt')) v(ending))"""
RENAMES = with_("RECURSIVE " + WORDS, FILES, r"""
safe AS (SELECT page_id, old, CASE WHEN s = '' THEN 'asset' ELSE s END || suf AS name FROM (SELECT page_id, old, regexp_extract(old, '(\.[^.]+)$', 1) AS suf,
    trim(regexp_replace(regexp_replace(regexp_extract(old, '^(.+)\.[^.]+$', 1), '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g'), '_') AS s FROM files)),
placed AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY name <> old, old) AS place FROM safe)""", first_free("placed", "_"), """
renames AS (SELECT p.page_id, p.old, n.name AS new FROM placed p JOIN named n USING (page_id, place))""")
sql("unique_renames", RENAMES + "SELECT page_id, old AS name, new AS new_name FROM renames")
sql("sort_names", RENAMES + "SELECT page_id, old AS name, row_number() OVER (PARTITION BY page_id ORDER BY old) AS place FROM renames")
# One name after the other, as the texts are rewritten in name order.
sql("rewrite_renamed", RENAMES + """, changes AS (SELECT page_id, list(struct_pack(o := old, n := new) ORDER BY old) FILTER (WHERE old <> new) AS l,
    string_agg('![x](f/' || old || ') (' || old || ' ' || old, chr(10) ORDER BY old) AS md FROM renames GROUP BY page_id),
steps AS (SELECT page_id, l, md, 0 AS i FROM changes UNION ALL SELECT page_id, l, replace(replace(replace(md, '/' || l[i + 1].o, '/' || l[i + 1].n),
    '(' || l[i + 1].o, '(' || l[i + 1].n), l[i + 1].o, l[i + 1].n), i + 1 FROM steps WHERE i < len(l))
SELECT page_id, md FROM steps WHERE i = coalesce(len(l), 0)""")
sql("encode_asset_paths", with_(WORDS, FILES) + f"""SELECT page_id, string_agg('![x](' || {QUOTED.format("'my [f]/' || old")} || ') (' || old || ' ' || old,
    chr(10) ORDER BY old) AS md FROM files GROUP BY page_id""")

# --- placeholders ---------------------------------------------------------------------------

LOADING = r"""
extra AS (SELECT page_id, html, CASE page_id % 4 WHEN 0 THEN '<div class="x nds-shimmer-text"></div>' WHEN 1 THEN '<div aria-busy="true"></div>'
    WHEN 2 THEN '<p>Carregando agora</p>' ELSE '' END AS e FROM pages),
loading AS (SELECT page_id, replace(html, '</article>', e || '</article>') AS html FROM extra),
raw_hits AS (
    SELECT page_id, 1 AS pass, '.nds-shimmer-text' AS s, 'class' AS t, 'class="x nds-shimmer-text"' AS f, html AS x FROM loading WHERE page_id % 4 = 0
    UNION ALL SELECT page_id, 2, f, 'attribute', f, html FROM (SELECT *, 'class="x nds-shimmer-text"' AS f FROM loading WHERE page_id % 4 = 0)
    UNION ALL SELECT page_id, 2, f, 'attribute', f, html FROM (SELECT *, 'aria-busy="true"' AS f FROM loading WHERE page_id % 4 = 1)
    UNION ALL SELECT page_id, 3, 'Carregando', 'regex', 'Carregando', regexp_replace(regexp_replace(html,
        '<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g') FROM loading WHERE page_id % 4 = 2),
hits AS (SELECT *, strpos(x, f) AS p FROM raw_hits)"""
sql("placeholders_html", with_(LOADING) + r"""SELECT page_id, CAST(pass AS BIGINT) AS pass, s AS selector_or_snippet, t AS match_type,
    CASE WHEN pass = 3 THEN trim(c) ELSE c END AS context FROM (
    SELECT *, substr(x, greatest(p - 60, 1), least(p - 1, 60) + length(f) + 60) AS c FROM hits)""")
sql("placeholders_text", r"""SELECT doc_id, a <> '' OR b <> '' AS has, concat_ws('|', nullif(a, ''), nullif(b, '')) AS matches FROM (
    SELECT doc_id, regexp_extract(text, '(?i)(^|[^\pL\pN_])(the)([^\pL\pN_]|$)', 2) AS a, regexp_extract(text, '(?i)ing') AS b FROM documents)""")
sql("placeholders_text_literal", """SELECT doc_id, contains(low, 'the') OR contains(low, 'ing') OR contains(low, 'zzz') AS has,
    concat_ws('|', CASE WHEN contains(low, 'the') THEN 'The' END, CASE WHEN contains(low, 'ing') THEN 'ING' END, CASE WHEN contains(low, 'zzz') THEN 'zzz' END) AS matches
    FROM (SELECT doc_id, lower(text) AS low FROM documents)""")
sql("placeholder_summary", """SELECT page_id, CAST(page_id % 4 = 0 AS BIGINT) AS n_class, CAST(page_id % 4 < 2 AS BIGINT) AS n_attribute,
    CAST(0 AS BIGINT) AS n_text, CAST(page_id % 4 = 2 AS BIGINT) AS n_regex, page_id % 4 < 3 AS has_placeholders FROM pages""")
sql("union_of_placeholder_passes", """SELECT t AS match_type, count(*) AS n, count(*) AS n_pages FROM (
    SELECT 'class' AS t FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT 'attribute' FROM pages WHERE page_id % 4 < 2
    UNION ALL SELECT 'regex' FROM pages WHERE page_id % 4 = 2) GROUP BY t""")
sql("dedup_occurrences", "SELECT user_id AS page_id, min(event_id) AS pos, props AS selector_or_snippet FROM events GROUP BY user_id, props")
sql("dedup_matches_ci", r"""SELECT doc_id, min(pos) AS pos, arg_min(m, pos) AS match FROM (
    SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS m FROM (SELECT doc_id, string_split_regex(text, '[ \n]') AS l FROM documents))
    GROUP BY doc_id, lower(m)""")
# The blocks follow the article's last text; unknown ones stand first, shimmering ones rank first.
sql("first_n_pending", with_(TOKENS, """
ends AS (SELECT page_id, min(pos) AS last FROM (SELECT page_id, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM (SELECT page_id,
    regexp_extract_all(html, '(?s)<!--.*?-->|<[A-Za-z/!?][^>]*>|[^<]+|<') AS l FROM pages)) WHERE raw = '</article>' GROUP BY page_id)""") + """
SELECT page_id, pending, pos, row_number() OVER (PARTITION BY page_id ORDER BY pending, pos) AS nth FROM (
    SELECT page_id, 'unknown' AS pending, last + 2 * i AS pos FROM ends, range(3) r(i) WHERE i < page_id % 4
    UNION ALL SELECT page_id, 'shimmer', last + 2 * (page_id % 4) + 2 * i FROM ends, range(2) r(i) WHERE i < page_id % 3)
    QUALIFY nth <= 3""")
sql("first_n_occurrences", """SELECT user_id AS page_id, props AS selector_or_snippet, event_id AS pos FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) <= 2""")
sql("strip_placeholder_text", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '(?i)ing([^\pL\pN_]|$)', '\1', 'g'),
    '(?i)tion', '', 'g'), '(?i)the', '', 'g') AS text FROM documents""")

# --- lines ----------------------------------------------------------------------------------

sql("md_lines", r"""SELECT doc_id, unnest(range(len(l))) AS line_no, rtrim(unnest(l)) AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
sql("drop_placeholder_lines", with_(BLANKED) + "SELECT doc_id, line_no, rtrim(line) AS line FROM blanked WHERE NOT contains(lower(line), 'tion') AND NOT contains(lower(line), 'der')")
sql("collapse_blank_runs", with_(BLANKED, collapsed("blanked")) + "SELECT doc_id, md FROM final")
NORMAL = with_(BLANKED, "kept AS (SELECT doc_id, line_no, rtrim(line) AS line FROM blanked WHERE NOT contains(lower(trim(line)), 'the '))",
    collapsed("kept"), "originals AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS o FROM blanked GROUP BY doc_id)",
    # A document whose every line is dropped is the empty text.
    "sums AS (SELECT doc_id, sha256(o) AS original_sha256, coalesce(md, chr(10)) AS normalized FROM originals LEFT JOIN final USING (doc_id))")
sql("normalize_summary", NORMAL + """SELECT doc_id, 'success' AS status, original_sha256, sha256(normalized) AS normalized_sha256,
    CAST(strlen(normalized) AS BIGINT) AS bytes_written, normalized FROM sums""")
sql("summary_json", NORMAL + """SELECT doc_id, '{"status":"success","original_sha256":"' || original_sha256 || '","normalized_sha256":"' || sha256(normalized)
    || '","bytes_written":' || strlen(normalized) || ',"encoding":"utf-8"}' AS summary FROM sums""")

# --- names and addresses --------------------------------------------------------------------

sql("sanitize_filename", r"""SELECT doc_id, regexp_replace(regexp_replace('a/b: ' || text || ' ?"<x>|', '[\\/*?:"<>|]', '', 'g'), '[\s\x{00a0}]+', ' ', 'g') AS name FROM documents""")
sql("output_name", with_(TITLES) + rf"""SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'notion_page'
    WHEN page_id % 3 = 0 THEN rtrim({PATH}, '/') ELSE substr({safe('title')}, 1, 160) END || '.md' AS name FROM titles""")
sql("output_folder", """SELECT page_id, '/out/' || CASE WHEN page_id % 3 <> 0 THEN 'A title' ELSE md5(CAST(page_id AS VARCHAR)) END
    || ' - 20240506-070809' AS folder FROM pages""")
sql("output_paths", """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/abs/x.md' WHEN page_id % 2 = 0 THEN '/out/f/' || CASE page_id % 3 WHEN 1 THEN 'y.md' ELSE 'z.md' END
    ELSE CASE page_id % 3 WHEN 1 THEN 'sub/y.md' ELSE 'z.md' END END AS path FROM pages""")
sql("assets_folder", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/abs/a' WHEN 1 THEN 'rel' WHEN 3 THEN 'my.page_assets' END AS folder FROM pages""")
sql("file_name_from_url", r"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'https_'
    ELSE regexp_extract(rtrim(split_part(url, '?', 1), '/'), '([^/]*)$', 1) END AS name FROM pages""")
sql("safe_asset_name", r"""SELECT doc_id, CASE WHEN s = '' THEN 'asset' ELSE s END || suf AS name FROM (
    SELECT doc_id, suf, trim(regexp_replace(regexp_replace(stem, '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g'), '_') AS s FROM (
    SELECT doc_id, CASE WHEN full_name LIKE '_%.%' AND regexp_matches(full_name, '^.+\.[^.]+$') THEN regexp_extract(full_name, '^(.+)(\.[^.]+)$', 1) ELSE full_name END AS stem,
      regexp_extract(full_name, '^(.+)(\.[^.]+)$', 2) AS suf
    FROM (SELECT doc_id, replace(text, chr(10), ' ') || CASE WHEN doc_id % 2 = 0 THEN '.p g' ELSE '' END AS full_name FROM documents)))""")
FOLDER = rf"regexp_replace({PATH}, '[^/]*$', '')"
sql("resolve_url", rf"""SELECT page_id, CASE page_id % 8 WHEN 0 THEN {ORIGIN} || '/abs/x.png' WHEN 1 THEN {ORIGIN} || {FOLDER} || 'rel.png'
    WHEN 2 THEN {ORIGIN} || regexp_replace({FOLDER}, '[^/]+/$', '') || 'up/y.png'
    WHEN 3 THEN split_part(url, ':', 1) || '://cdn.example.com/z' WHEN 4 THEN 'https://o.org/q' WHEN 5 THEN {ORIGIN} || {PATH} || '?a=1'
    WHEN 6 THEN split_part(url, '#', 1) || '#frag' ELSE 'mailto:x@y.z' END AS full_url FROM pages""")
sql("quote_path", "SELECT doc_id, replace(url_encode('a b/~*(c)+/' || text), '%2F', '/') AS quoted FROM documents")
sql("asset_rel_path", "SELECT page_id, 'page%20assets/img%20' || page_id AS rel FROM pages")
sql("data_uri_parts", """SELECT page_id, 'embedded' || CASE WHEN page_id % 7 = 0 THEN '.png' WHEN page_id % 3 = 0 THEN '.png' WHEN page_id % 3 = 1 THEN '.pdf' ELSE '.bin' END AS name,
    CASE WHEN page_id % 7 <> 0 THEN url END AS content FROM pages""")
sql("html_unescape", f"SELECT page_id, {unescape('html')} AS text FROM pages")
sql("chunk_key", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'id:b' || page_id ELSE 'h:' || sha1(html) END AS key FROM pages")

# --- snapshots ------------------------------------------------------------------------------

sql("dedup_chunks", "SELECT user_id AS page_id, min(event_id) AS snap, 'h:' || sha1(props) AS key FROM events GROUP BY user_id, props")
sql("dedup_chunks_last", """SELECT user_id AS page_id, max(event_id) AS snap, min(event_id) AS first_snap, 'h:' || sha1(props) AS key
    FROM events GROUP BY user_id, props""")
sql("concat_chunks", with_(TALK, """
parts AS (SELECT page_id, '<div class="notion-export">' || chr(10) || string_agg(html, chr(10) ORDER BY line_no) || chr(10) || '</div>' AS h,
    string_agg(html, '' ORDER BY line_no) AS body FROM talk_html GROUP BY page_id)""")
    + """SELECT t.conv_id * 100000 + t.turn AS page_id, CASE WHEN p.h IS NOT NULL AND t.turn % 2 = 0 THEN p.h
    ELSE '<html><body><div class="notion-page-content">' || coalesce(body, '') || '</div></body></html>' END AS html
    FROM conversations t LEFT JOIN parts p ON p.page_id = t.conv_id * 100000 + t.turn""")
sql("stable_round", with_(OBS, stable("height", 50, 2, "0")) + "SELECT page_id, coalesce(stop, last) AS stop_attempt, stop IS NOT NULL AS is_stable FROM stops")
sql("stable_pending", with_(OBS, stable("height * 2 + CAST(clean AS BIGINT)", 14, 1, "-1"))
    + "SELECT page_id, coalesce(stop, last) AS stop_attempt, stop IS NOT NULL AS is_stable FROM stops")
PICKED = """picked AS (SELECT page_id, min(CASE WHEN clean THEN attempt END) AS first_clean, max(attempt) AS last FROM obs WHERE attempt <= 2 GROUP BY page_id)"""
sql("pick_attempt", with_(OBS, PICKED) + """SELECT p.page_id, o.attempt, o.html, first_clean IS NOT NULL AS is_clean
    FROM picked p JOIN obs o ON o.page_id = p.page_id AND o.attempt = coalesce(first_clean, last)""")
sql("placeholder_rounds", with_(OBS) + """SELECT page_id, coalesce(min(CASE WHEN height = 0 THEN attempt END), max(attempt) + 1) AS rounds,
    min(CASE WHEN height = 0 THEN attempt END) IS NOT NULL AS is_clear FROM obs WHERE attempt < 10 GROUP BY page_id""")

# --- streams --------------------------------------------------------------------------------

sql("stream_first_chunks", "SELECT DISTINCT user_id AS page_id, 'h:' || sha1(props) AS key FROM events")
sql("stream_pending_counts", """SELECT date_trunc('hour', ts) AS window_start, user_id AS page_id, count(*) AS n_unknown,
    count(*) FILTER (WHERE event_type = 'error') AS n_shimmer, count(*) AS n_snapshots FROM events
    GROUP BY ALL HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events)""")
sql("stream_stable_pages", with_(OBS, stable("height", 10, 2, "0"))
    + "SELECT page_id, coalesce(stop, last) AS stop_attempt, stop IS NOT NULL AS is_stable FROM stops")
sql("stream_complete_pages", with_(OBS, PICKED) + """SELECT p.page_id, o.attempt, o.html, first_clean IS NOT NULL AS is_clean
    FROM picked p JOIN obs o ON o.page_id = p.page_id AND o.attempt = coalesce(first_clean, last)""")

# --- tables and roles -----------------------------------------------------------------------

ORDER_LINES = r"""
order_lines AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i,
    '**' || l_linenumber || '** \| ' || l_returnflag || ' | ' || CASE WHEN l_orderkey % 5 = 0 THEN 'p ' ELSE '' END || l_partkey || ' |' AS cells
    FROM lineitem),
table_lines AS (
    SELECT page_id, 1 AS row_no, CASE WHEN page_id % 3 = 0 THEN '| line |  | part |' ELSE '| order | line | part |' END
        || chr(10) || '| --- | --- | --- |' AS text FROM order_lines WHERE i = 1 AND page_id % 3 <> 2
    UNION ALL
    SELECT page_id, CASE WHEN page_id % 3 = 2 THEN i ELSE i + 1 END,
        CASE WHEN i = 1 AND page_id % 3 = 2 THEN '|  |  |  |' || chr(10) || '| --- | --- | --- |' || chr(10) ELSE '' END
        || '| ' || CASE WHEN i = 1 THEN page_id::VARCHAR ELSE '' END || ' | ' || cells FROM order_lines)"""

sql("table_rows", with_(ORDER_LINES) + "SELECT page_id, row_no::BIGINT AS row_no, text FROM table_lines")
sql("table_markdown", with_(ORDER_LINES) + """SELECT page_id, 'before' || chr(10) || chr(10) || string_agg(text, chr(10) ORDER BY row_no)
    || chr(10) || chr(10) || 'after' || chr(10) AS md FROM table_lines GROUP BY page_id""")
sql("role_markdown", with_(PAGE_MD) + """SELECT page_id, md || chr(10) || '[q ' || page_id || '](/q/' || page_id || ')' || chr(10) || chr(10)
    || '[card ' || page_id || '](/c/' || page_id || ')' || chr(10) || chr(10) || 'leaf ' || page_id || chr(10) AS md FROM page_md""")

# --- a whole corpus -------------------------------------------------------------------------

# Page 2m is document m, page 2m + 1 its variant; ``own_goal``: the link leads to the page's own document and stays as it is.
CONVERTED = with_(PAGE_MD, SAFE_TITLES, rf"""
base AS (SELECT m.page_id, md, title, f, replace(url_encode(f), '%2F', '/') AS q, {DOC.format('m.page_id // 2')} AS own,
    CASE WHEN m.page_id % 3 = 0 THEN 0 ELSE m.page_id // 4 END AS target FROM page_md m JOIN folders USING (page_id) JOIN titles USING (page_id)),
goals AS (SELECT b.*, {DOC.format('b.target')} AS doc, b.target = b.page_id // 2 AS own_goal, g.f AS goal, g.q || '/' || g.q || '.md' AS path
    FROM base b JOIN base g ON g.page_id = 2 * b.target)""")


def last_paragraph(page: str, folder: str, link: str) -> str:
    """The paragraph every page ends with, its assets below ``folder``."""
    picture = f"'![](' || {folder} || '/' || {page}.page_id % 7 ||"
    return f"""chr(10) || {picture} '.png)' || {picture} '-1.png) [file](' || {folder} || '/' || {page}.page_id % 3 || '.pdf) [doc](' || {link}
        || ') [v](' || {page}.own || '-7654321)' || chr(10)"""


CONVERTED_MD = f"""p.md || {last_paragraph('p', "p.q || '_assets'", 'CASE WHEN p.own_goal THEN p.doc ELSE p.path END')} || CASE WHEN c.page_id IS NULL THEN '' ELSE
    chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Subpage: ' || p.own || '-7654321' || chr(10) || chr(10) || c.md
    || {last_paragraph('c', "'subpage_1'", 'CASE WHEN c.target = p.target AND NOT p.own_goal THEN p.path ELSE c.doc END')} END"""
sql("convert_corpus", CONVERTED + f"""SELECT *, CAST(strlen(md) AS BIGINT) AS n_bytes, 'ok' AS status FROM (SELECT p.page_id, p.title,
    '/out/' || p.f || ' - 20240506-070809/' || p.f || '.md' AS out_path, {CONVERTED_MD} AS md, CAST(c.page_id IS NOT NULL AS BIGINT) AS n_subpages
    FROM goals p LEFT JOIN goals c ON p.page_id % 2 = 0 AND c.page_id = p.page_id + 1)""")
sql("convert_corpus_children", CONVERTED + f"""SELECT p.page_id AS child_id, p.f AS folder, p.md || {last_paragraph('p', "p.q || '_assets'", 'p.doc')} AS child_md
    FROM goals p WHERE page_id IN (SELECT 2 * target FROM goals WHERE NOT own_goal)""")
sql("convert_corpus_members", CONVERTED + """SELECT page_id AS parent_id, doc AS url, 2 * target AS child_id, goal || '/' || goal || '.md' AS child_path
    FROM goals WHERE NOT own_goal""")
ORACLES["page_links_quoted"] = ORACLES["page_links"]
ORACLES["asset_refs_quoted"] = ORACLES["asset_refs"]
