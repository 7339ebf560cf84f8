"""Queries over feeds, payloads and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.plans import job_queries as jobs
from tidemark.plans.inputs import table
from tidemark.sources import feeds, pages

HEAD_SQL = "substr(split_part(text, chr(10), 1), 1, 300)"


def _head():
    return F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 300)


def _escaped(text):
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _batches(spark, sf_dir, item):
    """One payload for each source and 20 documents: (source_id, batch, items in order of doc_id)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").cast("string").alias("id"), F.concat("source", F.lit("-"), F.expr("doc_id div 100")).alias("source_id"))
    listed = docs.select("source_id", "doc_id", item.alias("item")).groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("items"))
    return listed.select("source_id", F.transform("items", lambda i: i["item"]).alias("items"))


B_SQL = f"b AS (SELECT doc_id, {HEAD_SQL} AS head, text, source || '-' || (doc_id // 100) AS source_id, row_number() OVER (PARTITION BY source || '-' || (doc_id // 100) ORDER BY doc_id) - 1 AS pos FROM documents)"
RSS_SOURCE = "substr(source_id, 4, 1) IN ('0', '2', '4', '6', '8')"


def _feeds(spark, sf_dir):
    d = F.col("doc_id")
    title = F.when(d % 9 != 0, F.concat(F.lit("<title> "), _escaped(_head()), F.lit(" </title>"))).otherwise("")
    url = F.concat(F.lit("https://News.example.com/p/"), "id", F.lit("?utm_source=rss&amp;n=1#c"))
    rss = F.concat(F.lit("<item>"), title, F.when(d % 4 == 0, F.concat(F.lit("<guid>"), url, F.lit("</guid>"))).otherwise(F.concat(F.lit("<link>"), url, F.lit("</link>"))), F.concat(F.lit("<description>&lt;b&gt;"), "id", F.lit("&lt;/b&gt; of it</description>")), F.when(d % 3 != 0, "<pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate>").otherwise(""), F.lit("</item>"))
    rel = F.when(d % 5 == 0, ' rel="edit"').when(d % 5 == 1, ' rel="alternate"').otherwise("")
    atom = F.concat(F.lit("<entry>"), title, F.lit("<link"), rel, F.lit(' href="'), url, F.lit('"/><summary>'), F.lit("s "), "id", F.lit("</summary>"), F.when(d % 3 != 0, "<updated>2024-01-05T06:07:08Z</updated>").otherwise(""), F.lit("</entry>"))
    both = _batches(spark, sf_dir, F.struct(rss.alias("rss"), atom.alias("atom")))
    join = lambda field: F.array_join(F.transform("items", lambda i: i[field]), "")
    is_rss = F.expr(RSS_SOURCE)
    body = F.when(is_rss, F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>t</title>'), join("rss"), F.lit("</channel></rss>"))).otherwise(F.concat(F.lit("<feed><title>t</title>"), join("atom"), F.lit("</feed>")))
    return both.select("source_id", body.alias("body"))


def b_feed(spark, sf_dir):
    return feeds.feed(_feeds(spark, sf_dir)).drop("pos")


def _publications(spark, sf_dir):
    d = F.col("doc_id")
    link = lambda base: F.concat(F.lit(base), "id")
    authors = F.transform(F.sequence(F.lit(1), (d % 11 + 1).cast("int")), lambda i: F.struct(F.concat(F.lit("A"), i.cast("string")).alias("text")))
    info = F.struct(F.when(d % 8 != 0, _head()).alias("title"), F.when(d % 3 == 0, F.array(F.lit("http://plain.example.com"), link("https://ee.example.com/"))).alias("ee"), F.when(d % 2 == 0, link("https://dx.doi.org/10.1/")).alias("doi"), F.when(d % 7 != 0, link("https://dblp.example.com/rec/")).alias("url"), F.when(d % 4 != 0, F.lit("Venue")).alias("venue"), F.struct(authors.alias("author")).alias("authors"))
    rows = _batches(spark, sf_dir, F.struct(info.alias("info")))
    return rows.select("source_id", F.to_json(F.struct(F.struct(F.struct(F.col("items").alias("hit")).alias("hits")).alias("result"))).alias("body"))


def b_bibliography(spark, sf_dir):
    return feeds.bibliography(_publications(spark, sf_dir)).drop("pos", "published_at")


def _notes(spark, sf_dir):
    d = F.col("doc_id")
    wrapped = lambda c, when: F.when(when, F.struct(c.alias("value")))
    note = F.struct(
        F.concat(F.lit("n"), "id").alias("id"), F.when(d % 3 == 0, F.concat(F.lit("f"), "id")).alias("forum"), F.when(d % 2 == 0, _head()).alias("title"), F.when(d % 5 == 0, F.lit("flat abstract")).alias("abstract"),
        F.struct(wrapped(F.concat(F.lit("W "), _head()), d % 4 < 2).alias("title"), wrapped(F.lit("wrapped abstract"), d % 7 == 0).alias("abstract")).alias("content"),
        F.when(d % 3 != 1, F.lit(1704067200000) + d).alias("cdate"), F.lit(1704000000000).alias("pdate"), F.when(d % 4 == 1, d % 9).alias("replyCount"), F.struct(F.when(d % 4 == 2, d % 5).alias("replyCount"), F.array_repeat(F.lit("r"), (d % 3).cast("int")).alias("replies")).alias("details"),
    )
    return _batches(spark, sf_dir, note).select("source_id", F.to_json(F.struct(F.col("items").alias("notes"))).alias("body"))


def b_reviews(spark, sf_dir):
    return feeds.reviews(_notes(spark, sf_dir)).drop("pos")


def b_dispatch(spark, sf_dir):
    """Items by the parser that read them, and the payloads left for pages or for nobody."""
    none = F.lit(None).cast("string")
    xml = _feeds(spark, sf_dir).select("source_id", F.when(F.expr(RSS_SOURCE), "feed").otherwise("html").alias("kind"), none.alias("parser"), F.when(F.expr(RSS_SOURCE), none).otherwise("application/atom+xml").alias("content_type"), "body")
    json = lambda rows, parser: rows.select("source_id", F.lit("json").alias("kind"), F.lit(parser).alias("parser"), none.alias("content_type"), "body")
    page = table(spark, sf_dir, "pages").select(F.col("url").alias("source_id"), F.lit("html").alias("kind"), none.alias("parser"), F.lit("text/html").alias("content_type"), F.col("html").alias("body"))
    rows = xml.unionByName(json(_publications(spark, sf_dir), "dblp-publications")).unionByName(json(_notes(spark, sf_dir), "openreview-notes")).unionByName(json(_notes(spark, sf_dir), "odd")).unionByName(page)
    found, unread = feeds.dispatched(rows)
    return found.select("source_id", "route").unionByName(unread).groupBy("route").agg(F.count("*").alias("n"), F.count_distinct("source_id").alias("sources"))


HREFS = ["c/d", "../e", "/f/./g/../h", "?q=1&ref=x", "#top", "//o.example.com/i", "mailto:me@example.com", "ü/ x", "/%C3%A9?q='é\"", "https://0x7f.1/", "https://2130706433/", "https://8.8/", "https://010.8.8.8/", "https://1.2.3.4.5/", "https://256.1/", "../../../../z/..", "/{a}|b^c`"]
RESOLVED = ["/a/b/c/d", "/a/e", "/f/h", "/a/b/{n}?q=1", "/a/b/{n}", None, None, "/a/b/%C3%BC/%20x", "/%C3%A9?q=%27%C3%A9%22", None, None, None, None, None, None, "/", "/%7Ba%7D|b^c%60"]
OTHERS = {5: "https://o.example.com/i", 11: "https://8.0.0.8/", 12: "https://8.8.8.8/"}

ANCHORED = r'<a class="k" href="/\1?utm_x=1&amp;k=2"><b>\1</b> \2</a>'


def b_page_links(spark, sf_dir):
    """Links of pages whose paragraphs begin with one."""
    html = F.regexp_replace("html", r"<p>(\w{3,}) ([^<]{8,60})", ANCHORED.replace("\\", "$"))
    return pages.page_links(table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html"))).select("page_id", "title", "url")


LISTED = r'<ul><li>Before \1<li><a href="\1?k=2" aria-label="Label \1 \2"></a> On March 3, 2024 \1</ul>'
MORE = "More of this very page"
SAID = "Written 2024-02-01 with words enough for a section."


def b_page_items(spark, sf_dir):
    """Links of pages whose paragraphs begin with a list of open items, one of them a link with a label only, and a headed section.

    The label is the paragraph's source as it stands, so it is escaped like any text that goes into an attribute.
    """
    marked = LISTED.replace("\\", "$").replace('label="', 'label="\x01').replace('"></a>', '\x01"></a>')
    cut = F.split(F.regexp_replace("html", r"<p>(\w{3,}) ([^<]{8,60})", marked), "\x01")  # every other piece is a label
    made = F.array_join(F.transform(cut, lambda piece, i: F.when(i % 2 == 1, F.replace(_escaped(piece), F.lit('"'), F.lit("&quot;"))).otherwise(piece)), "")
    html = F.replace(made, F.lit("</article>"), F.lit(f'<aside><aside>no</aside>no</aside><h2 id="more">{MORE}</h2><p>{SAID}</p></article>'))
    return pages.page_items(table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html")))


def b_dispatched(spark, sf_dir):
    """What the four JSON parsers of the dispatcher that page through posts and issues give, by route."""
    none = F.lit(None).cast("string")
    json = lambda rows, parser: rows.select("source_id", F.lit("json").alias("kind"), F.lit(parser).alias("parser"), none.alias("content_type"), "body")
    made = {"github-issues": jobs.issues_payloads, "bluesky-search": jobs.posts_payloads, "hacker-news": jobs.forum_payloads, "huggingface-daily-papers": jobs.papers_payloads}
    rows = [json(make(spark, sf_dir), parser) for parser, make in made.items()]
    found, _ = feeds.dispatched(reduce(DataFrame.unionByName, rows), 1_000_000)
    return found.groupBy("route").agg(F.count("*").alias("n"), F.sum("engagement").alias("engagement"), F.count_distinct("url").alias("urls"), F.min("published_at").alias("first"), F.max("published_at").alias("last"), F.count_if(F.col("excerpt") != "").alias("with_excerpt"))


def b_resolved_urls(spark, sf_dir):
    """Addresses as written on pages, read against the page's own and made canonical."""
    n = F.col("page_id")
    href = F.element_at(F.array(*map(F.lit, HREFS)), (n % len(HREFS) + 1).cast("int"))
    base = F.concat(F.lit("https://p.example.com/a/b/"), n.cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", tx.canonical_url(tx.resolved_url(href, base)).alias("url"))


TO_HEADING, HEADED = r"<p>([^<]{12,40})", r'<h3 id="">\1</h3><p>\1'


def _sectioned(spark, sf_dir):
    """Pages whose paragraphs begin with a heading of their own."""
    html = F.regexp_replace("html", TO_HEADING, "<h3>$1</h3><p>$1")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 3 == 0, F.replace(html, F.lit("<h3>"), F.lit('<h3 class="x" id="part">'))).otherwise(html).alias("html"))


def b_sections(spark, sf_dir):
    return pages.sections(_sectioned(spark, sf_dir)).drop("pos", "published_at")


def b_changelog(spark, sf_dir):
    d = F.col("doc_id")
    month = F.element_at(F.array(*map(F.lit, ("Jan", "February", "Mar", "April", "May"))), (d % 5 + 1).cast("int"))
    entry = F.concat(F.lit(" 1."), (d % 40).cast("string"), F.lit("."), "id", month, F.lit(" "), (d % 33).cast("string"), F.lit(", 2024 "), F.substring(F.regexp_replace(_head(), "[0-9]", ""), 1, (d % 90).cast("int")))
    rows = _batches(spark, sf_dir, entry)
    return pages.releases(rows.select("source_id", F.lit("https://log.example.com/c").alias("url"), F.concat(F.lit("Changelog "), F.array_join("items", "")).alias("text")), "Tool").drop("pos")


def _page_parts(spark, sf_dir):
    """Pages with a date in one of five places, by number."""
    n = F.col("page_id")
    tag = F.when(n % 6 == 0, '<meta property="article:published_time" content="2024-01-03T00:00:00Z">').when(n % 6 == 1, '<time datetime="2024-01-04T00:00:00Z">x</time>').when(n % 6 == 2, '<script type="application/ld+json">{"@type":"A","datePublished":"2024-01-05T00:00:00Z"}</script>').otherwise("")
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.when(n % 6 == 3, F.concat(F.lit("/2024/1/"), (n % 35).cast("string"), F.lit("/"))).when(n % 6 == 4, F.concat(F.lit("/2024/Feb/"), (n % 28 + 1).cast("string"))).otherwise(""), F.lit("/"), n.cast("string"))
    body = F.when(n % 11 == 0, "plain text").otherwise(F.replace(F.replace("html", F.lit("<h1>"), F.concat(tag, F.lit("<h1>"))), F.lit("<p><b>"), F.when(n % 6 == 5, "<p><b>Written March 7, 2024 ").otherwise("<p><b>")))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), body.alias("html"), (n % 13 == 0).alias("failed"))


PARTS = """pp AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 6 WHEN 3 THEN '/2024/1/' || (page_id % 35) || '/' WHEN 4 THEN '/2024/Feb/' || (page_id % 28 + 1) ELSE '' END || '/' || page_id AS url,
  CASE WHEN page_id % 11 = 0 THEN 'plain text' ELSE replace(replace(html, '<h1>', CASE page_id % 6 WHEN 0 THEN '<meta property="article:published_time" content="2024-01-03T00:00:00Z">' WHEN 1 THEN '<time datetime="2024-01-04T00:00:00Z">x</time>'
  WHEN 2 THEN '<script type="application/ld+json">{"@type":"A","datePublished":"2024-01-05T00:00:00Z"}</script>' ELSE '' END || '<h1>'), '<p><b>', CASE WHEN page_id % 6 = 5 THEN '<p><b>Written March 7, 2024 ' ELSE '<p><b>' END) END AS html, page_id % 13 = 0 AS failed FROM pages)"""


def b_enrich(spark, sf_dir):
    found = _page_parts(spark, sf_dir)
    n = F.col("page_id")
    short = F.when(n % 4 == 0, "").otherwise(F.concat(F.lit("Excerpt "), n.cast("string")))
    items = found.select(F.concat("url", F.when(n % 10 == 7, "#part").otherwise("")).alias("url"), F.when(n % 5 != 0, F.concat(F.lit("Title "), n.cast("string"))).alias("title"), F.when(n % 9 == 4, F.repeat(F.lit("long "), 200)).otherwise(short).alias("excerpt"), F.when(n % 9 == 4, F.lit("2023-12-31").cast("timestamp")).alias("published_at"))
    return pages.enriched(items, found.drop("page_id")).withColumns({"content": F.sha2("content", 256), "excerpt": F.sha2("excerpt", 256)})


def b_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.clean_html(F.col("html"), 2400).alias("text"))


def b_dates(spark, sf_dir):
    """Days found in texts and addresses that hold one."""
    n = F.col("page_id")
    said = F.concat(F.lit("On "), F.when(n % 4 == 0, F.concat(F.lit("2024-"), (n % 14).cast("string"), F.lit("/"), (n % 33).cast("string"))).when(n % 4 == 1, F.concat(F.lit("September "), (n % 31 + 1).cast("string"), F.lit(", 2023"))).when(n % 4 == 2, F.concat(F.lit("x2024-01-02, then 2024.3.4")) ).otherwise("no day"), F.lit(" it rained."))
    return _page_parts(spark, sf_dir).select("page_id", tx.find_date(said).alias("in_text"), tx.date_from_url(F.col("url")).alias("in_url"))


def b_public_urls(spark, sf_dir):
    """Canonical forms of the pages' addresses, with hosts, ports, users and parameters put in by number."""
    n = F.col("page_id")
    hosts = ["", "localhost", "a.local", "10.0.0.1", "172.16.9.9", "172.32.0.1", "192.168.1.1", "8.8.8.8", "100.64.0.1", "169.254.1.1", "[::1]", "[fe80::1]", "[2606:4700::1111]", "metadata.google", "u:p@x.example.com", "x.example.com:443", "x.example.com:8443", "EXAMPLE.com.", "300.1.1.1"]
    host = F.element_at(F.array(*map(F.lit, hosts)), (n % len(hosts) + 1).cast("int"))
    tail = F.element_at(F.array(*map(F.lit, ["?UTM_Source=a&id=1&Ref=b#x", "?source=1", "#top", "?a=1&a=2&fbclid=3", "/p?utm_custom=9&q=%20z"])), (n % 5 + 1).cast("int"))
    url = F.concat(F.when(host == "", F.regexp_replace("url", "[?#].*$", "")).otherwise(F.concat(F.lit("https://"), host)), tail)
    return table(spark, sf_dir, "pages").select("page_id", tx.canonical_url(url).alias("url"))


QUERIES = {f.__name__: f for f in (b_page_links, b_page_items, b_dispatched, b_resolved_urls, b_feed, b_bibliography, b_reviews, b_dispatch, b_sections, b_changelog, b_enrich, b_clean, b_dates, b_public_urls)}


def _clean(html: str, most: int) -> str:
    bare = html
    for kind in tx.UNREAD:
        bare = f"regexp_replace({bare}, '(?is)<{kind}\\b[^>]*>.*?</{kind}\\s*>', ' ', 'g')"
    bare = f"regexp_replace({bare}, '<[^>]*>', ' ', 'g')"
    for entity, char in tx.ENTITIES:
        char = char.replace("'", "''")
        bare = f"replace({bare}, '{entity}', '{char}')"
    return _cut(bare, most)


def _cut(text: str, most: int) -> str:
    flat = f"trim(regexp_replace({text}, '[ \\t\\r\\n\\f\\x0b]+', ' ', 'g'))"
    return f"(SELECT CASE WHEN length(f) > {most} THEN rtrim(substr(f, 1, {most - 1})) || '…' ELSE f END FROM (SELECT {flat} AS f))"


def _within(html: str, tag: str) -> str:
    return f"nullif(regexp_extract({html}, '(?is)<{tag}\\b[^>]*>(.*)</{tag}\\s*>', 1), '')"


RANKED = "QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY pos) <= 12"
NAMED = tx.NAMED_DAY
DAY = r"\b(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})\b"


def _find(text: str) -> str:
    return f"""CASE WHEN regexp_matches({text}, '{DAY}') THEN try_strptime(regexp_extract({text}, '{DAY}', 1) || '-' || regexp_extract({text}, '{DAY}', 2) || '-' || regexp_extract({text}, '{DAY}', 3), '%Y-%m-%d')
  ELSE try_strptime(regexp_extract({text}, '{NAMED}', 3) || '-' || substr(regexp_extract({text}, '{NAMED}', 1), 1, 3) || '-' || regexp_extract({text}, '{NAMED}', 2), '%Y-%b-%d') END"""


def _in_url(url: str) -> str:
    return f"""CASE WHEN regexp_matches({url}, '{tx.PATH_DAY}') THEN try_strptime(regexp_extract({url}, '{tx.PATH_DAY}', 1) || '-' || regexp_extract({url}, '{tx.PATH_DAY}', 2) || '-' || regexp_extract({url}, '{tx.PATH_DAY}', 3), '%Y-%m-%d')
  ELSE try_strptime(regexp_extract({url}, '{tx.PATH_NAMED_DAY}', 1) || '-' || regexp_extract({url}, '{tx.PATH_NAMED_DAY}', 2) || '-' || regexp_extract({url}, '{tx.PATH_NAMED_DAY}', 3), '%Y-%b-%d') END"""


ORACLES = {
    "b_feed": f"""WITH {B_SQL} SELECT source_id, {_clean("head", 260)} AS title, 'https://news.example.com/p/' || doc_id || '?n=1' AS url, CASE WHEN {RSS_SOURCE} THEN doc_id || ' of it' ELSE 's ' || doc_id END AS excerpt,
  CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN {RSS_SOURCE} THEN TIMESTAMP '2024-01-02 03:04:05' ELSE TIMESTAMP '2024-01-05 06:07:08' END END AS published_at, 0 AS engagement
FROM b WHERE pos < 12 AND doc_id % 9 <> 0 AND trim(head) <> '' AND ({RSS_SOURCE} OR doc_id % 5 <> 0)""",
    "b_bibliography": f"""WITH {B_SQL}, u AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'https://ee.example.com/' || doc_id END AS ee, CASE WHEN doc_id % 2 = 0 THEN 'https://doi.org/10.1/' || doc_id END AS doi, CASE WHEN doc_id % 7 <> 0 THEN 'https://dblp.example.com/rec/' || doc_id END AS rec FROM b),
c AS (SELECT *, coalesce(ee, doi, rec) AS url, {_cut("head", 260)} AS title FROM u WHERE doc_id % 8 <> 0)
SELECT source_id, title, url, concat_ws('；', CASE WHEN doc_id % 4 <> 0 THEN 'Venue' END, '作者：' || array_to_string(list_transform(range(1, least(doc_id % 11 + 1, 8) + 1), lambda i: 'A' || i), '、'),
  CASE WHEN doc_id % 2 = 0 THEN 'DOI：https://dx.doi.org/10.1/' || doc_id END, CASE WHEN rec <> url THEN 'DBLP：' || rec END) AS excerpt, 0 AS engagement FROM c WHERE url IS NOT NULL AND title <> '' {RANKED}""",
    "b_reviews": f"""WITH {B_SQL}, c AS (SELECT *, {_cut("CASE WHEN doc_id % 4 < 2 THEN 'W ' || head WHEN doc_id % 2 = 0 THEN head END", 260)} AS title FROM b)
SELECT source_id, title, 'https://openreview.net/forum?id=' || CASE WHEN doc_id % 3 = 0 THEN 'f' ELSE 'n' END || doc_id AS url, CASE WHEN doc_id % 7 = 0 THEN 'wrapped abstract' WHEN doc_id % 5 = 0 THEN 'flat abstract' ELSE '' END AS excerpt,
  make_timestamp(CASE WHEN doc_id % 3 <> 1 THEN 1704067200000 + doc_id ELSE 1704000000000 END * 1000) AS published_at, CASE WHEN doc_id % 4 = 1 AND doc_id % 9 > 0 THEN doc_id % 9 WHEN doc_id % 4 = 2 AND doc_id % 5 > 0 THEN doc_id % 5 ELSE doc_id % 3 END AS engagement
FROM c WHERE coalesce(title, '') <> '' {RANKED}""",
    "b_sections": f"""WITH h AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS page, regexp_replace(html, '{TO_HEADING}', '<h3>\\1</h3><p>\\1', 'g') AS html FROM pages), g AS (SELECT page_id, page, CASE WHEN page_id % 3 = 0 THEN replace(html, '<h3>', '<h3 class="x" id="part">') ELSE html END AS html FROM h),
s AS (SELECT page_id, page, string_split_regex(html, '<h[23]') AS parts FROM g), e AS (SELECT page_id, page, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM s),
r AS (SELECT page_id, page, pos, regexp_extract(part, '(?s)^([^>]*)>', 1) AS attributes, regexp_extract(part, '(?s)^[^>]*>(.*?)</h[23]>', 1) AS t, regexp_extract(part, '(?s)^[^>]*>.*?</h[23]>(.*)$', 1) AS x FROM e WHERE pos > 0),
f AS (SELECT page_id, page, pos, attributes, {_clean("t", 240)} AS title, {_clean("x", 2400)} AS excerpt FROM r)
SELECT page_id, title, page || '#' || coalesce(nullif(regexp_extract(attributes, 'id="([^"]*)"', 1), ''), nullif(substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\x{{4e00}}-\\x{{9fff}}]+', '-', 'g'), '^-|-$', '', 'g'), 1, 72), ''), substr(sha256(title), 1, 10)) AS url, excerpt
FROM f WHERE length(title) >= 8 AND NOT regexp_matches(title, '(?i)table of contents|on this page|navigation') AND length(excerpt) >= 40 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 12""",
    "b_changelog": f"""WITH {B_SQL}, e AS (SELECT *, '1.' || (doc_id % 40) || '.' || doc_id AS v, (['Jan', 'February', 'Mar', 'April', 'May'])[doc_id % 5 + 1] AS m, {_cut("substr(regexp_replace(head, '[0-9]', '', 'g'), 1, doc_id % 90)", 2800)} AS excerpt FROM b)
SELECT source_id, 'Tool ' || v AS title, 'https://log.example.com/c#' || v AS url, excerpt, try_strptime('2024-' || substr(m, 1, 3) || '-' || (doc_id % 33), '%Y-%b-%d') AS published_at FROM e WHERE pos < 12 AND length(excerpt) >= 30""",
    "b_enrich": f"""WITH {PARTS}, i AS (SELECT page_id, failed, html, url || CASE WHEN page_id % 10 = 7 THEN '#part' ELSE '' END AS url, CASE WHEN page_id % 5 <> 0 THEN 'Title ' || page_id END AS title,
  CASE WHEN page_id % 9 = 4 THEN repeat('long ', 200) WHEN page_id % 4 = 0 THEN '' ELSE 'Excerpt ' || page_id END AS excerpt, CASE WHEN page_id % 9 = 4 THEN TIMESTAMP '2023-12-31' END AS published_at FROM pp),
o AS (SELECT *, (page_id % 10 = 7 AND excerpt <> '') OR page_id % 9 = 4 AS own FROM i), d AS (SELECT *, NOT own AND (failed OR page_id % 10 = 7) AS degraded FROM o),
w AS (SELECT *, NOT own AND NOT degraded AND page_id % 11 <> 0 AS whole, {_clean(f"coalesce({_within('html', 'article')}, {_within('html', 'main')}, {_within('html', 'body')}, '')", 7000)} AS text, {_clean(_within("html", "h1"), 260)} AS heading FROM d)
SELECT url, CASE WHEN whole THEN coalesce(title, heading) ELSE title END AS title, sha256(CASE WHEN whole THEN {_cut("coalesce(nullif(excerpt, ''), text)", 2800)} ELSE excerpt END) AS excerpt, sha256(CASE WHEN whole THEN coalesce(nullif(text, ''), nullif(excerpt, ''), '') ELSE excerpt END) AS content,
  CASE WHEN whole THEN coalesce(published_at, CASE page_id % 6 WHEN 0 THEN TIMESTAMP '2024-01-03' WHEN 1 THEN TIMESTAMP '2024-01-04' WHEN 2 THEN TIMESTAMP '2024-01-05' END, {_in_url('url')}, {_find('text')}) ELSE published_at END AS published_at,
  CASE WHEN degraded THEN 'degraded' ELSE 'success' END AS status, CASE WHEN whole AND text <> '' THEN 'full-text' ELSE 'excerpt-only' END AS completeness FROM w""",
    "b_clean": f"SELECT page_id, {_clean('html', 2400)} AS text FROM pages",
    "b_dates": f"""WITH {PARTS}, s AS (SELECT page_id, url, 'On ' || CASE page_id % 4 WHEN 0 THEN '2024-' || (page_id % 14) || '/' || (page_id % 33) WHEN 1 THEN 'September ' || (page_id % 31 + 1) || ', 2023' WHEN 2 THEN 'x2024-01-02, then 2024.3.4' ELSE 'no day' END || ' it rained.' AS said FROM pp)
SELECT page_id, {_find('said')} AS in_text, {_in_url('url')} AS in_url FROM s""",
    "b_public_urls": r"""WITH h AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS bare, (['', NULL, NULL, NULL, NULL, '172.32.0.1', NULL, '8.8.8.8', NULL, NULL, NULL, NULL, '[2606:4700::1111]', NULL, NULL, 'x.example.com', 'x.example.com:8443', 'example.com', NULL])[page_id % 19 + 1] AS host,
  (['?id=1', '', '', '?a=1&a=2', '?q=%20z'])[page_id % 5 + 1] AS tail FROM pages)
SELECT page_id, CASE WHEN host = '' THEN CASE WHEN starts_with(bare, 'https://') THEN bare || CASE WHEN page_id % 5 = 4 THEN '/p' ELSE '' END || tail END ELSE 'https://' || host || CASE WHEN page_id % 5 = 4 THEN '/p' ELSE '/' END || tail END AS url FROM h""",
}
BARE = "html"
for _kind in (*tx.UNREAD, "header", "aside"):
    BARE = f"regexp_replace({BARE}, '(?is)<{_kind}\\b[^>]*>.*?</{_kind}\\s*>', ' ', 'g')"
ORACLES["b_page_links"] = rf"""WITH h AS (SELECT page_id, url, regexp_replace(html, '<p>(\w{{3,}}) ([^<]{{8,60}})', '{ANCHORED}', 'g') AS html FROM pages), b AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS base, {BARE} AS html FROM h WHERE starts_with(url, 'https')),
a AS (SELECT page_id, base, unnest(regexp_extract_all(html, '(?s)<a class="k" href="/.*?</a>', 0)) AS x, generate_subscripts(regexp_extract_all(html, '(?s)<a class="k" href="/.*?</a>', 0), 1) AS pos FROM b),
t AS (SELECT page_id, pos, base || '/' || regexp_extract(x, 'href="/(\w+)', 1) || '?amp;k=2' AS url, {_clean("x", 260)} AS title FROM a), f AS (SELECT * FROM t WHERE length(title) BETWEEN 10 AND 240 AND NOT regexp_matches(title, '{pages.LINK_WORDS}')),
g AS (SELECT page_id, url, arg_min(title, pos) AS title, min(pos) AS pos FROM f GROUP BY ALL) SELECT page_id, title, url FROM g QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 12"""
ORACLES["b_dispatch"] = f"""WITH f AS ({ORACLES['b_feed']}), p AS ({ORACLES['b_bibliography']}), n AS ({ORACLES['b_reviews']}),
x AS (SELECT 'feed' AS route, source_id FROM f UNION ALL SELECT 'dblp-publications', source_id FROM p UNION ALL SELECT 'openreview-notes', source_id FROM n UNION ALL SELECT 'html', url FROM pages
  UNION ALL SELECT DISTINCT 'unsupported', source || '-' || (doc_id // 100) FROM documents) SELECT route, count(*) AS n, count(DISTINCT source_id) AS sources FROM x GROUP BY 1"""
ORACLES["b_page_items"] = rf"""WITH h AS (SELECT page_id, url, regexp_replace(html, '<p>(\w{{3,}}) ([^<]{{8,60}})', '{LISTED}', 'g') AS html FROM pages), b AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS page, regexp_extract(url, '^(https://[^?#]*/)', 1) AS folder, html FROM h),
a AS (SELECT page_id, folder, unnest(regexp_extract_all(html, '(?s)<li><a href=.*?</ul>', 0)) AS x, generate_subscripts(regexp_extract_all(html, '(?s)<li><a href=.*?</ul>', 0), 1) AS pos FROM b WHERE folder <> ''),
t AS (SELECT page_id, pos, folder || regexp_extract(x, 'href="(\w+)', 1) || '?k=2' AS url, {_cut("regexp_extract(x, '(?s)aria-label=.([^<]*).></a>', 1)", 260)} AS title, {_clean("x", 1800)} AS excerpt FROM a), f AS (SELECT * FROM t WHERE length(title) BETWEEN 10 AND 240 AND NOT regexp_matches(title, '{pages.LINK_WORDS}')),
g AS (SELECT page_id, url, arg_min(title, pos) AS title, arg_min(excerpt, pos) AS excerpt, min(pos) AS pos FROM f GROUP BY ALL), w AS (SELECT page_id, 0 AS kind, pos, title, url, excerpt, TIMESTAMP '2024-03-03' AS published_at FROM g QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 12
UNION ALL SELECT page_id, 1, 0, '{MORE}', page || '#more', '{SAID}', TIMESTAMP '2024-02-01' FROM b WHERE contains(html, '</article>'))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY kind, pos) AS place, title, url, excerpt, published_at FROM w QUALIFY place <= 12"""
ORACLES["b_resolved_urls"] = "SELECT page_id, CASE page_id % 17 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in OTHERS.items()) + " ELSE 'https://p.example.com' || replace((" + str([u and u.replace("'", "''") for u in RESOLVED]).replace("None", "NULL") + ")[page_id % 17 + 1], '{n}', page_id::VARCHAR) END AS url FROM pages"
_ROUTES = {"github-issues": "b_issues", "bluesky-search": "b_posts", "hacker-news": "b_forum", "huggingface-daily-papers": "b_papers"}
ORACLES["b_dispatched"] = " UNION ALL ".join(
    f"SELECT '{route}' AS route, count(*) AS n, sum(engagement)::BIGINT AS engagement, count(DISTINCT url) AS urls, min(published_at) AS first, max(published_at) AS last, count(*) FILTER (WHERE excerpt <> sha256('')) AS with_excerpt FROM ({jobs.ORACLES[name]})"
    for route, name in _ROUTES.items()
)
