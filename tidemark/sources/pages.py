"""Items out of pages: sections, changelogs, and the texts and dates of articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import markup
from tidemark.functions import text as tx

MOST_ITEMS = 12
HEADING = r"<h[23]"
HEADED = r"(?s)^([^>]*)>(.*?)</h[23]>(.*)$"
RELEASE = r"(?<![A-Za-z0-9_])(\d+\.\d+\.\d+)([A-Z][a-z]+ \d{1,2}, 20\d{2})(?![A-Za-z0-9_])"
LINK_WORDS = r"(?i)privacy|terms|cookie|sign in|log in|subscribe|contact|about us"
LEAST_EXCERPT, LEAST_SECTION, LEAST_RELEASE = 900, 40, 30


def within(html: Column, tag: str) -> Column:
    """What the first element of a kind holds, null without one."""
    return F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}\s*>", 1), F.lit(""))


def attribute(html: Column, element: str, name: str) -> Column:
    """An attribute of the first element that the pattern names."""
    return F.nullif(F.regexp_extract(html, rf"""(?is)<{element}[^>]*\b{name}=["']([^"']*)["']""", 1), F.lit(""))


def sections(pages: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """(page_id, pos, title, url, excerpt, published_at) of a page's headed sections with a title and a text long enough."""
    parts = pages.select("page_id", F.regexp_replace("url", "#.*$", "").alias("page"), F.posexplode(F.split("html", HEADING)).alias("pos", "part")).filter("pos > 0")
    read = parts.select("page_id", "page", "pos", F.regexp_extract("part", HEADED, 1).alias("attributes"), tx.clean_html(F.regexp_extract("part", HEADED, 2), 240).alias("title"), tx.clean_html(F.regexp_extract("part", HEADED, 3), 2400).alias("excerpt"))
    fit = read.filter((F.length("title") >= 8) & ~F.regexp_like("title", F.lit("(?i)table of contents|on this page|navigation")) & (F.length("excerpt") >= LEAST_SECTION))
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "-"), "^-|-$", ""), 1, 72)
    anchor = F.coalesce(F.nullif(F.regexp_extract("attributes", r"""\bid=["']([^"']*)["']""", 1), F.lit("")), F.nullif(slug, F.lit("")), F.substring(F.sha2("title", 256), 1, 10))
    ranked = fit.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).filter(F.col("rank") <= most)
    return ranked.select("page_id", "pos", "title", F.concat("page", F.lit("#"), anchor).alias("url"), "excerpt", tx.find_date(F.concat_ws(" ", "title", "excerpt")).alias("published_at"))


def releases(texts: DataFrame, product: str, most: int = MOST_ITEMS) -> DataFrame:
    """(source_id, pos, title, url, excerpt, published_at) of a changelog's text: x.y.z and a day begin an entry, which ends at the next.

    Reads source_id, url and text. The first ``most`` entries count, and of these the ones with text enough.
    """
    marked = F.split(F.regexp_replace("text", RELEASE, "\x01$1\x02$2\x02"), "\x01")
    parts = texts.select("source_id", "url", F.posexplode(F.slice(marked, 2, most)).alias("pos", "part"))
    cut = parts.select("source_id", "url", "pos", F.split("part", "\x02").alias("p"))
    read = cut.select("source_id", "pos", F.concat(F.lit(f"{product} "), F.col("p")[0]).alias("title"), F.concat("url", F.lit("#"), F.col("p")[0]).alias("url"), tx.clean_text(F.col("p")[2], 2800).alias("excerpt"), tx.find_date(F.col("p")[1]).alias("published_at"))
    return read.filter(F.length("excerpt") >= LEAST_RELEASE)


def dated(published: Column, html: Column, url: Column, text: Column) -> Column:
    """The item's own time, or the page's: meta, time element, linked data, address, text."""
    linked = F.nullif(F.regexp_extract(html, r'(?is)<script[^>]*ld\+json[^>]*>.*?"date(?:Published|Modified)"\s*:\s*"([^"]*)"', 1), F.lit(""))
    meta = F.nullif(F.regexp_extract(html, r"""(?is)<meta[^>]*article:published_time["'][^>]*content=["']([^"']*)["']""", 1), F.lit(""))
    return F.coalesce(published, tx.any_time(F.coalesce(meta, attribute(html, "time", "datetime"))), tx.any_time(linked), tx.date_from_url(url), tx.find_date(text))


def enriched(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items with the text, title and date of their page.

    Reads url, title, excerpt, published_at of items, and url, html, failed of pages. An item that names a part of a page,
    or has a long excerpt and a date, keeps its excerpt; so does one whose page is no HTML. A page that failed or is not
    there makes the item degraded. Else the text is the page's article, main or body.
    """
    own = (F.contains("url", F.lit("#")) & (F.coalesce("excerpt", F.lit("")) != "")) | ((F.length("excerpt") >= LEAST_EXCERPT) & F.col("published_at").isNotNull())
    fetched = pages.select(F.col("url").alias("page_url"), "html", "failed")
    joined = items.withColumn("own", F.coalesce(own, F.lit(False))).join(fetched, F.col("url") == F.col("page_url"), "left")
    html = F.col("html")
    is_html = F.regexp_like(F.coalesce(html, F.lit("")), F.lit(r"(?i)^\s*(<!doctype html|<html)"))
    text = tx.clean_html(F.coalesce(within(html, "article"), within(html, "main"), within(html, "body"), F.lit("")), 7000)
    degraded = ~F.col("own") & (html.isNull() | F.coalesce("failed", F.lit(False)))
    whole = ~F.col("own") & ~degraded & is_html
    meta = F.coalesce(F.nullif(F.regexp_extract(html, r"""(?is)<meta[^>]*name=["']description["'][^>]*content=["']([^"']*)["']""", 1), F.lit("")), F.lit(""))
    heading = tx.clean_html(within(html, "h1"), 260)
    read = joined.withColumns({"text": text, "whole": whole, "degraded": degraded, "meta": meta, "heading": heading})
    nonempty = lambda c: F.nullif(F.col(c), F.lit(""))
    content = F.when(F.col("whole"), F.coalesce(nonempty("text"), nonempty("excerpt"), "meta")).otherwise(F.coalesce("excerpt", F.lit("")))
    return read.select(
        "url", F.when(F.col("whole"), F.coalesce(nonempty("title"), "heading")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("whole"), tx.clean_text(F.coalesce(nonempty("excerpt"), nonempty("meta"), "text"), 2800)).otherwise(F.col("excerpt")).alias("excerpt"), content.alias("content"),
        F.when(F.col("whole"), dated(F.col("published_at"), html, F.col("url"), F.col("text"))).otherwise(F.col("published_at")).alias("published_at"),
        F.when(F.col("degraded"), "degraded").otherwise("success").alias("status"), F.when(F.col("whole") & (F.col("text") != ""), "full-text").otherwise("excerpt-only").alias("completeness"),
    )


def page_links(pages: DataFrame, patterns: list[str] | None = None, most: int = MOST_ITEMS) -> DataFrame:
    """(page_id, pos, title, url, excerpt, published_at) of a page's anchors: titles of 10 to 240 characters, on the page's host or below it, each url once.

    Reads page_id, url and html. Navigation, headers, footers, forms and asides do not count, nor do titles of legal or
    account pages. An anchor without content takes its aria-label for a title. Addresses are read against the page's own. With
    ``patterns`` an address must match one of them. The first ``most`` are kept; the text of an anchor's closest container
    is its excerpt, and the day in it its date.
    """
    parts = pages.select("page_id", "url", markup.page_parts("html").alias("p"))
    page_host = F.regexp_replace(F.lower(F.regexp_extract("url", r"(?i)^https?://([^/?#:]+)", 1)), r"^www\.", "")
    rows = parts.select("page_id", F.col("url").alias("page"), page_host.alias("page_host"), F.posexplode("p.anchors").alias("pos", "a"))
    given = lambda name: rf"""(?is)(?<![\w-]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    named = lambda name: F.concat(*[F.regexp_extract("a.attributes", given(name), i) for i in (1, 2, 3)])
    empty = F.regexp_replace("a.inner", "<[^>]*>", "") == ""
    title = tx.clean_html(F.when(empty, named("aria-label")).otherwise(F.col("a.inner")), 260)
    url = tx.canonical_url(tx.resolved_url(named("href"), F.col("page")))
    found = rows.filter(F.regexp_like("a.attributes", F.lit(given("href")))).select("page_id", "pos", "page_host", title.alias("title"), url.alias("url"), "a.around", "a.until")
    host = F.regexp_replace(F.regexp_replace(tx.host_of(F.col("url")), r"^www\.", ""), r":\d+$", "")
    fit = found.filter(F.col("url").isNotNull() & F.length("title").between(10, 240) & ~F.regexp_like("title", F.lit(LINK_WORDS)) & ((host == F.col("page_host")) | F.endswith(host, F.concat(F.lit("."), "page_host"))))
    once = fit.filter(wanted(patterns)).groupBy("page_id", "url").agg(F.min(F.struct("pos", "title", "around", "until")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("first.pos"))
    kept = once.withColumn("rank", rank).filter(F.col("rank") <= most).select("page_id", "url", "first.*")
    # a page's text is cut once for all its links, and only for those kept
    held = kept.groupBy("page_id").agg(F.collect_list(F.struct("pos", "title", "url", "around", "until")).alias("links")).join(parts.select("page_id", "p.bare"), "page_id")
    cut = lambda k: F.substr(F.col("bare"), k["around"] + 1, k["until"] - k["around"])
    texts = held.select("page_id", F.explode(F.transform("links", lambda k: F.struct(k["pos"].alias("pos"), k["title"].alias("title"), k["url"].alias("url"), cut(k).alias("around")))).alias("k"))
    read = texts.select("page_id", "k.pos", "k.title", "k.url", F.coalesce(tx.clean_html(F.col("k.around"), 1800), F.lit("")).alias("excerpt"))
    return read.withColumn("published_at", tx.find_date(F.col("excerpt")))


def wanted(patterns: list[str] | None) -> Column:
    """Whether ``url`` matches one of the patterns, or there are none."""
    found = F.lit(not patterns)
    for pattern in patterns or []:
        found |= F.regexp_like("url", F.lit(f"(?i){pattern}"))
    return found


def page_items(pages: DataFrame, patterns: list[str] | None = None, most: int = MOST_ITEMS) -> DataFrame:
    """(page_id, place, title, url, excerpt, published_at): a page's links and after them its headed sections, ``most`` in all."""
    links = page_links(pages, patterns, most)
    bare = pages.select("page_id", "url", markup.page_parts("html")["bare"].alias("html"))
    headed = sections(bare, most).filter(wanted(patterns)).join(links.select("page_id", "url"), ["page_id", "url"], "left_anti")
    both = links.withColumn("kind", F.lit(0)).unionByName(headed.withColumn("kind", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("kind", "pos"))
    return both.withColumn("place", place).filter(F.col("place") <= most).select("page_id", "place", "title", "url", "excerpt", "published_at")
