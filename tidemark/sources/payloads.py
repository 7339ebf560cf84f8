"""Items out of source payloads: each parser takes (source_id, body) with one JSON text a row and explodes its items, each with its place (pos)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx

ISSUES = "array<struct<title:string, html_url:string, body:string, comments:long, created_at:string, updated_at:string, pull_request:struct<url:string>>>"
POSTS = (
    "struct<posts:array<struct<uri:string, author:struct<handle:string>, text:string, record:struct<text:string, createdAt:string>, indexedAt:string, "
    "replyCount:long, repostCount:long, likeCount:long, quoteCount:long>>>"
)
FORUM = (
    "struct<hits:array<struct<title:string, story_title:string, comment_text:string, story_text:string, objectID:string, story_id:string, points:long, "
    "num_comments:long, created_at:string, created_at_i:long>>>"
)
PAPER = "title:string, id:string, summary:string, abstract:string, upvotes:long, votes:long, numComments:long, publishedAt:string"
PAPERS = f"array<struct<{PAPER}, paper:struct<{PAPER}>>>"
ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'


def _items(payloads: DataFrame, schema: str, items: str | None = None) -> DataFrame:
    parsed = F.from_json("body", schema)
    return payloads.select("source_id", F.posexplode(parsed[items] if items else parsed).alias("pos", "i"))


def _count(*parts: Column | str) -> Column:
    total = F.lit(0)
    for part in parts:
        total += F.greatest(F.coalesce(F.col(part) if isinstance(part, str) else part, F.lit(0)), F.lit(0))
    return total.cast("long")


def _first(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def _named(rows: DataFrame, title: Column, url: Column, excerpt: Column, time: Column, engagement: Column) -> DataFrame:
    """Items with a title and an address, both in their canonical form."""
    found = rows.select(
        "source_id", "pos", tx.clean_text(title, 260).alias("title"), tx.canonical_url(url).alias("url"), F.coalesce(tx.clean_text(excerpt, 2800), F.lit("")).alias("excerpt"), time.alias("published_at"), engagement.alias("engagement")
    )
    return found.filter((F.coalesce("title", F.lit("")) != "") & F.col("url").isNotNull())


def issues(payloads: DataFrame) -> DataFrame:
    """Issues, no pull requests; comments are the engagement."""
    found = _items(payloads, ISSUES).filter(F.col("i.pull_request").isNull())
    return _named(found, F.col("i.title"), F.col("i.html_url"), F.col("i.body"), tx.any_time(_first("i.created_at", "i.updated_at")), _count("i.comments"))


def posts(payloads: DataFrame) -> DataFrame:
    """Posts; the address is made of the handle and the last part of the record's name."""
    url = F.concat(F.lit("https://bsky.app/profile/"), _first("i.author.handle"), F.lit("/post/"), F.nullif(F.substring_index("i.uri", "/", -1), F.lit("")))
    text, time = _first("i.record.text", "i.text"), tx.any_time(_first("i.record.createdAt", "i.indexedAt"))
    return _named(_items(payloads, POSTS, "posts"), text, url, text, time, _count("i.replyCount", "i.repostCount", "i.likeCount", "i.quoteCount"))


def forum(payloads: DataFrame) -> DataFrame:
    """Forum hits: title, the story's or the comment; points and comments; time as text or else in seconds. The address is the hit's own page."""
    url = F.concat(F.lit("https://news.ycombinator.com/item?id="), _first("i.objectID", "i.story_id"))
    time = F.coalesce(tx.any_time(F.col("i.created_at")), F.timestamp_seconds(F.nullif("i.created_at_i", F.lit(0))))
    return _named(_items(payloads, FORUM, "hits"), _first("i.title", "i.story_title", "i.comment_text"), url, _first("i.story_text", "i.comment_text"), time, _count("i.points", "i.num_comments"))


def papers(payloads: DataFrame) -> DataFrame:
    """Papers, with their fields nested or flat; votes and comments, the entry's own before the paper's."""
    url = F.concat(F.lit("https://huggingface.co/papers/"), _first("i.paper.id", "i.id"))
    votes = F.coalesce("i.upvotes", "i.votes", "i.paper.upvotes", "i.paper.votes")
    excerpt = _first("i.paper.summary", "i.paper.abstract", "i.summary", "i.abstract")
    time = tx.any_time(_first("i.publishedAt", "i.paper.publishedAt"))
    return _named(_items(payloads, PAPERS), _first("i.paper.title", "i.title"), url, excerpt, time, _count(votes, F.coalesce("i.numComments", "i.paper.numComments")))


def links(pages: DataFrame, least: int = 10, longest: int = 240, most: int = 36) -> DataFrame:
    """(page_id, pos, url, title) of a page's anchors whose title has a fit length; each url once, the first ``most`` of a page."""
    host = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    anchors = pages.select("page_id", host.alias("host"), F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))).alias("pos", "anchor"))
    href, title = F.regexp_extract("anchor", ANCHOR, 1), F.trim(F.regexp_extract("anchor", ANCHOR, 2))
    found = anchors.select("page_id", "pos", F.when(F.startswith(href, F.lit("/")), F.concat("host", href)).otherwise(href).alias("url"), title.alias("title"))
    fit = found.filter(F.length("title").between(least, longest)).groupBy("page_id", "url").agg(F.min(F.struct("pos", "title")).alias("first"))
    ranked = fit.groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("first.pos", "url", "first.title"))), 1, most).alias("kept"))
    return ranked.select("page_id", F.explode("kept").alias("k")).select("page_id", "k.*")
