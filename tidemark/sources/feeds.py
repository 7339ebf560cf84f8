"""Feeds, bibliographies, reviews, and the choice of a parser: payloads (source_id, kind, parser, content_type, body) to items.

Every parser returns source_id, pos, title, url, excerpt, published_at and engagement, one row for each item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import text as tx
from tidemark.sources import payloads as pl

MOST_ITEMS = 12
RSS = "struct<channel:struct<item:array<struct<title:string,link:string,guid:string,`content:encoded`:string,content:string,summary:string,description:string,pubDate:string,published:string,updated:string,date:string>>>>"
ATOM = "struct<entry:array<struct<title:string,link:array<struct<_href:string,_rel:string>>,id:string,content:string,summary:string,published:string,updated:string>>>"
DBLP = "struct<result:struct<hits:struct<hit:array<struct<info:struct<title:string,ee:array<string>,doi:string,url:string,venue:string,authors:struct<author:array<struct<text:string>>>>>>>>>"
REVIEWS = (
    "struct<notes:array<struct<id:string,forum:string,title:string,abstract:string,content:struct<title:struct<value:string>,abstract:struct<value:string>>,"
    "cdate:long,pdate:long,tcdate:long,replyCount:long,reply_count:long,details:struct<replyCount:long,replies:array<string>>>>>"
)
MOST_AUTHORS = 8


def items(found: DataFrame) -> DataFrame:
    """Only items with a title and an address."""
    return found.filter((F.coalesce("title", F.lit("")) != "") & F.col("url").isNotNull()).select("source_id", "pos", "title", "url", "excerpt", "published_at", "engagement")


def first_of(*columns: str | Column) -> Column:
    """The first that is not null or empty."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])


def feed(payloads: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """RSS items, or else Atom entries: the first ``most`` of a feed, and of these the ones with a title and a link."""
    rss = F.from_xml("body", RSS, {"ignoreNamespace": "false"})["channel"]["item"]
    atom = F.from_xml("body", ATOM)["entry"]
    parsed = payloads.select("source_id", rss.alias("rss"), atom.alias("atom"))
    none = F.lit(None).cast("string")
    link = F.get(F.filter(F.transform(F.filter("e.link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")).isin("alternate", "self")), lambda x: tx.canonical_url(x["_href"])), lambda u: u.isNotNull()), F.lit(0))
    from_atom = parsed.filter(F.coalesce(F.size("rss"), F.lit(0)) < 1).select("source_id", F.posexplode(F.slice("atom", 1, most)).alias("pos", "e")).select(
        "source_id", "pos", F.col("e.title").alias("t"), F.coalesce(link, tx.canonical_url(F.when(F.size("e.link") < 1, F.col("e.id")).otherwise(F.when(F.col("e.link").isNull(), F.col("e.id"))))).alias("url"),
        first_of("e.content", "e.summary").alias("x"), first_of("e.published", "e.updated").alias("d"),
    )
    from_rss = parsed.filter(F.size("rss") >= 1).select("source_id", F.posexplode(F.slice("rss", 1, most)).alias("pos", "i")).select(
        "source_id", "pos", F.col("i.title").alias("t"), tx.canonical_url(first_of("i.link", "i.guid")).alias("url"),
        first_of("i.`content:encoded`", "i.content", "i.summary", "i.description").alias("x"), first_of("i.pubDate", "i.published", "i.updated", "i.date").alias("d"),
    )
    both = from_rss.unionByName(from_atom)
    return items(both.select("source_id", "pos", tx.clean_html(F.coalesce("t", none), 260).alias("title"), "url", F.coalesce(tx.clean_html(F.col("x"), 2800), F.lit("")).alias("excerpt"), tx.any_time(F.col("d")).alias("published_at"), F.lit(0).cast("long").alias("engagement")))


def bibliography(payloads: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """Publications: the first external link, or the DOI's, or the record's; venue, authors and DOI as excerpt; never a date."""
    hits = payloads.select("source_id", F.posexplode(F.from_json("body", DBLP)["result"]["hits"]["hit"]).alias("pos", "h")).select("source_id", "pos", "h.info.*")
    external = F.get(F.filter(F.transform("ee", tx.canonical_url), lambda u: u.isNotNull()), F.lit(0))
    doi = tx.canonical_url(F.concat(F.lit("https://doi.org/"), F.regexp_replace("doi", r"(?i)^https?://(?:dx\.)?doi\.org/", "")))
    record = tx.canonical_url(F.col("url"))
    authors = F.array_join(F.slice(F.filter(F.transform("authors.author", lambda a: tx.clean_text(a["text"], 100)), lambda a: F.coalesce(a, F.lit("")) != ""), 1, MOST_AUTHORS), "、")
    found = hits.select("source_id", "pos", tx.clean_text(F.col("title"), 260).alias("title"), F.coalesce(external, doi, record).alias("address"), record.alias("record"), F.nullif(tx.clean_text(F.col("venue"), 160), F.lit("")).alias("venue"), F.nullif(authors, F.lit("")).alias("authors"), F.nullif(tx.clean_text(F.col("doi"), 160), F.lit("")).alias("doi"))
    parts = F.concat_ws("；", "venue", F.concat(F.lit("作者："), "authors"), F.concat(F.lit("DOI："), "doi"), F.when(F.col("record") != F.col("address"), F.concat(F.lit("DBLP："), "record")))
    return capped(items(found.select("source_id", "pos", "title", F.col("address").alias("url"), parts.alias("excerpt"), F.lit(None).cast("timestamp").alias("published_at"), F.lit(0).cast("long").alias("engagement"))), most)


def reviews(payloads: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """Review notes: fields may be wrapped in ``value``, times are milliseconds, replies are counted in one of four places."""
    notes = payloads.select("source_id", F.posexplode(F.from_json("body", REVIEWS)["notes"]).alias("pos", "n")).select("source_id", "pos", "n.*")
    forum = first_of("forum", "id")
    millis = F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in ("cdate", "pdate", "tcdate")])
    replies = F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in ("replyCount", "reply_count", "details.replyCount")], F.size("details.replies").cast("long"), F.lit(0))
    return capped(items(notes.select(
        "source_id", "pos", tx.clean_text(first_of("content.title.value", "title"), 260).alias("title"), tx.canonical_url(F.concat(F.lit("https://openreview.net/forum?id="), forum)).alias("url"),
        F.coalesce(tx.clean_text(first_of("content.abstract.value", "abstract"), 2800), F.lit("")).alias("excerpt"), F.timestamp_millis(millis).alias("published_at"), F.greatest(replies, F.lit(0)).alias("engagement"),
    )), most)


def capped(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` items of each payload (one a source), by place."""
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy("pos"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


JSON = {"github-issues": pl.issues, "bluesky-search": pl.posts, "hacker-news": pl.forum, "huggingface-daily-papers": pl.papers, "openreview-notes": reviews, "dblp-publications": bibliography}


def route(kind: Column, parser: Column, content_type: Column, body: Column) -> Column:
    """Which parser reads a payload: the JSON parser's name, feed, html, or unsupported."""
    looks_like_xml = F.regexp_like(F.coalesce(content_type, F.lit("")), F.lit("(?i)xml|rss|atom")) | F.regexp_like(F.coalesce(body, F.lit("")), F.lit(r"(?i)^\s*<\?xml|^\s*<(rss|feed)\b"))
    named = F.when(parser.isin(*JSON), parser).otherwise("unsupported")
    return F.when(kind == "json", named).when((kind == "feed") | looks_like_xml, "feed").otherwise("html")


def dispatched(payloads: DataFrame, most: int = MOST_ITEMS) -> tuple[DataFrame, DataFrame]:
    """((source_id, route, pos, title, url, excerpt, published_at, engagement) of all feeds and JSON payloads, payloads that no parser here reads).

    Each payload goes to one parser, and its first ``most`` items with a title and an address count.
    """
    routed = payloads.withColumn("route", route(F.col("kind"), F.col("parser"), F.col("content_type"), F.col("body")))
    plain = lambda read: lambda rows: capped(read(rows), most)
    readers = {"feed": lambda rows: feed(rows, most)} | {name: (lambda rows, read=read: read(rows, most)) if read in (reviews, bibliography) else plain(read) for name, read in JSON.items()}
    found = [read(routed.filter(F.col("route") == name)).withColumn("route", F.lit(name)) for name, read in readers.items()]
    columns = ["source_id", "route", "pos", "title", "url", "excerpt", "published_at", "engagement"]
    whole = reduce(DataFrame.unionByName, [f.select(*columns) for f in found])
    return whole, routed.filter(F.col("route").isin("html", "unsupported")).select("source_id", "route")
