"""Queries over payloads, catalog rows, runs, revisions and models."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.plans.inputs import ART, AS_OF_SQL, articles, as_of, table
from tidemark.sources import payloads


def _payloads(spark, sf_dir, item, wrap=None):
    """JSON payloads of at most 50 documents each; ``head`` is the first line of a document, ``start`` its beginning."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.col("doc_id").cast("string").alias("id"), F.expr("doc_id div 50").alias("batch"), F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 300).alias("head"), F.substring("text", 1, 3000).alias("start"),
    )
    listed = docs.groupBy("source", "batch").agg(F.collect_list(item).alias("items"))
    return listed.select(F.col("source").alias("source_id"), F.to_json(F.struct(F.col("items").alias(wrap)) if wrap else F.col("items")).alias("body"))


def _of(divisor, value):
    return F.when(F.col("doc_id") % divisor == 0, value)


def _digested(items):
    return items.drop("pos").withColumn("excerpt", F.sha2("excerpt", 256))


def issues_payloads(spark, sf_dir):
    item = F.struct(F.col("head").alias("title"), F.concat(F.lit("https://x.example.com/"), "id", F.lit("#c")).alias("html_url"), F.col("start").alias("body"), (F.col("doc_id") % 9).alias("comments"), _of(2, F.lit("2024-01-02T03:04:05Z")).alias("created_at"), F.lit("2024-01-01T00:00:00Z").alias("updated_at"), _of(3, F.struct(F.lit("u").alias("url"))).alias("pull_request"))
    return _payloads(spark, sf_dir, item)


def b_issues(spark, sf_dir):
    return _digested(payloads.issues(issues_payloads(spark, sf_dir)))


def posts_payloads(spark, sf_dir):
    counts = [_of(k, F.col("doc_id") % (k + 5)).alias(n) for k, n in ((1, "replyCount"), (2, "repostCount"), (3, "likeCount"), (4, "quoteCount"))]
    record = F.struct(_of(2, F.col("start")).alias("text"), _of(5, F.lit("2024-01-02T03:04:05Z")).alias("createdAt"))
    item = F.struct(F.concat(F.lit("at://did/post/"), "id").alias("uri"), F.struct(F.col("source").alias("handle")).alias("author"), F.col("head").alias("text"), record.alias("record"), F.lit("2024-01-01T00:00:00Z").alias("indexedAt"), *counts)
    return _payloads(spark, sf_dir, item, "posts")


def b_posts(spark, sf_dir):
    return _digested(payloads.posts(posts_payloads(spark, sf_dir)))


def forum_payloads(spark, sf_dir):
    item = F.struct(
        _of(2, F.col("head")).alias("title"), _of(3, F.concat(F.lit("s"), "id")).alias("story_title"), F.col("start").alias("comment_text"), F.col("id").alias("objectID"), (F.col("doc_id") % 7).alias("points"), _of(3, F.col("doc_id") % 11).alias("num_comments"),
        _of(4, F.lit("2024-01-02T03:04:05Z")).alias("created_at"), F.lit(1700000000).alias("created_at_i"),
    )
    return _payloads(spark, sf_dir, item, "hits")


def b_forum(spark, sf_dir):
    return _digested(payloads.forum(forum_payloads(spark, sf_dir)))


def papers_payloads(spark, sf_dir):
    nested = _of(2, F.struct(F.concat(F.lit("p "), "head").alias("title"), F.concat(F.lit("p"), "id").alias("id"), F.col("start").alias("summary"), (F.col("doc_id") % 13).alias("upvotes")))
    item = F.struct(F.col("head").alias("title"), F.col("id"), F.lit("flat").alias("abstract"), (F.col("doc_id") % 3).alias("numComments"), _of(5, F.col("doc_id") % 17).alias("upvotes"), F.lit("2024-01-03T00:00:00Z").alias("publishedAt"), nested.alias("paper"))
    return _payloads(spark, sf_dir, item)


def b_papers(spark, sf_dir):
    return _digested(payloads.papers(papers_payloads(spark, sf_dir)))


def b_links(spark, sf_dir):
    return payloads.links(table(spark, sf_dir, "pages")).select("page_id", "url", "title")


def a_enabled(spark, sf_dir):
    enabled = F.when(F.col("s_suppkey") % 5 == 0, None).otherwise(F.col("s_suppkey") % 3 != 0)
    return table(spark, sf_dir, "supplier").filter(F.coalesce(enabled, F.lit(True))).select("s_suppkey")


def a_violations(spark, sf_dir):
    """Catalog rules: a positive balance, a known nation, and a nation key that no other row of the same tens digit has."""
    named = F.count("*").over(Window.partitionBy("s_nationkey", F.expr("s_suppkey div 10")))
    nations = table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(True).alias("known"))
    rows = table(spark, sf_dir, "supplier").join(nations, "s_nationkey", "left").withColumn("same", named)
    rules = F.array(F.when(F.col("s_acctbal") <= 0, "balance"), F.when(F.col("known").isNull(), "nation"), F.when(F.col("same") > 1, "unique"))
    return rows.select("s_suppkey", F.explode(F.array_compact(rules)).alias("rule"))


def a_abandoned(spark, sf_dir):
    running, errors = F.col("o_orderstatus") == "O", F.col("o_orderkey") % 3
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(running, "failed").otherwise(F.col("o_orderstatus")).alias("status"), F.when(running, F.greatest(errors, F.lit(1))).otherwise(errors).alias("error_count"))


def a_latest_run(spark, sf_dir):
    place = F.struct("o_orderdate", "o_orderkey")
    good = F.when(F.col("o_orderstatus") == "F", place)
    runs = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max(place).alias("latest"), F.max(good).alias("good"), F.count_if(F.col("o_orderstatus") == "F").alias("n_good"))
    return runs.select("o_orderpriority", F.col("latest.o_orderkey").alias("latest"), F.col("good.o_orderkey").alias("latest_good"), "n_good")


def f_field_diff(spark, sf_dir):
    history = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", *[F.struct(F.lit(f).alias("field"), F.lag(f).over(history).alias("before"), F.col(f).alias("after")).alias(f) for f in ("o_orderstatus", "o_orderpriority")])
    melted = orders.select("o_orderkey", F.explode(F.array("o_orderstatus", "o_orderpriority")).alias("d")).select("o_orderkey", "d.*")
    return melted.filter(~F.col("before").eqNullSafe(F.col("after")))


def f_attempts(spark, sf_dir):
    place = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("attempts"), F.max_by("o_orderstatus", place).alias("last_state"), F.min_by("o_orderkey", place).alias("first_attempt"))


def e_highest_layer(spark, sf_dir):
    weight = F.when(F.col("source_layer") == "official", 3).when(F.col("source_layer") == "practitioner", 2).otherwise(1)
    found = articles(spark, sf_dir).filter("publish_decision <> 'reject'").groupBy("signal_slug").agg(F.max(weight).alias("w"))
    return found.select("signal_slug", F.element_at(F.array(*map(F.lit, ("community", "practitioner", "official"))), F.col("w")).alias("layer"))


def e_promotion(spark, sf_dir):
    """Ready with two independent groups and practitioner evidence; review with one of both; else missing."""
    art = articles(spark, sf_dir).filter("publish_decision <> 'reject' AND stance = 'support'")
    seen = art.groupBy("signal_slug").agg(F.count_distinct("independent_group").alias("groups"), F.bool_or(F.col("source_layer") == "practitioner").alias("practised"))
    enough = (F.col("groups") >= 2).cast("int") + F.col("practised").cast("int")
    return seen.select("signal_slug", "groups", F.when(enough == 2, "ready").when(enough == 1, "review").otherwise("missing").alias("status"))


def c_rule_analysis(spark, sf_dir):
    """Scores of the rule analysis, and its decision."""
    relevance = F.greatest(F.least(F.col("relevance_score") * 12, F.lit(100)), F.lit(0))
    evidence = F.when(F.col("source_layer") == "official", 90).when(F.col("source_layer") == "practitioner", 70).otherwise(50)
    decision = F.when(F.col("relevance_score") >= 5, "publish").when(F.col("relevance_score") >= 3, "watch").otherwise("reject")
    return articles(spark, sf_dir).select("doc_id", F.round(relevance * 0.5 + evidence * 0.3 + F.col("novelty_score") * 0.2, 4).alias("editorial"), evidence.alias("evidence"), decision.alias("decision"))


def d_retire(spark, sf_dir):
    """A retirement list turns watched articles into rejects and leaves all others."""
    listed = articles(spark, sf_dir).filter("doc_id % 4 = 0").select("url").distinct().withColumn("listed", F.lit(True))
    stored = articles(spark, sf_dir).select("url", "publish_decision").join(listed, "url", "left")
    retired = F.col("listed").isNotNull() & (F.col("publish_decision") == "watch")
    return stored.select("url", F.when(retired, "reject").otherwise(F.col("publish_decision")).alias("decision"), retired.alias("changed"))


def d_known(spark, sf_dir):
    """Bootstrap names and stored ones; the stored one wins."""
    part = table(spark, sf_dir, "part")
    both = part.select(F.col("p_name").alias("slug"), F.lit(0).alias("kind"), F.col("p_partkey").alias("key")).unionByName(part.filter("p_size > 25").select(F.col("p_name").alias("slug"), F.lit(1).alias("kind"), F.col("p_partkey").alias("key")))
    return both.groupBy("slug").agg(F.max(F.struct("kind", "key")).alias("last")).select("slug", "last.kind", "last.key")


def g_normalise(spark, sf_dir):
    """Models: no price of zero or less, the first of each name, the maker as a slug."""
    part = table(spark, sf_dir, "part").filter("p_retailprice > 0 AND p_size % 7 <> 0")
    first = part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("p_partkey"))
    slug = F.regexp_replace(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "-"), "^-|-$", "")
    return first.select("p_partkey", "p_name", slug.alias("maker"))


def g_families(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.regexp_replace("p_name", "^[a-z]+ ", "").alias("family"))
    sizes = part.groupBy("p_brand", "family").agg(F.count("*").alias("members"), F.min("p_partkey").alias("first_member"))
    return sizes.filter("members > 1")


def g_price(spark, sf_dir):
    """The discounted price holds until the ship date, that moment included."""
    price = F.when(as_of() <= F.col("l_shipdate"), F.col("l_extendedprice") * (1 - F.col("l_discount"))).otherwise(F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(price, 2).alias("price"))


def g_pulses(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "part").select("p_partkey").join(sold, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("pulses"))


def h_signals(spark, sf_dir):
    art = articles(spark, sf_dir).filter("publish_decision = 'publish' AND source_layer = 'official'")
    return art.select("doc_id", "signal_slug")


def h_nodes(spark, sf_dir):
    """Nodes of the supplier-part graph in order of appearance, with their edges; self loops go."""
    edges = table(spark, sf_dir, "lineitem").filter("l_suppkey <> l_partkey").select(F.struct("l_orderkey", "l_linenumber").alias("at"), F.explode(F.array("l_suppkey", "l_partkey")).alias("node"))
    return edges.groupBy("node").agg(F.min("at").alias("at"), F.count("*").alias("edges")).select("node", F.col("at.l_orderkey").alias("first_order"), "edges")


QUERIES = {f.__name__: f for f in (
    b_issues, b_posts, b_forum, b_papers, b_links, a_enabled, a_violations, a_abandoned, a_latest_run, f_field_diff, f_attempts, e_highest_layer, e_promotion, c_rule_analysis, d_retire, d_known,
    g_normalise, g_families, g_price, g_pulses, h_signals, h_nodes,
)}

HEADS = "h AS (SELECT doc_id, source, substr(split_part(text, chr(10), 1), 1, 300) AS head, substr(text, 1, 3000) AS start FROM documents)"


def _cut(text: str, most: int) -> str:
    return f"(SELECT CASE WHEN length(f) > {most} THEN rtrim(substr(f, 1, {most - 1})) || '…' ELSE f END FROM (SELECT trim(regexp_replace({text}, '[ \\t\\r\\n\\f\\x0b]+', ' ', 'g')) AS f))"


ORACLES = {
    "b_issues": f"""WITH {HEADS} SELECT source AS source_id, {_cut('head', 260)} AS title, 'https://x.example.com/' || doc_id AS url, sha256({_cut('start', 2800)}) AS excerpt, CASE WHEN doc_id % 2 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' ELSE TIMESTAMP '2024-01-01' END AS published_at,
  doc_id % 9 AS engagement FROM h WHERE doc_id % 3 <> 0 AND trim(head) <> ''""",
    "b_posts": f"""WITH {HEADS}, t AS (SELECT *, coalesce(CASE WHEN doc_id % 2 = 0 THEN nullif(trim(start), '') END, trim(head)) AS body FROM h) SELECT source AS source_id, {_cut('body', 260)} AS title, 'https://bsky.app/profile/' || source || '/post/' || doc_id AS url, sha256({_cut('body', 2800)}) AS excerpt,
  CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' ELSE TIMESTAMP '2024-01-01' END AS published_at, doc_id % 6 + CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN doc_id % 8 ELSE 0 END + CASE WHEN doc_id % 4 = 0 THEN doc_id % 9 ELSE 0 END AS engagement FROM t WHERE body <> ''""",
    "b_forum": f"""WITH {HEADS}, t AS (SELECT *, coalesce(CASE WHEN doc_id % 2 = 0 THEN nullif(trim(head), '') END, CASE WHEN doc_id % 3 = 0 THEN 's' || doc_id END, trim(start)) AS body FROM h) SELECT source AS source_id, {_cut('body', 260)} AS title, 'https://news.ycombinator.com/item?id=' || doc_id AS url, sha256({_cut('start', 2800)}) AS excerpt,
  CASE WHEN doc_id % 4 = 0 THEN TIMESTAMP '2024-01-02 03:04:05' ELSE TIMESTAMP '2023-11-14 22:13:20' END AS published_at, doc_id % 7 + CASE WHEN doc_id % 3 = 0 THEN doc_id % 11 ELSE 0 END AS engagement FROM t WHERE body <> ''""",
    "b_papers": f"""WITH {HEADS}, t AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'p ' || head ELSE head END AS body FROM h) SELECT source AS source_id, {_cut('body', 260)} AS title, 'https://huggingface.co/papers/' || CASE WHEN doc_id % 2 = 0 THEN 'p' ELSE '' END || doc_id AS url,
  sha256(CASE WHEN doc_id % 2 = 0 AND trim(start) <> '' THEN {_cut('start', 2800)} ELSE 'flat' END) AS excerpt, TIMESTAMP '2024-01-03' AS published_at, CASE WHEN doc_id % 5 = 0 THEN doc_id % 17 WHEN doc_id % 2 = 0 THEN doc_id % 13 ELSE 0 END + doc_id % 3 AS engagement FROM t WHERE trim(body) <> ''""",
    "b_links": rf"""WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, regexp_extract_all(html, '{payloads.ANCHOR}', 0) AS found FROM pages),
e AS (SELECT page_id, host, unnest(found) AS anchor, generate_subscripts(found, 1) AS pos FROM a),
l AS (SELECT page_id, pos, regexp_extract(anchor, '{payloads.ANCHOR}', 1) AS href, host, trim(regexp_extract(anchor, '{payloads.ANCHOR}', 2)) AS title FROM e),
f AS (SELECT page_id, CASE WHEN starts_with(href, '/') THEN host || href ELSE href END AS url, pos, title FROM l WHERE length(title) BETWEEN 10 AND 240),
d AS (SELECT page_id, url, min(pos) AS pos, arg_min(title, pos) AS title FROM f GROUP BY ALL)
SELECT page_id, url, title FROM d QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 36""",
    "a_enabled": "SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 = 0 OR s_suppkey % 3 <> 0",
    "a_violations": """WITH r AS (SELECT *, count(*) OVER (PARTITION BY s_nationkey, s_suppkey // 10) AS same FROM supplier)
SELECT s_suppkey, 'balance' AS rule FROM r WHERE s_acctbal <= 0 UNION ALL SELECT s_suppkey, 'unique' FROM r WHERE same > 1
UNION ALL SELECT s_suppkey, 'nation' FROM r WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)""",
    "a_abandoned": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'failed' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' THEN greatest(o_orderkey % 3, 1) ELSE o_orderkey % 3 END AS error_count FROM orders",
    "a_latest_run": """SELECT o_orderpriority, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (WHERE o_orderstatus = 'F') AS latest_good,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS n_good FROM orders GROUP BY 1""",
    "f_field_diff": """WITH r AS (SELECT *, lag(o_orderstatus) OVER h AS s0, lag(o_orderpriority) OVER h AS p0 FROM orders WINDOW h AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, 'o_orderstatus' AS field, s0 AS before, o_orderstatus AS after FROM r WHERE s0 IS DISTINCT FROM o_orderstatus
UNION ALL SELECT o_orderkey, 'o_orderpriority', p0, o_orderpriority FROM r WHERE p0 IS DISTINCT FROM o_orderpriority""",
    "f_attempts": "SELECT o_custkey, count(*) AS attempts, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_state, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_attempt FROM orders GROUP BY 1",
    "e_highest_layer": f"""WITH {ART} SELECT signal_slug, CASE max(CASE source_layer WHEN 'official' THEN 3 WHEN 'practitioner' THEN 2 ELSE 1 END) WHEN 3 THEN 'official' WHEN 2 THEN 'practitioner' ELSE 'community' END AS layer
FROM art WHERE publish_decision <> 'reject' GROUP BY 1""",
    "e_promotion": f"""WITH {ART}, s AS (SELECT signal_slug, count(DISTINCT independent_group) AS groups, bool_or(source_layer = 'practitioner') AS p FROM art WHERE publish_decision <> 'reject' AND stance = 'support' GROUP BY 1)
SELECT signal_slug, groups, CASE WHEN groups >= 2 AND p THEN 'ready' WHEN groups >= 2 OR p THEN 'review' ELSE 'missing' END AS status FROM s""",
    "c_rule_analysis": f"""WITH {ART}, s AS (SELECT *, CASE source_layer WHEN 'official' THEN 90 WHEN 'practitioner' THEN 70 ELSE 50 END AS ev FROM art)
SELECT doc_id, round(greatest(least(relevance_score * 12, 100), 0) * 0.5::DOUBLE + ev * 0.3::DOUBLE + novelty_score * 0.2::DOUBLE, 4) AS editorial, ev AS evidence,
  CASE WHEN relevance_score >= 5 THEN 'publish' WHEN relevance_score >= 3 THEN 'watch' ELSE 'reject' END AS decision FROM s""",
    "d_retire": f"WITH {ART} SELECT url, CASE WHEN doc_id % 4 = 0 AND publish_decision = 'watch' THEN 'reject' ELSE publish_decision END AS decision, doc_id % 4 = 0 AND publish_decision = 'watch' AS changed FROM art",
    "d_known": """WITH b AS (SELECT p_name AS slug, 0 AS kind, p_partkey AS key FROM part UNION ALL SELECT p_name, 1, p_partkey FROM part WHERE p_size > 25)
SELECT slug, kind, key FROM b QUALIFY row_number() OVER (PARTITION BY slug ORDER BY kind DESC, key DESC) = 1""",
    "g_normalise": """SELECT min(p_partkey) AS p_partkey, p_name, regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS maker FROM part WHERE p_retailprice > 0 AND p_size % 7 <> 0 GROUP BY p_name, p_brand""",
    "g_families": "SELECT p_brand, regexp_replace(p_name, '^[a-z]+ ', '') AS family, count(*) AS members, min(p_partkey) AS first_member FROM part GROUP BY ALL HAVING count(*) > 1",
    "g_price": f"SELECT l_orderkey, l_linenumber, round(CASE WHEN {AS_OF_SQL} <= l_shipdate THEN l_extendedprice * (1 - l_discount) ELSE l_extendedprice END, 2) AS price FROM lineitem",
    "g_pulses": "SELECT p_partkey, count(l_partkey) AS pulses FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1",
    "h_signals": f"WITH {ART} SELECT doc_id, signal_slug FROM art WHERE publish_decision = 'publish' AND source_layer = 'official'",
    "h_nodes": """WITH e AS (SELECT l_orderkey, l_linenumber, unnest([l_suppkey, l_partkey]) AS node FROM lineitem WHERE l_suppkey <> l_partkey)
SELECT node, min(l_orderkey) AS first_order, count(*) AS edges FROM e GROUP BY 1""",
}
