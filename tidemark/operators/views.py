"""What readers see: sources and languages of signals, discussions, pulses, concept lists, queues of the day, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.identity import mentioned_owners
from tidemark.operators.signals import LAYERS, event_time, heat, layer_weight
from tidemark.storage import materialize, new_path

ZONE = "Asia/Shanghai"
VERIFIED = ("community-only", "practitioner-only", "independently-observed", "official-only", "cross-verified")  # from weak to strong


def inferred_layer(layer: Column, kind: Column) -> Column:
    """The stored layer, or what the source's class says."""
    kind = F.coalesce(kind, F.lit(""))
    return F.when(layer.isin(*LAYERS), layer).when(F.regexp_like(kind, F.lit("社区|community")), "community").when(F.regexp_like(kind, F.lit("实践者|概念雷达|practitioner")), "practitioner").otherwise("official")


def inferred_language(language: Column, kind: Column, title: Column) -> Column:
    """The stored language (zh, en, mixed), or what the source's class says, or zh where the title has a Han letter."""
    kind = F.coalesce(kind, F.lit(""))
    return (
        F.when(language.isin("zh", "en", "mixed"), language).when(F.contains(kind, F.lit("中文")), "zh").when(F.contains(kind, F.lit("英文")), "en")
        .when(F.regexp_like(F.coalesce(title, F.lit("")), F.lit(r"[\x{3400}-\x{9fff}]")), "zh").otherwise("en")
    )


def evidence_kind(layer: Column, kind: Column) -> Column:
    official = F.regexp_like(F.coalesce(kind, F.lit("")), F.lit("项目发布|更新日志|一手工程|官方"))
    return F.when(layer == "practitioner", "independent").when(layer == "community", "origin").when(official, "implementation").otherwise("origin")


def evidence_nodes(items: DataFrame, stages: DataFrame, key: str = "signal_slug", most: int = 5) -> DataFrame:
    """(key, rank, label, kind): a signal's first sources by layer and time, each name once; a mere spark with fewer than two waits for more.

    Reads source_name, source_class, source_layer and times of items, and (key, stage) of stages.
    """
    best = items.groupBy(key, "source_name").agg(F.max_by(F.struct("source_layer", "source_class", F.col("url").alias("u")), F.struct(layer_weight(F.col("source_layer")), event_time())).alias("b"), F.max(F.struct(layer_weight(F.col("source_layer")).alias("w"), event_time().alias("t"))).alias("o"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("o.w"), F.desc("o.t"), "source_name"))
    nodes = best.withColumn("rank", rank).filter(F.col("rank") <= most).select(key, "rank", F.col("source_name").alias("label"), evidence_kind(F.col("b.source_layer"), F.col("b.source_class")).alias("kind"))
    few = nodes.groupBy(key).agg(F.max("rank").alias("n")).filter("n < 2").join(stages.filter("stage = 'Spark'"), key, "left_semi")
    return nodes.unionByName(few.select(key, (F.col("n") + 1).alias("rank"), F.lit("waiting for independent sources").alias("label"), F.lit("conflict").alias("kind")))


def sources_with_representative(items: DataFrame, representatives: DataFrame, key: str = "signal_slug", most: int = 8) -> DataFrame:
    """(key, rank, url): the first sources of each signal by layer and time; its representative takes the last place if it is not among them."""
    one = items.groupBy(key, "url").agg(F.max(layer_weight(F.col("source_layer"))).alias("w"), F.max(event_time()).alias("t"))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("w"), F.desc("t"), "url")))
    rows = ranked.join(representatives.select(key, F.col("rep_url").alias("url"), F.lit(True).alias("rep")), [key, "url"], "left")
    placed = rows.withColumn("rank", F.when(F.col("rep") & (F.col("rank") > most), most).otherwise(F.when((F.col("rank") == most), most + 0.5).otherwise(F.col("rank"))))
    kept = placed.filter(F.col("rank") <= most + 0.5).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("rank")))
    return kept.filter(F.col("rank") <= most).select(key, "rank", "url")


def weekly_leads(signals: DataFrame, weeks: int = 8) -> DataFrame:
    """(week, signals, lead, title): signals of each ISO week and the first of them in the order of ``place``, newest weeks first."""
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("newest_at")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("newest_at").cast("string"), 2, "0"))
    found = signals.groupBy(week.alias("week")).agg(F.count("*").alias("signals"), F.min_by(F.struct("slug", "title"), "place").alias("lead"))
    return found.orderBy(F.desc("week")).limit(weeks).select("week", "signals", F.col("lead.slug").alias("lead"), F.col("lead.title").alias("title"))


def formal_concepts(concepts: DataFrame, signals: DataFrame) -> DataFrame:
    """Formal concepts with the number of their signals, by heat, maturity and name."""
    related = signals.groupBy("concept_slug").agg(F.count("*").alias("signals"))
    rows = concepts.filter(~F.lower("stage").isin("candidate", "archived")).join(related, concepts["slug"] == related["concept_slug"], "left")
    return rows.select("slug", "name", "stage", "heat", "maturity", F.coalesce("signals", F.lit(0)).alias("signals")).orderBy(F.desc("heat"), F.desc("maturity"), "name")


def discussion_pulses(items: DataFrame, as_of: Column) -> DataFrame:
    """Watched community items, each with a heat of its own."""
    rows = items.filter((F.col("publish_decision") == "watch") & (F.col("source_layer") == "community"))
    own = heat(rows, "url", as_of)
    return rows.select("url", event_time().alias("at"), inferred_language(F.col("source_language"), F.lit(None), F.col("title")).alias("language")).join(own.select("url", "score"), "url")


def discussion_stream(pulses: DataFrame, sources: DataFrame) -> DataFrame:
    """(url, at, language, kind): pulses first, then community sources of signals (url, at, language); each url once, newest first."""
    both = pulses.select("url", "at", "language", F.lit(0).alias("kind")).unionByName(sources.select("url", "at", "language", F.lit(1).alias("kind")))
    first = both.groupBy("url").agg(F.min(F.struct("kind", "at", "language")).alias("f"))
    return first.select("url", "f.at", "f.language", F.when(F.col("f.kind") == 0, "pulse").otherwise("signal").alias("kind")).orderBy(F.desc("at"), "url")


def alias_pulses(items: DataFrame, aliases: DataFrame, as_of: Column, most_sources: int = 8) -> DataFrame:
    """(model, name, week and month totals and by layer, urls) of models whose aliases items mention in the last month, busiest first.

    ``aliases``: model, name, alias. An item counts once for a model, however many aliases it has. Future items do not count.
    """
    age = F.unix_seconds(as_of) - F.unix_seconds(event_time())
    texts = items.select("url", F.col("source_layer").alias("layer"), age.alias("age"), event_time().alias("at"), F.concat_ws(" ", "title", "text").alias("text")).filter(F.col("age").between(0, 30 * 86400))
    owners = mentioned_owners(texts, aliases.select("model", "name", F.lower("alias").alias("term")))
    hits = owners.groupBy("model", "url").agg(F.first("name").alias("name"), F.first("layer").alias("layer"), F.min("age").alias("age"), F.max("at").alias("at"))
    hits = materialize(hits, "hits-of-models")  # read twice
    weekly = F.col("age") <= 7 * 86400
    sums = hits.groupBy("model").agg(F.min("name").alias("name"), F.count_if(weekly).alias("week"), F.count("*").alias("month"), *[F.count_if(weekly & (F.col("layer") == x)).alias(f"week_{x}") for x in LAYERS], *[F.count_if(F.col("layer") == x).alias(f"month_{x}") for x in LAYERS])
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("at"), "url"))
    newest = hits.withColumn("rank", rank).filter(F.col("rank") <= most_sources).groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda s: s["url"]).alias("urls"))
    return sums.join(newest, "model").orderBy(F.desc("week"), F.desc("month"), "name")


def public_relations(relations: DataFrame, formal: DataFrame, public: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(source, type, target, confidence, evidence): the best relation of each type between formal concepts, borne by public evidence.

    ``relations``: source, type, target, confidence, url.
    """
    legal = relations.filter(F.col("type").isin(*kinds) & (F.col("source") != F.col("target"))).join(public.select("url"), "url", "left_semi")
    both = legal.join(formal.select(F.col("slug").alias("source")), "source", "left_semi").join(formal.select(F.col("slug").alias("target")), "target", "left_semi")
    return both.groupBy("source", "type", "target").agg(F.max("confidence").alias("confidence"), F.count_distinct("url").alias("evidence"))


def snapshot_status(items: DataFrame, runs: DataFrame, as_of: Column, stale_hours: int = 12) -> DataFrame:
    """One row: counts of items, the analysis mode (one, or mixed), the last run and the last good one, and whether that is too old."""
    counts = items.agg(F.count("*").alias("items"), F.count_if(F.col("publish_decision") == "publish").alias("published"), F.count_distinct("mode").alias("modes"), F.min("mode").alias("mode"))
    good = F.col("status").isin("success", "partial")
    last = runs.agg(F.max_by("status", "id").alias("run_status"), F.max_by(F.when(good, F.col("finished_at")), F.when(good, F.col("id"))).alias("last_good"))
    stale = F.col("last_good").isNull() | (F.unix_seconds(as_of) - F.unix_seconds("last_good") > stale_hours * 3600)
    mode = F.when(F.col("modes") == 0, "rules").when(F.col("modes") == 1, F.col("mode")).otherwise("mixed")
    return counts.crossJoin(last).select("items", "published", mode.alias("mode"), F.coalesce("run_status", F.lit("never")).alias("run_status"), "last_good", stale.alias("stale"))


def public_signals(signals: DataFrame) -> DataFrame:
    """Signals without what is internal: no relevance, no ids of sources. ``sources``: array of struct with source_id, url, layer."""
    return signals.drop("relevance_score").withColumn("sources", F.transform("sources", lambda s: s.dropFields("source_id")))


def publish(df: DataFrame, issues: int) -> str | None:
    """The path of a new snapshot, or None where issues forbid it. A version is never overwritten."""
    if issues:
        return None
    path = new_path(df.sparkSession, "snapshot")
    df.write.parquet(path)
    return path


def gated(df: DataFrame, *gates: DataFrame) -> DataFrame:
    """The snapshot as it was written, or no rows of its kind where any gate holds an issue."""
    path = publish(df, sum(0 if gate.isEmpty() else 1 for gate in gates))
    return df.limit(0) if path is None else df.sparkSession.read.schema(df.schema).parquet(path)


def read_concepts(raw: DataFrame) -> DataFrame:
    """Concepts of an older snapshot (JSON text in ``body``) with every field in place: names, stages, lists, and scores in 0 to 100."""
    schema = "slug string, name string, canonicalName string, stage string, heat double, temperature double, maturity double, aliases array<string>, relations array<struct<target:string>>, relationships array<struct<target:string>>"
    c = raw.select(F.from_json("body", schema).alias("c")).filter(F.col("c.slug").isNotNull()).select("c.*")
    bounded = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    return c.select(
        "slug", F.coalesce("canonicalName", "name").alias("name"), F.coalesce("stage", F.lit("candidate")).alias("stage"), bounded(F.coalesce("heat", "temperature", F.lit(0.0))).alias("heat"), F.when(F.col("maturity").isNotNull(), bounded(F.col("maturity"))).alias("maturity"),
        F.size(F.coalesce("aliases", F.array().cast("array<string>"))).alias("aliases"), F.size(F.coalesce("relationships", "relations", F.array().cast("array<struct<target:string>>"))).alias("relations"),
    )


def local_day(time: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(time, zone))


def new_today(concepts: DataFrame, as_of: Column, most: int = 3) -> DataFrame:
    """Concepts created on the local day, newest first."""
    return concepts.filter(local_day(F.col("created_at")) == local_day(as_of)).orderBy(F.desc("created_at"), "slug").limit(most)


def revised_today(revisions: DataFrame, as_of: Column, most: int = 3) -> DataFrame:
    """The latest material revision, beyond the first, of each concept on the local day; newest first."""
    today = revisions.filter((F.col("revision") > 1) & F.col("material") & (local_day(F.col("at")) == local_day(as_of)))
    last = today.groupBy("slug").agg(F.max(F.struct("at", "revision")).alias("r")).select("slug", "r.*")
    return last.orderBy(F.desc("at"), F.desc("revision"), "slug").limit(most)


def recent(time: Column, as_of: Column, days: int = 7) -> Column:
    return (time <= as_of) & (time >= as_of - F.make_dt_interval(F.lit(days)))


def warming(revisions: DataFrame, as_of: Column, most: int = 3) -> DataFrame:
    """Concepts by the sum of their heat's increases in a week, then the largest, then the latest; without an increase none."""
    step = F.greatest(F.col("heat_after") - F.col("heat_before"), F.lit(0.0))
    rows = revisions.filter(recent(F.col("at"), as_of)).withColumn("step", step).filter("step > 0")
    sums = rows.groupBy("slug").agg(F.sum("step").alias("total"), F.max("step").alias("largest"), F.max("at").alias("latest"))
    return sums.orderBy(F.desc("total"), F.desc("largest"), F.desc("latest"), "slug").limit(most)


def contested(evidence: DataFrame, revisions: DataFrame, as_of: Column, most: int = 3) -> DataFrame:
    """Concepts by the newest published conflict, or material revision of their controversies, within a week."""
    conflicts = evidence.filter((F.col("stance") == "conflict") & (F.col("publish_decision") == "publish") & recent(F.col("published_at"), as_of)).select("slug", F.col("published_at").alias("at"))
    changes = revisions.filter((F.col("revision") > 1) & F.col("material") & F.col("controversial") & recent(F.col("at"), as_of)).select("slug", "at")
    return conflicts.unionByName(changes).groupBy("slug").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "slug").limit(most)


def learning_priority(concepts: DataFrame, events: DataFrame, as_of: Column, most: int = 3) -> DataFrame:
    """Concepts with anything new in a week, by heat, 18 for a delta of the day, less 0.15 of the maturity (50 where unknown)."""
    fresh = events.filter(recent(F.col("at"), as_of)).groupBy("slug").agg(F.max("at").alias("at"))
    score = F.col("heat") + F.when(F.coalesce("daily_delta", F.lit("")) != "", 18).otherwise(0) - F.coalesce("maturity", F.lit(50.0)) * 0.15
    return concepts.join(fresh, "slug").select("slug", F.round(score, 3).alias("priority"), "at").orderBy(F.desc("priority"), F.desc("at"), "slug").limit(most)


def filtered_concepts(concepts: DataFrame, stage: str = "all", theme: str = "all") -> DataFrame:
    """Formal concepts of a stage and a theme."""
    rows = concepts.filter(~F.lower("stage").isin("candidate", "archived"))
    rows = rows if stage == "all" else rows.filter(F.lower("stage") == stage.lower())
    return rows if theme == "all" else rows.filter(F.array_contains("themes", theme))


def filtered_signals(signals: DataFrame, topic: str = "all", stage: str = "all") -> DataFrame:
    """Signals of a topic and a stage, the first of them marked as ``lead``."""
    rows = signals if topic == "all" else signals.filter(F.col("topic") == topic)
    rows = rows if stage == "all" else rows.filter(F.col("stage") == stage)
    first = rows.agg(F.min("place").alias("first"))
    return rows.join(F.broadcast(first)).withColumn("lead", F.col("place") == F.col("first")).drop("first")


def related_signals(asked: DataFrame, redirects: DataFrame, signals: DataFrame) -> DataFrame:
    """(asked, concept, signal, sources): signals of each asked concept, after its redirect, by concept, slug or the slug's beginning.

    A signal's slug begins with its concept's and a dash; all beginnings of a slug are its own rows, so that this is a join by key.
    """
    to = asked.join(redirects, asked["slug"] == redirects["from_slug"], "left").select(F.col("slug").alias("asked"), F.coalesce("into_slug", "slug").alias("concept"))
    parts = F.split("signal_slug", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "-"))
    named = signals.select("signal_slug", F.explode(F.array_union(prefixes, F.array("concept_slug"))).alias("concept"), "url")
    return to.join(named, "concept").groupBy("asked", "concept", F.col("signal_slug").alias("signal")).agg(F.count_distinct("url").alias("sources"))


def claim_ledger(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(slug, key, url, label): each claim's safe evidence once, by its title or else its host; a claim without any has a null url."""
    urls = claims.select("slug", "key", F.explode_outer(F.filter(F.array_distinct("urls"), lambda u: F.startswith(u, F.lit("https://")))).alias("url"))
    titles = evidence.groupBy("slug", "url").agg(F.min(F.trim("title")).alias("title"))
    host = F.regexp_extract("url", "^https://([^/?#]+)", 1)
    return urls.join(titles, ["slug", "url"], "left").select("slug", "key", "url", F.when(F.col("url").isNotNull(), F.coalesce(F.nullif("title", F.lit("")), host)).alias("label"))


def field_citations(citations: DataFrame, fields: list[str]) -> DataFrame:
    """(slug, url) of what bears any of the fields, once each."""
    return citations.filter(F.col("field").isin(*fields)).select("slug", F.explode("urls").alias("url")).distinct()


def graph_nodes(edges: DataFrame) -> DataFrame:
    """(node, first, degree) of the nodes of edges (place, source, target), in order of appearance; self loops are no edges."""
    real = edges.filter(F.col("source") != F.col("target"))
    ends = real.select(F.struct(F.col("place").alias("place"), F.lit(0).alias("end")).alias("at"), F.col("source").alias("node")).unionByName(real.select(F.struct(F.col("place").alias("place"), F.lit(1).alias("end")).alias("at"), F.col("target").alias("node")))
    return ends.groupBy("node").agg(F.min("at").alias("at"), F.count("*").alias("degree")).select("node", F.col("at.place").alias("first"), "degree")


def scaled_models(models: DataFrame) -> DataFrame:
    """Adds x (cost on a log scale), y (score) and size (0 to 1) within the table's own ranges, whose floors are fixed."""
    ends = models.agg(
        F.greatest(F.lit(0.001), F.least(F.min("cost"), F.lit(0.01)) * 0.72).alias("c0"), F.greatest(F.lit(1.0), F.greatest(F.max("cost"), F.lit(1.0)) * 1.32).alias("c1"),
        F.greatest(F.lit(0.0), F.floor(F.least(F.min("coding"), F.lit(0.0)) / 10) * 10).alias("k0"), F.greatest(F.lit(10.0), F.ceil(F.greatest(F.max("coding"), F.lit(10.0)) / 10) * 10).alias("k1"),
        F.least(F.min("intelligence"), F.lit(0.0)).alias("i0"), F.greatest(F.max("intelligence"), F.lit(1.0)).alias("i1"),
    )
    share = lambda v, a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - a) / (b - a)))
    rows = models.join(F.broadcast(ends))  # one row
    return rows.select(*models.columns, F.round(share(F.ln("cost"), F.ln("c0"), F.ln("c1")), 6).alias("x"), F.round((F.col("coding") - F.col("k0")) / (F.col("k1") - F.col("k0")), 6).alias("y"), F.round(share(F.col("intelligence"), F.col("i0"), F.col("i1")), 6).alias("size"))


def diverse_top(models: DataFrame, most: int) -> DataFrame:
    """The best models: first the best of each provider, within a budget of providers, then the best of all others.

    Reads id, provider, cost, coding and intelligence.
    """
    affordable = F.greatest(F.lit(0.0), -F.log10(F.greatest("cost", F.lit(0.001))))
    scored = models.withColumn("priority", F.round(F.col("coding") * 0.58 + F.col("intelligence") * 0.34 + affordable * 3.2, 9))
    order = [F.desc("priority"), F.desc("coding"), F.desc("intelligence"), F.asc("cost"), F.asc("id")]
    budget = min(10, max(4, -(-most * 11 // 20)))
    own = scored.withColumn("nth", F.row_number().over(Window.partitionBy("provider").orderBy(*order)))
    leaders = own.filter("nth = 1").orderBy(*order).limit(min(budget, most)).select("id", F.lit(0).alias("kind"))
    rest = scored.orderBy(*order).limit(most + budget).join(leaders.select("id"), "id", "left_anti").withColumn("kind", F.lit(1))
    both = scored.join(leaders, "id").unionByName(rest.select(*scored.columns, "kind"))
    return both.orderBy("kind", *order).limit(most).drop("kind")


def grouped_tail(counts: DataFrame, name: str, most: int = 13, other: str = "Other") -> DataFrame:
    """(name, n): the largest categories, and all others as one; only the largest are ever sorted."""
    top = counts.orderBy(F.desc("n"), name).limit(most)
    rest = counts.join(top.select(name), name, "left_anti").agg(F.sum("n").alias("n")).filter("n IS NOT NULL")
    return top.select(name, "n").unionByName(rest.select(F.lit(other).alias(name), "n"))
