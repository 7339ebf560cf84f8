"""Queries opN_<name> and their SQL, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, chat, classlm, exact, langid, lines, mixing, negatives, periodic, private, quality, shards, simhash
from tidemark.llm.common import documents


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), vocabulary_path())


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(documents(spark, sf_dir))


def op3_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.score_documents(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir).select("doc_id", "source"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_languages(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("SELECT -7L AS conv_id, CAST(id AS BIGINT) AS turn, IF(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_trees(chat.chain(given.unionByName(own))))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.deduplicate_lines(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.personal_data(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(private.BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(private.span_lines(F.col("base")), 256).alias("base_sha256"), private.span_lines(F.col("spans")).alias("spans"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before the search, a tenth of the documents is made periodic, as the contract has it."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = documents(spark, sf_dir).select("doc_id", "text", (crc % 10 == 0).alias("planted"), F.floor(crc / 10).alias("g"))
    docs = docs.withColumn("ws", F.when(F.col("planted"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    docs = docs.withColumn("a", F.expr("CASE WHEN size(ws) > 0 THEN g % size(ws) END")).withColumn("p", F.expr("1 + (size(ws) - a) DIV (3 + g % 8)"))
    repeated = F.expr("array_join(transform(ws, (w, i) -> IF(i < a, w, ws[CAST(a + (i - a) % p AS INT)])), ' ')")
    found = periodic.periodic_runs(docs.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text")))
    best = periodic.strongest(F.col("runs"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
        F.call_function("div", 1000 * best["length"], best["period"]).alias("exponent_milli"),
        F.sha2(periodic.run_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return negatives.hard_negatives(rows.withColumn("label", F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_shards": op2_shards,
    "op3_class_lm": op3_class_lm,
    "op4_mixing": op4_mixing,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_chat": op9_chat,
    "op10_line_dedup": op10_line_dedup,
    "op11_private": op11_private,
    "op12_periodic": op12_periodic,
    "op13_hard_negatives": op13_hard_negatives,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

METRIC_ROWS = ", ".join(f"('{m}', ({scale} * {a} // greatest({b}, 1))::BIGINT)" for m, (a, b, scale, _) in quality.METRICS.items())
SLACKS = " ".join(f"WHEN '{m}' THEN {spec[3]}" for m, spec in quality.METRICS.items())


def _limits(keys: str, name: str) -> str:
    """Thresholds of merged sketches, as CTEs ``name``."""
    return f"""
{name}_m AS (SELECT {keys}, metric, bucket, sum(n) AS n FROM sk GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {keys}, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}, metric) AS total FROM {name}_m),
{name}_q AS (SELECT {keys}, metric, max(total) AS docs, min(bucket) FILTER (WHERE 2 * upto >= total) AS q50, min(bucket) FILTER (WHERE 4 * upto >= 3 * total) AS q75
           FROM {name}_r GROUP BY ALL),
{name} AS (SELECT {keys}, metric, docs, q50 + greatest(CASE metric {SLACKS} END, {quality.SPREAD} * (q75 - q50)) AS lim FROM {name}_q)"""


ORACLES: dict[str, str] = {
    "op6_quality": f"""
WITH w AS (SELECT doc_id, lang, source, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
win AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM tri) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS s(o) GROUP BY doc_id),
q AS (SELECT w.doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
      length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
      coalesce(cov.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(coalesce(text, ''), '[^!?]', '', 'g')) AS n_marks,
      length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS n_capitals FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM q),
v AS (SELECT doc_id, lang, source, metric, x FROM b, LATERAL (VALUES {METRIC_ROWS}) AS m(metric, x) WHERE NOT base_failed),
sk AS (SELECT lang, source, 1 AS everything, metric, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) AS bucket, count(*) AS n FROM v GROUP BY ALL),
{_limits("lang, source", "pl")},
{_limits("lang", "ll")},
{_limits("everything", "al")},
lim AS (SELECT pl.lang, pl.source, pl.metric, CASE WHEN pl.docs >= {quality.MIN_GROUP} THEN pl.lim WHEN ll.docs >= {quality.MIN_GROUP} THEN ll.lim ELSE al.lim END AS lim
        FROM pl JOIN ll ON pl.lang IS NOT DISTINCT FROM ll.lang AND pl.metric = ll.metric JOIN al ON pl.metric = al.metric),
bad AS (SELECT DISTINCT doc_id FROM v JOIN lim ON v.lang IS NOT DISTINCT FROM lim.lang AND v.source IS NOT DISTINCT FROM lim.source AND v.metric = lim.metric WHERE x > lim)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM b LEFT JOIN bad ON b.doc_id = bad.doc_id
""",
    "op8_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
""",
    "op9_chat": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(role, '\', '\b'), '<|', '\o'), '|>', '\c') AS role_out,
             replace(replace(replace(text, '\', '\b'), '<|', '\o'), '|>', '\c') AS text_out FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(role_out) + length(text_out) + 16)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""".replace("\\\\", "\\"),
    "op10_line_dedup": f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM cut),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, max(doc_id) AS owner FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(s.owner <> k.doc_id, false) AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
}
