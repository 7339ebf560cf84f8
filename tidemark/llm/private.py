"""Personal data by weak supervision, with column expressions alone.

Loose patterns propose candidates of seven kinds. Five labelers vote on each (private, not private, no opinion):

* regex: the strict pattern of the kind and its checks (digits, Luhn, parts at most 255, valid areas)
* gazetteer: calling codes, card issuers, mail domains, key prefixes, lands of account numbers
* context: cue words in the characters before
* borders: does the candidate stand free, or inside a longer word or number
* variety: how many different characters it has

Candidates with equal votes are one row with a count, at most 7 * 3^5 of them. Expectation-maximisation over those rows
estimates how often each labeler casts each vote on private and on other candidates, and each kind's share of
private ones, starting from the majority. The posteriors are soft labels for the final span classifier, a naive Bayes
model per kind over what the labelers do not count: length, digits, separators, neighbours, letters' case, place in the text.
Each iteration is one aggregate over the vote rows; the classifier is one more over all candidates, and both models are tables of fixed
size. Strict matches always stay; the classifier adds candidates that touch none of them.

A text is read once. Positions come from the pieces between matches (``split``) and the matches themselves, added up in
chunks, so that a text with very many matches stays near linear. All quantifiers that could step back over a long
run are possessive or anchored at its beginning, so no text makes a pattern quadratic or deep in the stack.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import materialize

KINDS = ("email", "ip", "card", "phone", "id", "iban", "credential")
BASE_KINDS = KINDS[:4]
LABELERS = ("regex", "gazetteer", "context", "borders", "variety")
FEATURES = ("length", "digits", "separators", "before", "after", "case", "edge", "check")
#: First guess at the share of each labeler's votes -1, 0, 1 on private and on other candidates: a failed check says most. The data correct it.
GUESS = (
    ((0.01, 0.29, 0.70), (0.95, 0.03, 0.02)),
    ((0.20, 0.45, 0.35), (0.35, 0.45, 0.20)),
    ((0.10, 0.50, 0.40), (0.30, 0.50, 0.20)),
    ((0.20, 0.30, 0.50), (0.35, 0.30, 0.35)),
    ((0.15, 0.40, 0.45), (0.25, 0.40, 0.35)),
)
SMOOTHING = 16.0  # each sort's values count so many candidates with the values of both, so that what neither has seen says nothing
GUESS_WEIGHT = 3.0  # the guess counts as so many candidates of either sort
VALUES = 16
CHUNK = 512
CONTEXT_CHARS = 40
ITERATIONS = 12

LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"

#: The given patterns, with possessive quantifiers where stepping back cannot change the match.
STRICT = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?<!{LOCAL}){LOCAL}++(?:@{HOST}++(?:\.{HOST}++)++|\s?[\[({{]\s?(?:at|AT)\s?[\])}}]\s?{HOST}++(?:\s?(?:\.|[\[({{]\s?(?:dot|DOT)\s?[\])}}])\s?{HOST}++)++|\s(?:at|AT)\s{HOST}++(?:\s(?:dot|DOT)\s{HOST}++)++)",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]?+){3}[0-9]{4}(?![0-9])|(?<![0-9])3[47][0-9]{2}[\x20-]?+[0-9]{6}[\x20-]?+[0-9]{5}(?![0-9])",
    "phone": r"(?:(?<![0-9])(?:\+|00)[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|(?<![0-9])[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "credential": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?:password|passwd|pwd|secret|token|api_key|apikey)\s?[=:]\s?[^\s\"']{6,200}+|(?:ghp_|sk-|xox[bp]-)[A-Za-z0-9_-]{16,200}+)|\"[0-9a-z]{32,64}\"",
}
#: A text without these holds no candidate of the kind; digits stand for all kinds but e-mail.
DIGIT, MAIL, KEY = "[0-9]", r"@|[\[({]\s?(?:at|AT)\s?[\])}]|\s(?:dot|DOT)\s", "AKIA|[=:]|ghp_|sk-|xox|\"[0-9a-z]{32}"

# fixed values: word lists of the gazetteer and of the context
CALLING_CODES = "1|7|20|27|3[0-4]|36|39|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "4|5[1-5]|2[2-7]|3[0-68-9]|3[47]|6011|65"
MAIL_DOMAINS = r"(?:gmail|yahoo|hotmail|outlook|icloud|gmx|web|mail[0-9]*|example)\."
KEY_PREFIXES = "AKIA|ghp_|sk-|xox|password|passwd|pwd|secret|token|api"
LANDS = "AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|GR|HU|IE|IT|LU|NL|NO|PL|PT|RO|SE"
RESERVED_NETS = "0|10|127|255|22[4-9]|23[0-9]"
CUES = r"(?i)\b(?:e-?mail|mail|contact|reach|write|phone|tel|telephone|call|mobile|cell|fax|whatsapp|card|visa|mastercard|amex|ssn|social security|iban|account|ip|address|host|from|password|passwd|pwd|secret|token|key|login|user)\b"
OTHER_CUES = r"(?i)\b(?:version|release|isbn|issn|doi|page|figure|table|section|chapter|total|sum|order|invoice|serial|population|year|ratio|score)\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str, gate: Column, keep: Callable[[Column], Column], made: Callable[[Column], Column], kind: str) -> Column:
    """Array of ``made(m)`` for each leftmost non-overlapping match that ``keep`` accepts; m has s, start, end, before and after, in code points."""
    all_matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(pieces: Column, found: Column) -> Column:
        nth = F.arrays_zip(found.alias("s"), F.slice(pieces, F.lit(1), F.size(found)).alias("gap"), F.slice(pieces, F.lit(2), F.size(found)).alias("next"))
        items = F.transform(nth, lambda x: F.struct(x["s"].alias("s"), F.length(x["gap"]).alias("gap"), F.length(x["s"]).alias("size"), F.right(x["gap"], F.lit(CONTEXT_CHARS)).alias("before"), F.left(x["next"], F.lit(1)).alias("after")))
        return let(items, lambda it: let(chunks(it), sweep))

    def chunks(items: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(items) - 1) / CHUNK).cast("int")), lambda c: F.slice(items, c * CHUNK + 1, F.lit(CHUNK)))

    def sweep(parts: Column) -> Column:
        total = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(parts, start, lambda a, part: F.struct((a["at"] + total(part)).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
        return let(starts, lambda s: F.flatten(F.transform(parts, lambda part, i: inside(part, F.get(s, i)))))

    def inside(part: Column, at: Column) -> Column:
        none = F.array().cast(f"array<{kind}>")

        def step(a: Column, x: Column) -> Column:
            begin = a["at"] + x["gap"]
            m = F.struct(x["s"].alias("s"), begin.alias("start"), (begin + x["size"]).alias("end"), x["before"].alias("before"), x["after"].alias("after"))
            out = let(m, lambda m: F.when(keep(m), F.array_append(a["out"], made(m))).otherwise(a["out"]))
            return F.struct((begin + x["size"]).alias("at"), out.alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])

    found = let(F.when(gate, all_matches), lambda f: F.when(F.size(f) > 0, let(F.split(text, pattern, -1), lambda pieces: placed(pieces, f))))
    return F.coalesce(found, F.array().cast(f"array<{kind}>"))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    values = F.transform(F.split(F.reverse(number), ""), lambda d, i: let(d.cast("int") * (1 + i % 2), lambda x: x - F.when(x > 9, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def is_card(s: Column) -> Column:
    return let(digits(s), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


def is_phone(s: Column) -> Column:
    return F.length(digits(s)).between(10, 15)


def is_ip(s: Column) -> Column:
    return s.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?(?:\.|\z)){4}\z")


STRICT_CHECKS = {"email": lambda s: F.lit(True), "ip": is_ip, "card": is_card, "phone": is_phone}


def vote(yes: Column, no: Column) -> Column:
    """1, -1 or 0 (no opinion, also where neither is known)."""
    return F.when(yes, 1).when(no, -1).otherwise(0)


def regex_vote(kind: str, s: Column) -> Column:
    if kind == "email":
        return vote(s.rlike(rf"\A{LOCAL}++@{HOST}++(?:\.{HOST}++)++\z"), F.lit(False))
    if kind == "ip":
        return vote(is_ip(s), s.contains("."))
    if kind == "card":
        return vote(is_card(s), ~is_card(s))
    if kind == "phone":
        return vote(is_phone(s) & s.startswith("+"), ~F.length(digits(s)).between(9, 15))
    if kind == "id":
        return vote(~s.rlike(r"^(?:000|666|9)|-00-|-0000\z"), F.lit(True))
    if kind == "iban":
        return vote(F.length(F.regexp_replace(s, " ", "")).between(15, 34), F.lit(True))
    return vote(s.rlike("[0-9]") & s.rlike("[A-Za-z]"), F.lit(True))


def gazetteer_vote(kind: str, s: Column) -> Column:
    if kind == "email":
        return vote(s.rlike(rf"(?i)[@\s\])}}]{MAIL_DOMAINS}") | s.rlike(r"(?i)(?:com|org|net|edu|de|fr|es|it|uk)\z"), F.lit(False))
    if kind == "ip":
        return vote(F.lit(False), s.rlike(rf"^(?:{RESERVED_NETS})\."))
    if kind == "card":
        return vote(s.rlike(f"^(?:{ISSUERS})"), F.lit(False))
    if kind == "phone":
        return vote(s.rlike(rf"^(?:\+|00)(?:{CALLING_CODES})"), s.startswith("+"))
    if kind == "iban":
        return vote(s.rlike(f"^(?:{LANDS})"), F.lit(True))
    return vote(s.rlike(KEY_PREFIXES), F.lit(False))


def votes(kind: str, m: Column) -> list[Column]:
    s = m["s"]
    free = (F.coalesce(F.right(m["before"], F.lit(1)), F.lit("")).rlike(r"^[\s(\[\"'<:,;=]?\z")) & m["after"].rlike(r"^[\s)\]\"'>:,;.!?]?\z")
    variety = F.size(F.array_distinct(F.split(F.regexp_replace(s, "[^0-9A-Za-z]", ""), "")))
    return [regex_vote(kind, s), gazetteer_vote(kind, s), vote(m["before"].rlike(CUES), m["before"].rlike(OTHER_CUES)), vote(free, m["after"].rlike(r"^[\w]")), vote(variety >= 5, variety <= 2)]


def char_class(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[0-9]"), 2).when(c.rlike("^[A-Za-z]"), 3).when(c.rlike(r"^[.,;:!?]"), 4).when(c.rlike(r"^[\"'()\[\]{}<>]"), 5).otherwise(6)


def features(kind: str, m: Column) -> list[Column]:
    """Each from 0 to VALUES - 1, in the order of FEATURES."""
    s = m["s"]
    flags = [(s.contains(" "), 1), (s.contains("-"), 2), (s.contains("."), 4), (s.rlike(r"[()@=:]"), 8)]
    return [
        F.least(F.floor(F.length(s) / 4), F.lit(VALUES - 1)), F.least(F.length(digits(s)), F.lit(VALUES - 1)), sum((F.when(c, n).otherwise(0) for c, n in flags), F.lit(0)),
        char_class(F.right(m["before"], F.lit(1))), char_class(m["after"]), F.when(s.rlike("[A-Z]"), 1).otherwise(0) + F.when(s.rlike("[a-z]"), 2).otherwise(0), F.when(m["start"] == 0, 0).when(m["after"] == "", 1).otherwise(2), regex_vote(kind, s) + 1,
    ]


SPAN = "struct<start: int, kind: int, end: int>"
CANDIDATE = "struct<start: int, kind: int, end: int, votes: int, features: array<int>>"


def scanned(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, base, candidates) of every row: spans of the strict patterns, and what the loose ones propose with votes (in base 3) and features."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(id_column, text.alias("text")).withColumns({"has_digit": F.col("text").rlike(DIGIT), "has_mail": F.col("text").rlike(MAIL), "has_key": F.col("text").rlike(KEY)})
    gate = lambda kind: F.col("has_mail" if kind == "email" else "has_key" if kind == "credential" else "has_digit")
    text = F.col("text")

    def span(n: int) -> Callable[[Column], Column]:
        return lambda m: F.struct(m["start"].alias("start"), F.lit(n).alias("kind"), m["end"].alias("end"))

    def candidate(n: int) -> Callable[[Column], Column]:
        def made(m: Column) -> Column:
            code = F.lit(0)
            for v in votes(KINDS[n], m):
                code = code * 3 + v + 1
            return F.struct(m["start"].alias("start"), F.lit(n).alias("kind"), m["end"].alias("end"), code.cast("int").alias("votes"), F.array(*[f.cast("int") for f in features(KINDS[n], m)]).alias("features"))

        return made

    strict = [matches(text, STRICT[k], gate(k), lambda m, k=k: STRICT_CHECKS[k](m["s"]), span(n), SPAN) for n, k in enumerate(BASE_KINDS)]
    loose = [matches(text, LOOSE[k], gate(k), lambda m: F.lit(True), candidate(n), CANDIDATE) for n, k in enumerate(KINDS)]
    return rows.select(id_column, F.array_sort(F.concat(*strict)).alias("base"), F.array_sort(F.concat(*loose)).alias("candidates"))


def with_votes(candidates: DataFrame) -> DataFrame:
    """Columns v0, v1, ... instead of the code: 0, 1, 2 for a labeler's vote -1, 0, 1."""
    cast = {f"v{i}": F.expr(f"votes DIV {3 ** (len(LABELERS) - 1 - i)} % 3").cast("int") for i in range(len(LABELERS))}
    return candidates.withColumns(cast).drop("votes")


def posterior(model: dict[str, list]) -> Column:
    """Probability that a candidate of this kind with these votes is private."""
    numbers = lambda xs: "array(" + ", ".join(f"{x:.17g}D" for x in xs) + ")"
    terms = [f"get({numbers(model['prior'])}, kind)"]
    for i, of_labeler in enumerate(model["votes"]):
        ratios = [math.log(p / q) for yes, no in of_labeler for p, q in zip(yes, no, strict=True)]  # kind by kind
        terms.append(f"get({numbers(ratios)}, kind * 3 + v{i})")
    return F.expr(f"1 / (1 + exp(-({' + '.join(terms)})))")


def reliabilities(patterns: DataFrame, iterations: int = ITERATIONS) -> dict[str, list]:
    """Expectation-maximisation over (kind, v0, v1, ..., n): prior log odds of each kind, and for each labeler and kind the shares of its votes on private and on other candidates, among those where it has an opinion; none says nothing.

    ``votes[labeler][kind]`` is ((share of -1, 0, 1 on private), (the same on others)). A row for each kind comes back an iteration.
    """
    model = {"prior": [0.0] * len(KINDS), "votes": [[[(no, 1.0, yes) for no, _, yes in guess]] * len(KINDS) for guess in GUESS]}
    sorts = ("n * p", "n * (1 - p)")
    sums = [f"sum({x}) AS all{y}" for y, x in enumerate(sorts)]
    sums += [f"sum(IF(v{i} = {v}, {x}, 0)) AS c{i}{v}{y}" for i in range(len(LABELERS)) for v in range(3) for y, x in enumerate(sorts)]
    for _ in range(iterations):
        found = {r.kind: r.asDict() for r in patterns.withColumn("p", posterior(model)).groupBy("kind").agg(*map(F.expr, sums)).collect()}
        total = lambda k, name: found.get(k, {}).get(name) or 0.0
        shares = [[[[total(k, f"c{i}{v}{y}") + GUESS_WEIGHT * guess[y][v] for v in range(3)] for y in range(2)] for k in range(len(KINDS))] for i, guess in enumerate(GUESS)]
        model = {
            "prior": [math.log((total(k, "all0") + 1) / (total(k, "all1") + 1)) for k in range(len(KINDS))],
            "votes": [[[[row[0] / (row[0] + row[2]), 1.0, row[2] / (row[0] + row[2])] for row in of_kind] for of_kind in of_labeler] for of_labeler in shares],
        }
    return model


def span_weights(candidates: DataFrame, model: dict[str, list]) -> list[float]:
    """Naive Bayes log ratios of (kind, feature, value) from the posteriors as soft labels, in one list; at most kinds * features * VALUES rows come back."""
    labelled = candidates.select("kind", posterior(model).alias("p"), F.posexplode("features").alias("feature", "value"))
    counts = labelled.groupBy("kind", "feature", "value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    seen = {(r.kind, r.feature, r.value): (r.yes, r.no) for r in counts.collect()}
    weights = []
    for k in range(len(KINDS)):
        for f in range(len(FEATURES)):
            counts = [seen.get((k, f, v), (0.0, 0.0)) for v in range(VALUES)]
            totals = [sum(c[y] for c in counts) for y in range(2)]
            for c in counts:
                both = SMOOTHING * (c[0] + c[1] + 1) / (totals[0] + totals[1] + VALUES)
                weights.append(math.log((c[0] + both) / (totals[0] + SMOOTHING) / ((c[1] + both) / (totals[1] + SMOOTHING))))
    return weights


def classified(candidates: Column, model: dict[str, list], weights: list[float]) -> Column:
    """The candidates that the span classifier takes for private, as spans."""
    prior, table = F.array(*map(F.lit, model["prior"])), F.lit(weights)
    score = lambda c: F.aggregate(F.transform(c["features"], lambda v, f: F.get(table, (c["kind"] * len(FEATURES) + f) * VALUES + v)), F.get(prior, c["kind"]), lambda a, x: a + x)
    return F.transform(F.filter(candidates, lambda c: score(c) >= 0), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))


def untouched(base: Column, added: Column) -> Column:
    """Those of ``added`` that share no character with a span of ``base``: one sweep from the left, one from the right."""
    mark = lambda spans, own: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["kind"].alias("kind"), x["end"].alias("end")))
    both = F.array_sort(F.concat(mark(base, 0), mark(added, 1)))
    none = F.array().cast("array<struct<start: int, own: int, kind: int, end: int>>")
    left = F.aggregate(
        both, F.struct(F.lit(0).alias("reach"), none.alias("out")),
        lambda a, x: F.struct(F.when(x["own"] == 0, F.greatest(a["reach"], x["end"])).otherwise(a["reach"]).alias("reach"), F.when((x["own"] == 0) | (x["start"] >= a["reach"]), F.array_append(a["out"], x)).otherwise(a["out"]).alias("out")),
        lambda a: F.reverse(a["out"]),
    )
    right = F.aggregate(
        left, F.struct(F.lit((1 << 31) - 1).alias("next"), none.alias("out")),
        lambda a, x: F.struct(F.when(x["own"] == 0, x["start"]).otherwise(a["next"]).alias("next"), F.when((x["own"] == 1) & (x["end"] <= a["next"]), F.array_append(a["out"], x)).otherwise(a["out"]).alias("out")),
        lambda a: a["out"],
    )
    return F.transform(right, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, base, spans) of every row: spans of the strict patterns, and those with what the method adds, as arrays of (start, kind, end).

    ``kind`` is a place in KINDS, positions are code points, ends are exclusive; spans are sorted by start, then kind. A null text counts as empty. Repeated rows and null ids
    each give their own row; an empty table gives an empty result and other columns are not read. What is stored in between has spans, votes and features, no text.
    """
    rows = materialize(scanned(docs, id_column, text_column), "private-candidates")
    each = rows.filter(F.size("candidates") > 0).select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    each = with_votes(each)
    patterns = materialize(each.groupBy("kind", *[f"v{i}" for i in range(len(LABELERS))]).agg(F.count("*").alias("n")), "private-votes")
    model = reliabilities(patterns)
    weights = span_weights(each, model)
    added = F.when(F.size("candidates") > 0, untouched(F.col("base"), classified(F.col("candidates"), model, weights))).otherwise(F.array().cast(f"array<{SPAN}>"))
    return rows.select(id_column, "base", F.array_sort(F.concat("base", added)).alias("spans"))


def span_lines(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["start"], F.lit(":"), x["end"])), ",")
