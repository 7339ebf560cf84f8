"""Column expressions over texts and addresses."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query parameters that only track a visitor, besides all that begin with ``utm_``.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "source", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term")

#: Hosts that are no public address, by name and by range.
LOCAL_NAMES = r"^(localhost|.*\.localhost|.*\.local|.*\.internal|metadata\.google)$"
UNSAFE_IN_PATH, UNSAFE_IN_QUERY = r"""[^!-~]|["<>`{}]""", r"""[^!-~]|["'<>]"""
IPV4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
BLOCKED_IPV4 = (
    r"^(0|10|127|22[4-9]|2[3-9]\d)\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^169\.254\.|^172\.(1[6-9]|2\d|3[01])\.|^192\.0\.[02]\."
    r"|^192\.88\.99\.|^192\.168\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\."
)
BLOCKED_IPV6 = r"^\[(::|::1|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*|2001:db8:.*|::(ffff:)?[0-9a-f.:]*)\]$"

#: Classes of failure in the order they are tried, with what tells them.
FAILURES = (
    ("provider-auth", r"(?i)HTTP\s+(401|403)\b|unauthorized|forbidden"),
    ("provider-rate-limit", r"(?i)HTTP\s+429\b|rate.?limit|限流"),
    ("provider-server-error", r"(?i)HTTP\s+5\d\d\b|insufficient_system_resource"),
    ("provider-transport", r"(?i)fetch failed|timeout|超时|ECONN|ENET|socket|network"),
    ("invalid-json", r"(?i)不是有效 JSON|invalid JSON|返回空|被截断|响应未完成"),
    ("chinese-editorial", r"(?i)中文|汉字|Chinese"),
    ("relation-contract", r"(?i)关系|relation|targetSlug"),
    ("theme-contract", r"(?i)theme|主题"),
    ("identity-contract", r"(?i)identityDecision|身份裁决|reuse-existing|create-new|needs-review"),
    ("evidence-contract", r"(?i)证据|evidence|引用|citation|链接|URL|原标题|originalTitle|supports"),
    ("claim-contract", r"(?i)claim|主张"),
    ("schema-contract", r"(?i)缺少|无效|必须|枚举|数组|对象|字段"),
)

#: Parts of a page that are no text, and entities in the order they are decoded.
UNREAD = ("script", "style", "noscript", "svg", "form", "nav", "footer")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

VERSION = r"(?i)(?<![A-Za-z0-9_])v?(\d+\.\d+(?:\.\d+)?)(?![A-Za-z0-9_])"
DAY = r"(?<![A-Za-z0-9_])(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})(?![A-Za-z0-9_])"
NAMED_DAY = r"(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?) (\d{1,2}), (20\d{2})"
PATH_DAY = r"/(20\d{2})/(\d{1,2})/(\d{1,2})(?:/|$)"
PATH_NAMED_DAY = r"/(20\d{2})/([A-Z][a-z]{2})/(\d{1,2})(?:/|$)"
HAN, KANA = r"\p{IsHan}", r"[\x{3040}-\x{30ff}\x{31f0}-\x{31ff}\x{ff66}-\x{ff9f}]"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def clean_html(html: Column, most: int) -> Column:
    """Text of a page: script, style, svg, nav, form and footer go, tags become spaces, space collapses, long texts are cut with an ellipsis."""
    bare = html
    for kind in UNREAD:
        bare = F.regexp_replace(bare, rf"(?is)<{kind}\b[^>]*>.*?</{kind}\s*>", " ")
    bare = F.regexp_replace(bare, r"<[^>]*>", " ")
    for entity, char in ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return clean_text(bare, most)


def clean_text(text: Column, most: int) -> Column:
    """Space collapses; a text of more than ``most`` characters is cut, with an ellipsis as the last one."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0b]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def tokens(title: Column) -> Column:
    """Distinct lower-case Latin tokens, and runs of two or more Han letters, without addresses."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower(title), r"https?://[^ \t\r\n]+", " "), F.lit(r"([a-z][a-z0-9+#.-]+|[\x{4e00}-\x{9fff}]{2,})")))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def version_key(title: Column) -> Column:
    """The x.y or x.y.z of a title, or null."""
    return F.nullif(F.regexp_extract(title, VERSION, 1), F.lit(""))


def alias_key(name: Column) -> Column:
    """Compatibility form (NFKC), lower case, letters and digits only."""
    return F.regexp_replace(F.lower(nfkc(name)), r"[^\p{L}\p{N}]+", "")


def candidate_slug(name: Column) -> Column:
    """Letters of the ASCII fold joined by dashes, 72 at most; a hash where fewer than three are left."""
    dashed = F.regexp_replace(F.lower(nfkd(name)), "[^a-z0-9]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 72), "-+$", "")
    return F.when(F.length(cut) >= 3, cut).otherwise(F.concat(F.lit("candidate-"), F.substring(F.sha2(nfkc(name), 256), 1, 12)))


def host_of(url: Column) -> Column:
    """Host of an https address without port, lower-cased, null if it has none or names a user."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https://(\[[^\]]*\]|[^/?#:@\\]*)(?::\d*)?(?:[/?#].*)?$", 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def blocked_host(host: Column) -> Column:
    """Whether a host is none, local, private or reserved."""
    numbers = [F.regexp_extract(host, IPV4, i).cast("string") for i in range(1, 5)]
    too_large = F.lit(False)
    for n in numbers:
        too_large |= F.coalesce(F.try_to_number(F.nullif(n, F.lit("")), F.lit("999")) > 255, F.lit(False))
    ipv4 = F.regexp_like(host, F.lit(IPV4)) & (too_large | F.regexp_like(host, F.lit(BLOCKED_IPV4)))
    return host.isNull() | F.regexp_like(host, F.lit(LOCAL_NAMES)) | ipv4 | F.regexp_like(host, F.lit(BLOCKED_IPV6))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it: keeps expressions, and so plans, small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encoded(part: Column, unsafe: str) -> Column:
    """Characters of the class ``unsafe`` as %XX of their UTF-8 bytes; what is encoded already stays."""
    char = lambda c: F.when(F.regexp_like(c, F.lit(unsafe)), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    return let(part, lambda p: F.when(F.regexp_like(p, F.lit(unsafe)), F.array_join(F.transform(F.split(p, ""), char), "")).otherwise(p))


def without_dots(path: Column) -> Column:
    """A path with its . and .. parts taken; those that would go above the root stay at it."""
    none = F.array().cast("array<string>")
    up = lambda held: F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))
    step = lambda held, s: F.when(s == "..", up(held)).when(s == ".", held).otherwise(F.array_append(held, s))
    plain = lambda s: let(F.replace(F.lower(s), F.lit("%2e"), F.lit(".")), lambda d: F.when(d.isin(".", ".."), d).otherwise(s))
    ends = lambda p: F.when(F.regexp_like(p, F.lit(r"(?i)/(\.|%2e){1,2}$")), F.concat(p, F.lit("/"))).otherwise(p)
    walked = lambda p: F.concat(F.lit("/"), F.array_join(F.aggregate(F.transform(F.split(F.regexp_replace(ends(p), "^/", ""), "/"), plain), none, step), "/"))
    return let(path, lambda p: F.when(F.regexp_like(p, F.lit(r"(?i)/(\.|%2e){1,2}(/|$)")), walked(p)).otherwise(p))


def dotted_ipv4(host: Column) -> Column:
    """A host that ends in a number, in the usual four parts: parts may be decimal, octal or hexadecimal and the last one may
    stand for several; null where it is no address after all. Any other host stays."""
    number = r"(0x[0-9a-f]{0,8}|0[0-7]{0,11}|[1-9]\d{0,9})"
    digits = lambda p: F.when(F.startswith(p, F.lit("0x")), F.conv(F.concat(F.lit("0"), F.substring(p, 3, 8)), 16, 10)).when(F.startswith(p, F.lit("0")), F.conv(p, 8, 10)).otherwise(p)
    # the last part counts for all bytes that the others leave, so in bytes from the left: one for each part but the last
    weight = lambda i: F.pow(F.lit(256.0), 3 - i).cast("long")

    def read(parts: Column) -> Column:
        head, last = F.slice(parts, 1, F.size(parts) - 1), F.element_at(parts, -1)
        total = F.aggregate(F.transform(head, lambda p, i: p * weight(i)), last, lambda a, x: a + x)
        written = let(total, lambda t: F.concat_ws(".", *[F.shiftright(t, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)]))
        return F.when(F.forall(head, lambda p: p <= 255) & (last < F.pow(F.lit(256.0), 5 - F.size(parts))), written)

    def form(h: Column) -> Column:
        address = F.when(F.regexp_like(h, F.lit(rf"^({number}\.){{0,3}}{number}$")), let(F.transform(F.split(h, r"\."), lambda p: digits(p).try_cast("long")), read))
        return F.when(F.regexp_like(h, F.lit(r"^(.*\.)?(\d+|0x[0-9a-f]*)$")), address).otherwise(h)

    return let(host, form)


def resolved_url(href: Column, page: Column) -> Column:
    """An address read against that of the page it stands on: whole, from the host, from the root, from the page's folder, or its query alone."""
    return let(F.trim(href), lambda h: let(page, lambda p: _resolved(h, p)))


def _resolved(href: Column, page: Column) -> Column:
    scheme, origin = F.regexp_extract(page, r"(?i)^([a-z]+:)", 1), F.regexp_extract(page, r"(?i)^([a-z]+://[^/?#]+)", 1)
    path = F.regexp_extract(page, r"(?i)^[a-z]+://[^/?#]+([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(F.regexp_like(href, F.lit(r"(?i)^[a-z][a-z0-9+.-]*:")), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, href)).when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, path, href)).when((href == "") | F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(page, "#.*$", ""), href)).otherwise(F.concat(origin, folder, href))
    )


def canonical_url(url: Column) -> Column:
    """A public https address without user, fragment and tracking parameters; null for anything else.

    Dot parts of the path are taken, other than plain characters encoded, short and odd forms of IPv4 written out. Names of
    parameters are compared without regard to case; the others keep their order and spelling.
    """
    return let(F.trim(url), lambda u: let(dotted_ipv4(host_of(u)), lambda host: _canonical(u, host)))


def _canonical(url: Column, host: Column) -> Column:
    port = F.regexp_extract(url, r"(?i)^https://(?:\[[^\]]*\]|[^/?#:@\\]*)(:\d+)?", 1)
    path = encoded(without_dots(F.regexp_extract(url, r"(?i)^https://[^/?#]*([^?#]*)", 1)), UNSAFE_IN_PATH)
    query = F.split(encoded(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), UNSAFE_IN_QUERY), "&")
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.filter(query, lambda p: (p != "") & ~name(p).isin(*TRACKING) & ~F.startswith(name(p), F.lit("utm_")))
    rebuilt = F.concat(F.lit("https://"), host, F.when(port.isin("", ":443"), "").otherwise(port), F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(~blocked_host(host), rebuilt)


def safe_endpoint(url: Column) -> Column:
    """Host, port and path of an address: no query, fragment or user."""
    found = F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#]+)([^?#]*)", 0)
    bare = F.regexp_replace(F.regexp_replace(found, r"(?i)^https?://(?:[^/?#@]*@)?", ""), "^([^/]+)$", "$1/")
    return F.when(found == "", "invalid-endpoint").otherwise(bare)


def error_code(message: Column) -> Column:
    """HTTP and its number, if the message names one."""
    number = F.regexp_extract(message, r"(?i)(?<![A-Za-z0-9_])HTTP\s+(\d{3})(?![A-Za-z0-9_])", 1)
    return F.when(number == "", "FETCH_ERROR").otherwise(F.concat(F.lit("HTTP "), number))


def safe_message(message: Column, secret: Column | None = None, most: int = 500) -> Column:
    """An HTTP code alone, or the message with addresses cut to host and path and the secret masked."""
    code = error_code(message)
    bare = F.regexp_replace(message, r"(?i)https://(?:[^/?#@\s\"'<>]*@)?([^/?#\s\"'<>]+)([^?#\s\"'<>]*)[^\s\"'<>]*", "$1$2")
    bare = bare if secret is None else F.when(F.coalesce(secret, F.lit("")) == "", bare).otherwise(F.replace(bare, secret, F.lit("[redacted]")))
    return F.when(code != "FETCH_ERROR", code).otherwise(F.substring(bare, 1, most))


def failure_category(message: Column, status: Column) -> Column:
    """The first class of failure that fits, by status and then by message."""
    found = F.when(status == "conflict", "article-input-conflict").when(status == "superseded", "analysis-superseded")
    for name, pattern in FAILURES:
        found = found.when(F.regexp_like(F.coalesce(message, F.lit("")), F.lit(pattern)), name)
    return found.otherwise("concept-analysis-failed")


def _day(text: Column, pattern: str, year: int, month: int, day: int, named: bool) -> Column:
    part = lambda i: F.regexp_extract(text, pattern, i)
    month_text = F.substring(part(month), 1, 3) if named else F.lpad(part(month), 2, "0")
    whole = F.concat_ws("-", part(year), month_text, F.lpad(part(day), 2, "0"))
    return F.when(part(0) != "", F.try_to_timestamp(whole, F.lit("yyyy-MMM-dd" if named else "yyyy-MM-dd")))


def any_time(text: Column) -> Column:
    """A moment written in ISO form or as in mails; null for anything else."""
    mail = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3}, ", ""), " (GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(F.trim(text)), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))


def find_date(text: Column) -> Column:
    """The first day written in digits, or else with a month's name; null if there is none or it does not exist."""
    return F.when(F.regexp_like(text, F.lit(DAY)), _day(text, DAY, 1, 2, 3, False)).otherwise(_day(text, NAMED_DAY, 3, 1, 2, True))


def date_from_url(url: Column) -> Column:
    """The day in an address's path, as digits or with a short month name."""
    path = F.regexp_extract(url, r"(?i)^https?://[^/?#]*([^?#]*)", 1)
    return F.when(F.regexp_like(path, F.lit(PATH_DAY)), _day(path, PATH_DAY, 1, 2, 3, False)).otherwise(_day(path, PATH_NAMED_DAY, 1, 2, 3, True))


def script_share(text: Column, script: str = HAN) -> tuple[Column, Column]:
    """(letters of a script, all letters) of a text."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit(script)), F.regexp_count(text, F.lit(r"\p{L}"))


def editorial_issue(fields: dict[str, Column], least: dict[str, tuple[int, float]], script: str = HAN, foreign: str | None = KANA) -> Column:
    """The first field that is not led by the script, with the reason: foreign, too-few or too-thin; null if all are."""
    found = F.lit(None).cast("string")
    for field, text in reversed(fields.items()):
        own, letters = script_share(text, script)
        count, share = least[field]
        reason = F.when(F.regexp_like(F.coalesce(text, F.lit("")), F.lit(foreign)), "foreign") if foreign else F.when(F.lit(False), "")
        reason = reason.when(own < count, "too-few").when(own < share * letters, "too-thin")
        found = F.coalesce(F.concat(F.lit(f"{field}:"), reason), found)
    return found


def led_by(text: Column, script: str = r"[\x{3400}-\x{9fff}]", least: int = 4, share: float = 0.2) -> Column:
    """Whether a field has enough letters of the script, alone and against Latin ones."""
    own, latin = F.regexp_count(text, F.lit(script)), F.regexp_count(text, F.lit("[A-Za-z]"))
    return (own >= least) & (own >= share * F.greatest(F.lit(1), own + latin))
