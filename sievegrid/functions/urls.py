"""Column expressions on links. A link is a struct; tables of links come from exploding arrays of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievegrid.functions.text import text_of

# Lists that decide the tokens of a link.
SHORTENERS = ["bit.ly", "cutt.ly", "goo.gl", "is.gd", "ow.ly", "rebrand.ly", "s.id", "t.co", "tinyurl.com", "v.gd"]
KEYWORDS = ["account", "bank", "confirm", "login", "password", "secure", "signin", "update", "verify", "wallet"]
BRANDS = ["alipay", "amazon", "apple", "bank", "google", "microsoft", "office365", "paypal", "tencent", "wechat"]
TWO_LEVEL_SUFFIXES = ["ac.cn", "ac.uk", "co.jp", "co.uk", "com.au", "com.cn", "com.hk", "com.sg", "edu.cn", "gov.cn", "net.cn", "org.cn"]
HIGH_SIGNAL = ["encoded_chars", "ip_host", "lookalike_characters", "many_subdomains", "punycode", "userinfo"]
FIND = r"(?i)(?<!@)\b((?:https?://|www\.)[^\s<>'\"]+|(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/[^\s<>'\"]*)?)"
TRAILING = ".,;:!?)。，；"
IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
NESTED = r"http%3a|https%3a|url=http|redirect=http|target=http"


def found_urls(c: Column | str) -> Column:
    """Links and bare domains of a text, without closing punctuation, each once."""
    hits = F.regexp_extract_all(text_of(c), F.lit(FIND), F.lit(1))
    return F.array_distinct(F.transform(hits, lambda u: F.rtrim(u, F.lit(TRAILING))))


def html_text(c: Column | str) -> Column:
    """Visible text of a page: script and style blocks, comments and tags go, common entities are read, blanks are single."""
    t = F.regexp_replace(text_of(c), r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def anchors(c: Column | str) -> Column:
    """Array of struct href, display_text of the anchors of a page."""
    found = F.regexp_extract_all(text_of(c), F.lit(r"(?is)(<a\s[^>]*?href\s*=\s*(?:\"[^\"]*\"|'[^']*')[^>]*>.*?</a\s*>)"), F.lit(1))
    return F.transform(
        found,
        lambda a: F.struct(
            F.trim(F.regexp_replace(F.regexp_extract(a, r"(?is)href\s*=\s*(\"[^\"]*\"|'[^']*')", 1), r"^[\"']|[\"']$", "")).alias("href"),
            F.trim(F.regexp_replace(F.regexp_replace(a, r"(?s)<[^>]*>", " "), r"\s+", " ")).alias("display_text"),
        ),
    )


def html_links(c: Column | str) -> Column:
    """The anchors of a page, and after them the links of its visible text that no anchor shows as its text, with an empty display_text."""
    shown = lambda links: F.transform(links, lambda a: a["display_text"])
    bare = F.array_except(found_urls(html_text(c)), shown(anchors(c)))
    return F.array_distinct(F.concat(anchors(c), F.transform(bare, lambda u: F.struct(u.alias("href"), F.lit("").alias("display_text")))))


def is_ip(host: Column) -> Column:
    return host.rlike(IPV4) | (host.contains(":") & host.rlike(r"^\[?[0-9a-f:.]+\]?$"))


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three below a listed suffix; empty for addresses, localhost and single labels."""
    h = F.rtrim(F.lower(host), F.lit("."))
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    n = F.size(labels)
    two, three = F.array_join(F.slice(labels, -2, 2), "."), F.array_join(F.slice(labels, -3, 3), ".")
    return F.when((h == "") | (h == "localhost") | is_ip(h) | (n < 2), "").when((n >= 3) & two.isin(TWO_LEVEL_SUFFIXES), three).otherwise(two)


def looks_alike(host: Column) -> Column:
    """Digits for letters in a label before the last make it contain a brand."""
    labels = F.split(host, r"\.")
    read = lambda x: F.translate(x, "01357", "olest")
    return F.exists(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: (read(x) != x) & F.exists(F.array(*map(F.lit, BRANDS)), lambda b: F.contains(read(x), b)))


def host_of(raw: Column) -> Column:
    """The lower-case host of a link or bare domain; empty where there is none."""
    bare = F.regexp_replace(F.trim(raw), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.lower(F.rtrim(F.regexp_extract(F.regexp_replace(bare, r"^[^/?#]*@", ""), r"^([^/?#:]*)", 1), F.lit(".")))


PARTS = ["raw_url", "normalized_url", "display_text", "scheme", "host", "registrable_domain", "port", "path", "query", "is_https", "uses_ip", "is_shortener", "suspicious_tokens"]


def with_parsed(df: DataFrame, raw: str, display: Column | None = None) -> DataFrame:
    """Adds the PARTS of the link in column raw: its normal form and the tokens that make it suspicious.

    A link that can't be read has an empty normal form and parse_error. The steps are columns of their own, so that
    each is computed once.
    """
    keep = [c for c in df.columns if c not in PARTS]
    r, u = F.col("_r"), F.col("_u")
    df = df.withColumn("_r", F.trim(text_of(raw))).withColumn("_shown", F.lit("") if display is None else F.coalesce(display, F.lit("")))
    bare = ~r.rlike(r"(?i)^[a-z][a-z0-9+.-]*://") & (r.startswith("www.") | r.rlike(r"(?i)^(?:[a-z0-9-]+\.)+[a-z]{2,}(?:[/:?#]|$)"))
    df = df.withColumn("_bare", bare).withColumn("_u", F.when(F.col("_bare"), F.concat(F.lit("http://"), r)).otherwise(r))
    part = lambda k: F.regexp_extract(u, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k)
    df = df.withColumns({"_scheme": F.lower(part(1)), "_net": part(2), "_path": part(3), "_query": part(4)})
    df = df.withColumn("_place", F.regexp_replace("_net", r"^.*@", ""))
    place, scheme, net, path, q = (F.col(f"_{c}") for c in ("place", "scheme", "net", "path", "query"))
    host_text = F.lower(F.rtrim(F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(place, r"^([^:]*)", 1)), F.lit(".")))
    df = df.withColumns({"_name": host_text, "_port": F.regexp_extract(F.regexp_replace(place, r"^\[[^\]]*\]", ""), r":(.*)$", 1)})
    odd = F.col("_name").rlike(r"[^\x00-\x7F]")
    ascii_name = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), "_name")  # null for names that have no ASCII form
    df = df.withColumn("_host", F.when(odd, F.lower(F.coalesce(ascii_name, F.col("_name")))).otherwise(F.col("_name")))
    host, port = F.col("_host"), F.col("_port").try_cast("int")
    bad_port = (F.col("_port") != "") & (~F.col("_port").rlike(r"^\d{1,5}$") | (F.coalesce(port, F.lit(70000)) > 65535))
    df = df.withColumns({"_bad": (scheme == "") | (net == ""), "_badport": bad_port, "_ip": is_ip(host)})
    df = df.withColumns({"_ok": ~F.col("_bad") & ~F.col("_badport"), "_n": F.when(((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443)), F.lit(None).cast("int")).otherwise(port)})
    df = df.withColumn("_domain", F.when(F.col("_ip") | (host == "localhost"), "").otherwise(registrable_domain(host)))
    ok, ip, domain = F.col("_ok"), F.col("_ip"), F.col("_domain")
    short = F.when(domain != "", domain).otherwise(host).isin(SHORTENERS)
    below = F.trim(F.substring(host, F.lit(1), F.length(host) - F.length(domain)), F.lit("."))
    df = df.withColumns({"_short": short, "_dots": F.length(below) - F.length(F.replace(below, F.lit("."), F.lit(""))), "_searched": F.lower(F.concat_ws(" ", path, q, r))})
    authority = F.concat(F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host), F.when(F.col("_n").isNotNull(), F.concat(F.lit(":"), F.col("_n"))).otherwise(""))
    normal = F.concat(scheme, F.lit("://"), authority, path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    flags = F.array(
        F.when(F.col("_bare"), "missing_scheme"), F.when(scheme != "https", "non_https"), F.when(ip, "ip_host"), F.when(F.col("_short"), "shortener"), F.when(F.length(r) >= 120, "long_url"),
        F.when(net.contains("@"), "userinfo"), F.when(path.contains("%") | q.contains("%"), "encoded_chars"), F.when((domain != "") & host.endswith(domain) & (F.col("_dots") >= 2), "many_subdomains"),
    )
    late = F.array(F.when(host.contains("xn--"), "punycode"), F.when(looks_alike(host), "lookalike_characters"))
    words = F.filter(F.array(*map(F.lit, KEYWORDS)), lambda k: F.contains(F.col("_searched"), k))
    unread = F.array(F.when(F.col("_bare"), "missing_scheme"), F.lit("parse_error"))
    return df.select(
        *keep,
        r.alias("raw_url"), F.when(ok, normal).otherwise("").alias("normalized_url"), F.col("_shown").alias("display_text"), F.when(F.col("_bad"), "").otherwise(scheme).alias("scheme"),
        F.when(F.col("_bad"), "").otherwise(host).alias("host"), F.when(ok, domain).otherwise("").alias("registrable_domain"), F.when(ok, F.col("_n")).alias("port"),
        F.when(ok, path).otherwise("").alias("path"), F.when(ok, q).otherwise("").alias("query"), (ok & (scheme == "https")).alias("is_https"), (ok & ip).alias("uses_ip"), (ok & F.col("_short")).alias("is_shortener"),
        F.array_distinct(F.array_compact(F.when(ok, F.concat(flags, words, late)).otherwise(unread))).alias("suspicious_tokens"),
    )


def nested_url(query: Column) -> Column:
    return F.lower(query).rlike(NESTED)
