"""Web pages and links: addresses, registries, findings, markup facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgrisk.catalog.registry import query, table
from msgrisk.functions import hosts as hx
from msgrisk.operators import links as lk
from msgrisk.operators import pages as pg
from msgrisk.operators.scale import spread
from msgrisk.session import materialize

SUFFIX_RULES = [("com", "normal"), ("net", "normal"), ("org", "normal"), ("io", "normal"), ("co.uk", "normal"), ("uk", "normal"),
                ("ck", "wildcard"), ("www.ck", "exception")]
KNOWN_HOSTS = ["gmail.com", "github.com"]


def suffix_rules(spark):
    return spark.createDataFrame(SUFFIX_RULES, "suffix string, kind string")


def page_links(spark, d):
    pages = table(spark, d, "pages")
    facts = pg.page_facts(pages, ["page_id", "url"])
    return pg.html_links(facts, ["page_id"], "url")


_SITE = r"regexp_extract(url, '^(https?://[^/?#]*)', 1)"
_ANCHOR = rf"""a AS (SELECT page_id, {_SITE} AS site, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
  unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS link_ord FROM pages)"""


@query("page_links", f"WITH {_ANCHOR} SELECT page_id, link_ord::BIGINT AS link_ord, site || href AS destination FROM a")
def page_link_destinations(spark, d):
    return page_links(spark, d).select("page_id", F.col("link_ord").cast("bigint").alias("link_ord"), "destination")


@query("page_anchor_counts", f"WITH {_ANCHOR} SELECT page_id, count(*)::BIGINT AS links, count(DISTINCT href)::BIGINT AS targets FROM a GROUP BY page_id")
def page_anchor_counts(spark, d):
    links = pg.native_anchor_links(table(spark, d, "pages"), ["page_id"])
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("href").alias("targets"))


@query("host_profile", rf"""WITH {_ANCHOR}
SELECT regexp_extract(site, '([^./]+\.[^./]+)$', 1) AS registrable, count(*)::BIGINT AS links, count(DISTINCT page_id)::BIGINT AS messages FROM a GROUP BY 1""")
def host_profile(spark, d):
    links = materialize(page_links(spark, d).withColumn("host", hx.parse_destination("destination")["host"]))
    named = lk.registrable_domain(links, "host", suffix_rules(spark), ["page_id", "link_ord"])
    return lk.host_profile(named, ["page_id"])


@query("parse_destination", r"""
SELECT page_id, regexp_extract(url, '^(https?):', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host,
  regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, true AS valid FROM pages""")
def parse_destination(spark, d):
    p = table(spark, d, "pages").select("page_id", hx.parse_destination("url").alias("p"))
    return p.select("page_id", "p.scheme", "p.host", F.regexp_extract("p.url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"), "p.valid")


@query("registry_suffix_match", r"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages),
r(domain) AS (VALUES ('example.com'), ('example.net'), ('ththre.example.com'), ('en.example.org'))
SELECT page_id, host, arg_max(domain, length(domain)) AS matched_domain FROM h LEFT JOIN r ON host = domain OR ends_with(host, '.' || domain) GROUP BY page_id, host""")
def registry_suffix_match(spark, d):
    pages = table(spark, d, "pages").select("page_id", hx.parse_destination("url")["host"].alias("host"))
    registry = spark.createDataFrame([(x,) for x in ("example.com", "example.net", "ththre.example.com", "en.example.org")], "domain string")
    return lk.match_domain_registry(pages, "host", registry, ["page_id"])


@query("registrable_domain", r"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS registrable, regexp_extract(host, '([^.]+)\.[^.]+$', 1) AS domain_label,
  regexp_extract(host, '([^.]+)$', 1) AS public_suffix, (len(string_split(host, '.')) - 2)::INTEGER AS subdomains FROM h""")
def registrable_domain(spark, d):
    pages = table(spark, d, "pages").select("page_id", hx.parse_destination("url")["host"].alias("host"))
    out = lk.registrable_domain(pages, "host", suffix_rules(spark), ["page_id"])
    return out.select("page_id", "registrable", "domain_label", "public_suffix", "subdomains")


@query("ip_hosts", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_orderkey < 4294967296 WHEN 'O' THEN o_custkey <= 255 AND o_orderkey < 16777216 ELSE false END AS is_ip FROM orders""")
def ip_hosts(spark, d):
    """Order keys as integer hosts, key pairs as abbreviated dotted hosts, names otherwise."""
    o = table(spark, d, "orders")
    key, pair = F.col("o_orderkey").cast("string"), F.concat_ws(".", F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string"))
    host = F.when(F.col("o_orderstatus") == "F", key).when(F.col("o_orderstatus") == "O", pair).otherwise(F.concat(F.lit("host"), key))
    return o.select("o_orderkey", hx.is_ip_host(host).alias("is_ip"))


# One link shape per event type; the user number keeps hosts apart.
_DESTINATION = {
    "click": "hxxp://paypa1-{u}.example.com/login",
    "error": "https://trusted.com@{u}.verify-login.net/",
    "purchase": "http://10.0.0.7/pay/{u}",
    "signup": "javascript:open({u})",
    "view": "https://bit.ly/{u}",
}


def event_links(spark, d):
    """Links as messages would carry them, one per event; clicks display another domain."""
    destination = None
    for kind, shape in _DESTINATION.items():
        left, right = shape.split("{u}")
        made = F.concat(F.lit(left), F.col("user_id").cast("string"), F.lit(right))
        destination = F.when(F.col("event_type") == kind, made) if destination is None else destination.when(F.col("event_type") == kind, made)
    visible = F.when(F.col("event_type") == "click", "www.paypal.com").when(F.col("event_type") == "view", "short link").otherwise("")
    return spread(table(spark, d, "events"), "event_id").select(
        "event_id", F.lit(0).alias("link_ord"), "event_type", visible.alias("visible"), destination.alias("destination"))


_EXPECTED = {
    "click": ["obfuscated-scheme", "display-mismatch", "brand-lookalike"],
    "error": ["url-userinfo", "sensitive-host"],
    "purchase": ["ip-host"],
    "signup": ["unsafe-scheme"],
    "view": [],
}


@query("link_findings", "SELECT event_id, finding, points, level, floor FROM events JOIN (VALUES " + ", ".join(
    f"('{kind}', '{f}', {lk.FINDINGS[f][0]}, '{lk.FINDINGS[f][1]}', '{lk.FINDINGS[f][2]}')" for kind, fs in _EXPECTED.items() for f in fs)
    + ") AS t(kind, finding, points, level, floor) ON kind = event_type")
def link_findings(spark, d):
    return lk.link_findings(event_links(spark, d), ["event_id"], KNOWN_HOSTS).drop("link_ord")


@query("shortener_links", "SELECT event_id, event_type = 'view' AS shortened FROM events")
def shortener_links(spark, d):
    links = event_links(spark, d)
    return links.select("event_id", lk.shortener_host(hx.parse_destination("destination")["host"]).alias("shortened"))


@query("page_visible_text")
def page_visible_text(spark, d):
    facts = pg.page_facts(table(spark, d, "pages"), ["page_id"])
    return pg.html_visible_text(facts, ["page_id"]).select("page_id", F.length("text").alias("chars"), "visible_chars", "hidden_chars", "warnings")


@query("page_image_refs", """
SELECT page_id, 0 AS data_images, 0 AS remote_images, least(len(regexp_extract_all(html, '<img[^>]*src="[^"]+"')), 20)::INTEGER AS unresolved_images FROM pages""")
def page_image_refs(spark, d):
    return pg.html_image_refs(pg.page_facts(table(spark, d, "pages"), ["page_id"]), ["page_id"])


@query("page_password_forms", "SELECT page_id FROM pages WHERE regexp_matches(html, '(?i)<input[^>]*type=\"?password')")
def page_password_forms(spark, d):
    return pg.html_password_forms(pg.page_facts(table(spark, d, "pages"), ["page_id"]), ["page_id"])


@query("page_signals", "SELECT page_id, false AS padded FROM pages")
def page_signals(spark, d):
    return pg.page_facts(table(spark, d, "pages"), ["page_id"]).select("page_id", pg.hidden_padding_signal().alias("padded"))
