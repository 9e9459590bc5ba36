"""Domains and link destinations: registries, registrable domains, link findings.

Host work runs once per distinct host and is joined back with heavy hosts salted, so a host
behind a third of all links costs no more than any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgrisk.functions import hosts as hx
from msgrisk.functions import text as tx
from msgrisk.functions import unicode as ux
from msgrisk.operators.scale import dimension_join, salted_join
from msgrisk.session import materialize


def _per_host(df: DataFrame, host: str) -> DataFrame:
    return df.select(F.regexp_replace(F.lower(F.trim(F.col(host))), r"\.+$", "").alias("_host")).where("_host <> ''").distinct()


def _attach(df: DataFrame, host: str, facts: DataFrame, spread_by: list[str]) -> DataFrame:
    keyed = df.withColumn("_host", F.regexp_replace(F.lower(F.trim(F.col(host))), r"\.+$", ""))
    return salted_join(keyed, facts, ["_host"], "left", spread_by).drop("_host")


def domain_facts(distinct_hosts: DataFrame, registries: dict[str, DataFrame] | None = None,
                 suffix_rules: DataFrame | None = None) -> DataFrame:
    """Registry matches and registrable domain of distinct hosts (``_host``) in one pass.

    The suffix condition becomes an equi-join: each host lists its suffixes once, and one
    dimension holds every registry and suffix rule. ``registries`` maps an output column to a
    table with ``domain``; the most specific entry wins. ``suffix_rules(suffix, kind)`` holds
    normal, wildcard and exception rules; an unknown suffix falls back to the last two labels.
    """
    sources = [r.select(F.col("domain").alias("_suffix"), F.lit(n).alias("_kind")) for n, r in (registries or {}).items()]
    if suffix_rules is not None:
        sources.append(suffix_rules.select(F.col("suffix").alias("_suffix"), F.concat(F.lit("suffix:"), "kind").alias("_kind")))
    listed = reduce(DataFrame.unionByName, sources).groupBy("_suffix").agg(F.collect_set("_kind").alias("_kinds"))
    tails = distinct_hosts.select("_host", F.explode(hx.label_suffixes("_host", 1)).alias("_suffix"))
    hit = dimension_join(tails, listed, ["_suffix"], "left", ["_host"])
    hit = hit.withColumn("_depth", F.size(F.split("_suffix", r"\."))).withColumn("_all", F.size(F.split("_host", r"\.")))
    of = lambda kind: F.coalesce(F.array_contains("_kinds", kind), F.lit(False))
    matches = [F.max_by("_suffix", F.when(of(n), F.col("_depth"))).alias(n) for n in (registries or {})]
    if suffix_rules is None:
        return hit.groupBy("_host").agg(*matches)
    depth, exception = F.col("_depth"), of("suffix:exception")
    labels = (
        F.when(exception, depth - 1)
        .when(of("suffix:wildcard") & (F.col("_all") > depth), depth + 1)
        .when(of("suffix:normal"), depth)
    )
    rule = F.max(F.when(labels.isNotNull(), F.struct(exception.alias("exact"), labels.alias("labels")))).alias("_rule")
    facts = hit.groupBy("_host").agg(*matches, rule, F.max("_all").alias("_n"))
    suffix_labels, parts = F.col("_rule.labels"), F.split("_host", r"\.")
    take = F.when(F.col("_n") > suffix_labels, suffix_labels + 1).otherwise(F.least(F.col("_n"), F.lit(2)))
    facts = facts.withColumn("_take", take)
    tail = lambda n: F.array_join(F.slice(parts, F.col("_n") - n + 1, n), ".")
    return facts.select(
        "_host",
        *(registries or {}),
        tail(F.col("_take")).alias("registrable"),
        F.element_at(parts, F.greatest(F.col("_n") - F.col("_take") + 1, F.lit(1))).alias("domain_label"),
        F.when(suffix_labels.isNotNull(), tail(F.least(suffix_labels, F.col("_n")))).otherwise("").alias("public_suffix"),
        F.greatest(F.col("_n") - F.col("_take"), F.lit(0)).alias("subdomains"),
    )


def with_domain_facts(df: DataFrame, host: str, spread_by: list[str], registries: dict[str, DataFrame] | None = None,
                      suffix_rules: DataFrame | None = None) -> DataFrame:
    """Attach the facts of each row's host; a null result means no host or no match."""
    return _attach(df, host, domain_facts(_per_host(df, host), registries, suffix_rules), spread_by)


def match_domain_registry(df: DataFrame, host: str, registry: DataFrame, spread_by: list[str], output: str = "matched_domain") -> DataFrame:
    """Most specific registry entry that equals the host or is its parent."""
    return with_domain_facts(df, host, spread_by, {output: registry})


def registrable_domain(df: DataFrame, host: str, suffix_rules: DataFrame, spread_by: list[str]) -> DataFrame:
    """Registrable domain, its first label, public suffix and subdomain depth."""
    return with_domain_facts(df, host, spread_by, None, suffix_rules)


# --- link findings -------------------------------------------------------------------

# Shortening services, sensitive words and well-known hosts.
SHORTENERS = ["bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "short.link", "rb.gy", "cutt.ly", "is.gd", "buff.ly",
              "ift.tt", "dlvr.it", "wp.me", "tiny.cc", "clck.ru", "qr.ae", "su.pr", "lnkd.in", "db.tt", "qr.net"]
SENSITIVE_TERMS = ["account", "credential", "login", "password", "reactivate", "secure", "security", "signin", "unlock",
                   "verification", "verify", "wallet"]
SECRET_TERMS = ["credential", "password", "passcode", "otp"]
COLLECT_TERMS = ["capture", "harvest", "steal"]

# Finding -> (points, level, floor).
FINDINGS = {
    "obfuscated-scheme": (3, "high", "high"),
    "malformed-target": (2, "medium", "medium"),
    "unsafe-scheme": (5, "high", "high"),
    "url-userinfo": (5, "high", "high"),
    "ip-host": (3, "high", "high"),
    "display-mismatch": (3, "high", "high"),
    "idn-confusable": (5, "high", "high"),
    "brand-lookalike": (5, "high", "high"),
    "credential-collection-host": (4, "high", "high"),
    "sensitive-host": (2, "low", "safe"),
}


def shortener_host(host) -> Column:
    return hx.listed_domain(host, SHORTENERS).isNotNull()


def _spells(brand: str):
    return lambda label: hx.brand_lookalike(label, brand)


def host_flags(host: Column, decoded: Column, skeleton: Column, known_hosts: list[str]) -> Column:
    """Codes of the findings that depend on the destination host alone."""
    first = F.substring_index(skeleton, ".", 1)
    changed = host.startswith("xn--") | (skeleton != tx.casefold(decoded))
    labels = F.filter(F.split(skeleton, r"\."), lambda x: x != "")
    confusable, lookalike = [], []
    for brand in hx.PROTECTED_BRANDS:
        stranger = ~hx.canonical_for(host, brand)
        idn = first.contains(brand) & stranger & changed
        confusable.append(idn)
        lookalike.append(~idn & stranger & F.exists(labels, _spells(brand)))
    words = F.split(skeleton, "[^a-z0-9]+")
    has = lambda terms: F.arrays_overlap(words, tx.literals(terms))
    collects = has(SECRET_TERMS) & has(COLLECT_TERMS)
    sensitive = has(SENSITIVE_TERMS) & hx.listed_domain(host, known_hosts).isNull()
    either = lambda cs: reduce(lambda a, b: a | b, cs)
    flags = {
        "ip-host": hx.is_ip_host(host),
        "idn-confusable": either(confusable),
        "brand-lookalike": either(lookalike),
        "credential-collection-host": sensitive & collects,
        "sensitive-host": sensitive & ~collects,
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()]))


def _with_decoded(links: DataFrame, spread_by: list[str]) -> DataFrame:
    """Decoded host and skeleton per link.

    Plain hosts are handled in the projection; only links whose host needs Unicode work are
    joined to the decoded distinct hosts.
    """
    odd = F.coalesce(ux.needs_unicode(F.col("_host")), F.lit(False))
    plain = links.where(~odd).withColumns({"decoded": F.col("_host"), "skeleton": F.translate("_host", *tx.CONFUSABLES)})
    coded = links.where(odd)
    hosts = coded.select("_host").distinct().withColumn("decoded", ux.decode_idna(F.col("_host")))
    hosts = hosts.withColumn("skeleton", ux.confusable_skeleton(F.col("decoded")))
    return plain.unionByName(salted_join(coded, hosts, ["_host"], "left", spread_by).select(plain.columns))


def parsed_links(links: DataFrame) -> DataFrame:
    """Links with their parsed destination."""
    return links.withColumn("p", hx.parse_destination("destination"))


def link_findings(links: DataFrame, key: list[str], known_hosts: list[str]) -> DataFrame:
    """Each finding once per message, with points and floor, at its first link.

    ``links(key..., link_ord, visible, destination)``.
    """
    p = parsed_links(links)
    web = F.col("p.scheme").isin("http", "https") & F.col("p.valid")
    # Written once: the filters on the host would each parse every destination again.
    p = materialize(p.withColumns({"_host": F.when(web, F.col("p.host")), "_shown": hx.visible_host("visible")}).select(
        *key, "link_ord", "destination", "p", "_host", "_shown"))
    joined = _with_decoded(p, [*key, "link_ord"])
    own = {
        "obfuscated-scheme": F.lower("destination").rlike("^hxxps?://"),
        "malformed-target": ~F.col("p.valid"),
        "unsafe-scheme": F.col("p.scheme").isin("data", "file", "javascript"),
        "url-userinfo": web & F.regexp_replace("p.userinfo", "^:$", "").rlike("."),
        "display-mismatch": web & (F.col("_shown") != "") & ~(
            hx.domains_align("_shown", "decoded") | hx.domains_align("_shown", "_host")
        ),
    }
    found = F.concat(
        F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in own.items()])),
        F.when(web & (F.col("_host") != ""), host_flags(F.col("_host"), F.col("decoded"), F.col("skeleton"), known_hosts)).otherwise(
            F.array().cast("array<string>")),
    )
    once = joined.select(*key, "link_ord", F.explode(found).alias("finding")).groupBy(*key, "finding").agg(
        F.min("link_ord").alias("link_ord")
    )
    column = lambda i: F.coalesce(*[F.when(F.col("finding") == n, F.lit(spec[i])) for n, spec in FINDINGS.items()])
    return once.select(
        *key, "finding", "link_ord", column(0).alias("points"), column(1).alias("level"), column(2).alias("floor")
    )


def host_profile(links: DataFrame, key: list[str], group: str = "registrable") -> DataFrame:
    """Links and distinct messages per registrable host; partial counts collapse heavy hosts."""
    per_message = links.groupBy(group, *key).agg(F.count(F.lit(1)).alias("n"))
    return per_message.groupBy(group).agg(F.sum("n").alias("links"), F.count(F.lit(1)).alias("messages"))
