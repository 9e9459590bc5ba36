"""Sender addresses: tri-state features, indicators, disposable class, score.

Domain facts (registry matches, registrable domain) are computed once per distinct domain;
the rest is one wide projection.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgrisk.functions import hosts as hx
from msgrisk.functions import text as tx
from msgrisk.functions import unicode as uni
from msgrisk.functions import wordlists as wl
from msgrisk.functions.hashing import DOT_ALIAS_DOMAINS, PLUS_TAG_DOMAINS, canonical_sender
from msgrisk.operators import links
from msgrisk.operators.mail import with_unicode


def _found(text: Column, words) -> Column:
    return F.filter(tx.literals(words), lambda w: text.contains(w))


def _holds(text: Column, words) -> Column:
    return F.exists(tx.literals(words), lambda w: text.contains(w))


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _tri(bad: Column, unsure: Column | None = None) -> Column:
    out = F.when(bad, -1)
    return (out if unsure is None else out.when(unsure, 0)).otherwise(1)


def address_parts(df: DataFrame, address: str = "address") -> DataFrame:
    """Split, fold aliases, and flag raw-address domains."""
    a = F.lower(F.trim(F.col(address)))
    out = df.withColumn("_a", a)
    out = out.withColumn("_ats", F.length("_a") - F.length(F.replace("_a", F.lit("@"), F.lit(""))))
    out = out.withColumn("_raw", F.substring_index("_a", "@", 1)).withColumn(
        "domain", F.when(F.col("_ats") > 0, F.substring_index("_a", "@", -1)).otherwise("")
    )
    host = F.regexp_replace(F.trim("domain"), r"\.+$", "")
    out = out.withColumn(
        "subaddress", host.isin(PLUS_TAG_DOMAINS) & F.col("_raw").rlike(r"^[^+]+\+[a-z0-9._%+\-]+$")
    )
    out = out.withColumn("_tagless", F.when(F.col("subaddress"), F.regexp_extract("_raw", r"^([^+]+)\+", 1)).otherwise(F.col("_raw")))
    out = out.withColumn(
        "local", F.when(host.isin(DOT_ALIAS_DOMAINS), F.replace("_tagless", F.lit("."), F.lit(""))).otherwise(F.col("_tagless"))
    )
    return out.withColumn(
        "_scored", F.when(F.col("_ats") == 1, F.concat("local", F.lit("@"), "domain")).otherwise(F.col("_a"))
    ).withColumn("_ip", F.col("domain").rlike(r"^\d{1,3}(\.\d{1,3}){3}$"))


def with_domain_facts(parts: DataFrame, key: list[str], disposable: DataFrame, relays: DataFrame, suffix_rules: DataFrame) -> DataFrame:
    """Registry matches and registrable domain; relays are never disposable."""
    only = disposable.join(relays, "domain", "left_anti")
    out = links.with_domain_facts(parts, "domain", key, {"disposable_match": only, "relay_match": relays}, suffix_rules)
    ip = F.col("_ip")
    relay = F.col("relay_match").isNotNull()
    suffix = F.coalesce(F.nullif(F.col("public_suffix"), F.lit("")), F.col("domain"))
    out = out.withColumns({
        "base": F.when(ip, F.col("domain")).otherwise(F.coalesce("registrable", "domain")),
        "label": F.when(ip, F.col("domain")).otherwise(F.coalesce("domain_label", "domain")),
        "suffix": F.when(ip, F.lit("")).otherwise(F.coalesce("public_suffix", F.lit(""))),
        "tld": F.when(ip, F.lit("")).otherwise(F.substring_index(suffix, ".", -1)),
        "relay": relay,
        "depth": F.when(ip | relay, 0).otherwise(F.coalesce("subdomains", F.lit(0))),
        "provider": hx.listed_domain("domain", wl.KNOWN_PROVIDERS),
        "traffic": hx.listed_domain("domain", wl.HIGH_TRAFFIC),
    })
    known = F.col("provider").isNotNull() | F.col("disposable_match").isNotNull() | F.col("relay")
    return out.withColumns({
        "normal_label": tx.normalize_homoglyphs("label"),
        "known": known | F.col("domain").endswith(".edu") | F.col("domain").endswith(".gov"),
    }).drop("registrable", "domain_label", "public_suffix", "subdomains")


def _brand_flags(df: DataFrame) -> DataFrame:
    label, normal, base, free = F.col("label"), F.col("normal_label"), F.col("base"), ~F.col("relay")
    brands = tx.literals(wl.BRANDS)
    extra = tx.literals([f"{b}>{d}" for b, ds in hx.PROTECTED_BRANDS.items() for d in ds])

    def stranger(b: Column) -> Column:
        standard = base.isin(F.concat(b, F.lit(".com")), F.concat(b, F.lit(".net")), F.concat(b, F.lit(".org")))
        return ~(standard | F.array_contains(extra, F.concat(b, F.lit(">"), base)))

    plain = F.exists(brands, lambda b: label.contains(b) & stranger(b))
    changed = F.exists(brands, lambda b: normal.contains(b) & ~label.contains(b) & stranger(b))
    return df.withColumns({
        "brand_plain": free & plain,
        "brand_changed": free & (normal != label) & ~plain & changed,
        "brand_normalized": free & (normal != label) & _holds(normal, wl.BRANDS),
    })


def mailbox_randomness(
    df: DataFrame, first_names: list[str] = (), last_names: list[str] = (), common_words: list[str] = ()
) -> DataFrame:
    """Six randomness factors of the mailbox name, with a real-name exemption.

    Names and words are caller-supplied lists; two factors suffice on unknown domains, four on
    recognized ones.
    """
    local, parts = F.col("local"), F.split("_tagless", "[._-]")
    first, last = tx.literals(first_names), tx.literals(last_names)
    one, two = F.get(parts, 0), F.get(parts, 1)
    both = lambda a, b: F.array_contains(first, a) & F.array_contains(last, b)
    separated = (F.size(parts) == 2) & F.forall(parts, lambda p: p.rlike(r"^\p{L}{2,}$")) & (both(one, two) | both(two, one))
    joined = F.regexp_replace("_tagless", "[._-]", "")
    glued = F.exists(
        first,
        lambda f: (joined.startswith(f) & F.array_contains(last, F.substr(joined, F.length(f) + 1)))
        | (joined.endswith(f) & F.array_contains(last, F.substring(joined, F.lit(1), F.length(joined) - F.length(f)))),
    )
    letters = F.regexp_replace(local, r"\P{L}", "")
    known = F.array_union(F.array_union(first, last), tx.literals(common_words))
    words = F.filter(parts, lambda p: p.rlike(r"^\p{L}{3,}$"))
    factors = [
        tx.shannon_entropy(local) > 3.0,
        tx.vowel_ratio(local) <= 0.30,
        (tx.class_count(local, r"\d") >= 2) & local.rlike(r"[a-z]\d[a-z]|\d[a-z]\d"),
        tx.unique_ratio(local) >= 0.75,
        ~_holds(letters, common_words),
        (F.size(words) >= 2) & ~F.exists(words, lambda w: F.array_contains(known, w)),
    ]
    shaped = local.rlike(r"^[a-z0-9._-]{8,25}$") & F.col("disposable_match").isNull() & ~F.col("relay")
    score = reduce(lambda a, b: a + b, [f.cast("int") for f in factors])
    unknown = F.col("provider").isNull() & F.col("traffic").isNull()
    return df.withColumn("randomness", F.when(shaped & ~(separated | glued), score).otherwise(0)).withColumn(
        "random_mailbox", F.col("randomness") >= F.when(unknown, 2).otherwise(4)
    )


def disposable_class(df: DataFrame) -> DataFrame:
    labels = F.split(F.regexp_replace("domain", r"\.+$", ""), r"\.")
    pattern = F.exists(labels, lambda x: _any([x.rlike(p) for p in wl.DISPOSABLE_LABELS]))
    return df.withColumn(
        "disposable_status",
        F.when(F.col("disposable_match").isNotNull(), "known_disposable_provider")
        .when(F.col("relay"), "privacy_relay")
        .when(F.col("random_mailbox"), "suspicious_mailbox_pattern")
        .when(pattern, "suspicious_domain_pattern")
        .otherwise("no_known_match"),
    )


def fabricated_business_domain(label: Column) -> Column:
    """``pattern`` for [short prefix][financial term][business suffix], else which parts occur."""

    def compound(term: Column) -> Column:
        at = F.instr(label, term)
        prefix, rest = F.substring(label, F.lit(1), at - 1), F.substr(label, at + F.length(term))
        short = (at == 1) | ((at <= 5) & prefix.rlike(r"^\p{L}+$"))
        return (at > 0) & short & F.array_contains(tx.literals(wl.BUSINESS_SUFFIXES), rest)

    fin, biz = _holds(label, wl.FINANCIAL_TERMS), _holds(label, wl.BUSINESS_SUFFIXES)
    pattern = F.exists(tx.literals(wl.FINANCIAL_TERMS), compound)
    return F.when(pattern, "pattern").when(fin & biz, "combined").when(fin, "financial").when(biz, "business").otherwise("none")


def sender_features(
    addresses: DataFrame, key: list[str], disposable: DataFrame, relays: DataFrame, suffix_rules: DataFrame,
    address: str = "address", **names,
) -> DataFrame:
    """Thirty tri-state features and the coded indicators of every address."""
    df = with_domain_facts(address_parts(addresses, address), key, disposable, relays, suffix_rules)
    df = disposable_class(mailbox_randomness(_brand_flags(df), **names))
    df = df.withColumn("fabricated", F.when(F.col("known"), "none").otherwise(fabricated_business_domain(F.col("label"))))
    local, domain, base, label, tld = (F.col(c) for c in ("local", "domain", "base", "label", "tld"))
    n, n_local, n_label = F.length("_scored"), F.length("local"), F.length("label")
    relay, known, random = F.col("relay"), F.col("known"), F.col("random_mailbox")
    service = F.col("disposable_match").isNotNull() | relay
    recognized = (F.col("suffix") != "") | tld.isin(wl.COMMON_TLDS) | relay
    digits = label.rlike(r"\d") & ~relay
    mixed = label.rlike(r"[a-z]\d|\d[a-z]") & ~relay
    domain_words = F.when(relay, F.array().cast("array<string>")).otherwise(_found(F.replace(domain, F.lit("."), F.lit("")), wl.SUSPICIOUS_KEYWORDS))
    df = df.withColumn("domain_words", domain_words).withColumn("local_words", _found(local, wl.SUSPICIOUS_KEYWORDS))
    odd = local.rlike(r"[^a-z0-9._+\-]")
    valid = F.col("_scored").rlike(r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$")
    values = {
        "having_ip_address": _tri(F.col("_ip")),
        "url_length": _tri(n > 50, n > 30),
        "shortining_service": _tri(base.isin(wl.SHORT_MAIL_DOMAINS)),
        "having_at_symbol": _tri(F.col("_ats") > 1),
        "double_slash_redirecting": _tri(domain.contains("//")),
        "prefix_suffix": _tri(base.contains("-")),
        "having_sub_domain": _tri(F.col("depth") > 1, F.col("depth") == 1),
        "https_token": _tri(F.col("_scored").contains("http")),
        "sslfinal_state": _tri(~known),
        "domain_registration_length": _tri(~recognized),
        "age_of_domain": _tri(n_label > 20, n_label > 12),
        "dnsrecord": _tri(digits),
        "web_traffic": _tri(F.col("traffic").isNull() & ~relay),
        "page_rank": _tri(F.size("domain_words") > 0),
        "google_index": _tri(F.size("local_words") > 0),
        "statistical_report": _tri(tld.isin(wl.SPAM_TLDS)),
        "request_url": _tri(odd),
        "url_of_anchor": _tri(~service & (n_local > 30), ~service & (n_local > 15)),
        "links_in_tags": _tri(F.col("brand_plain") | F.col("brand_changed")),
        "sfh": F.when(_any([local.contains(w) for w in ("noreply", "no-reply", "donotreply")]), 0).otherwise(1),
        "abnormal_url": _tri(mixed | F.col("brand_normalized")),
        "redirect": F.lit(1),
        "on_mouseover": _tri(tld.isin(wl.ABUSED_CCTLDS)),
        "popupwindow": _tri(F.size(F.regexp_extract_all(label, F.lit("([a-z]+)"), 1)) > 3),
    }
    counted = reduce(lambda a, b: a + b, [(F.col(c) == -1).cast("int") for c in values])
    df = df.select("*", *[c.cast("int").alias(n) for n, c in values.items()])
    df = df.select(
        "*",
        _tri(counted > 8, counted > 4).alias("iframe"),
        _tri(~valid).alias("links_pointing_to_page"),
        # These four are judged only for mailboxes that look generated.
        _tri(random & (tx.digit_ratio(local) > 0.4)).alias("favicon"),
        _tri(random & (tx.shannon_entropy(local) > 3.0)).alias("port"),
        _tri(random & (tx.repeat_ratio(local) > 0.5) & (n_local > 3)).alias("submitting_to_email"),
        _tri(random & local.rlike(r"^[a-z]{2,5}\d{4,12}$")).alias("rightclick"),
    )
    bad = lambda f: F.col(f) == -1
    odd_domain = ~known
    signals = [
        ("ip_domain", "high", bad("having_ip_address")),
        ("long_address", "medium", bad("url_length")),
        ("shortener_domain", "high", bad("shortining_service")),
        ("several_at_signs", "high", bad("having_at_symbol")),
        ("double_slash", "high", bad("double_slash_redirecting")),
        ("hyphen", "low", bad("prefix_suffix")),
        ("deep_subdomain", "medium", bad("having_sub_domain")),
        ("http_token", "medium", bad("https_token")),
        ("unknown_provider", "medium", bad("sslfinal_state")),
        ("uncommon_tld", "medium", bad("domain_registration_length") & (tld != "")),
        ("long_label", "low", bad("age_of_domain")),
        ("digits_in_label", "low", bad("dnsrecord")),
        ("domain_keywords", "high", bad("page_rank")),
        ("mailbox_keywords", "high", bad("google_index")),
        ("spam_tld", "high", bad("statistical_report")),
        ("special_characters", "medium", bad("request_url")),
        ("long_mailbox", "low", bad("url_of_anchor")),
        ("brand_substitution", "high", F.col("brand_changed")),
        ("substitution_in_label", "high", F.col("brand_normalized") & ~mixed),
        ("abused_cctld", "medium", bad("on_mouseover")),
        ("invalid_format", "high", bad("links_pointing_to_page")),
        ("fabricated_business", "high", F.col("fabricated").isin("pattern", "combined")),
        ("financial_words", "medium", F.col("fabricated") == "financial"),
        ("business_words", "low", F.col("fabricated") == "business"),
        ("brand_in_label", "high", odd_domain & ~(F.col("brand_plain") | F.col("brand_changed"))
         & F.exists(tx.literals(wl.BRANDS), lambda b: label.contains(b) & (label != b))),
        ("government_words", "high", odd_domain & _holds(label, wl.GOVERNMENT_TERMS) & ~tld.isin("gov", "mil")),
        ("long_compound", "medium", odd_domain & (n_label > 15) & (F.col("fabricated") != "none")),
        ("random_mailbox", "medium", random),
        ("disposable_pattern", "medium", F.col("disposable_status") == "suspicious_domain_pattern"),
        ("known_disposable", "info", F.col("disposable_status") == "known_disposable_provider"),
        ("privacy_relay", "info", F.col("disposable_status") == "privacy_relay"),
        ("plus_tag", "info", F.col("subaddress")),
    ]
    indicators = F.array_compact(
        F.array(*[F.when(c, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for code, level, c in signals])
    )
    observable = (
        F.when(F.col("disposable_status").isin("known_disposable_provider", "privacy_relay"), "not_applicable")
        .when(hx.listed_domain("domain", wl.MAILBOX_PROVIDERS).isNotNull(), "provider_account_unverifiable")
        .otherwise("unknown")
    )
    kept = [c for c in addresses.columns]
    return df.select(
        *kept, *wl.FEATURES, indicators.alias("indicators"), "disposable_status", "fabricated", "randomness", "brand_changed",
        observable.alias("account_observability"),
    )


def sender_score(features: DataFrame) -> DataFrame:
    """Points by indicator level, floor for look-alike brands, verdict band."""
    n = lambda level: F.size(F.filter("indicators", lambda i: i["level"] == level))
    points = F.least(F.lit(100), n("high") * 28 + n("medium") * 10 + n("low") * 3)
    score = F.when(F.col("brand_changed"), F.greatest(points, F.lit(60))).otherwise(points)
    out = features.withColumn("risk_score", score)
    verdict = F.when(F.col("risk_score") >= 80, "critical").when(F.col("risk_score") >= 60, "high").when(
        F.col("risk_score") >= 30, "medium").otherwise("low")
    return out.withColumn("verdict", verdict)


def feature_breakdown(features: DataFrame, key: list[str], top: int = 10) -> DataFrame:
    """The ``top`` features of each address, risky ones first, in feature order."""
    cells = F.array(*[
        F.struct(F.col(f).alias("value"), F.lit(i).alias("ord"), F.lit(f).alias("feature")) for i, f in enumerate(wl.FEATURES)
    ])
    return features.select(*key, F.posexplode(F.slice(F.array_sort(cells), 1, top)).alias("rank", "c")).select(
        *key, (F.col("rank") + 1).alias("rank"), "c.feature", "c.value"
    )


def from_addresses(mailboxes: DataFrame, key: list[str], order: str, address: str = "address") -> DataFrame:
    """Unique plausible From mailboxes per message, in order of appearance; foreign domains in their ASCII form."""
    foreign = F.regexp_extract(address, r"@([^@]*)$", 1).rlike(r"[^\x00-\x7f]")
    local, domain = F.regexp_extract(address, r"^(.*)@[^@]*$", 1), F.lower(F.trim(F.regexp_extract(address, r"@([^@]*)$", 1)))
    boxes = with_unicode(mailboxes, foreign, lambda rows: rows.withColumn(address, F.concat(local, F.lit("@"), uni.encode_idna(domain))))
    ok = boxes.where(hx.has_known_shape(address))
    return ok.groupBy(*key, F.lower(F.trim(address)).alias("_id")).agg(
        F.min(order).alias(order), F.min_by(address, order).alias(address)
    ).drop("_id")


def riskiest_sender(scored: DataFrame, key: list[str], order: str, address: str = "address") -> DataFrame:
    """Highest-scoring canonical identity of each message; the first one on ties."""
    one = scored.groupBy(*key, canonical_sender(address).alias("identity")).agg(
        F.min(order).alias("_first"), F.min_by(F.struct(address, "risk_score", "verdict"), F.col(order)).alias("_s")
    )
    best = one.groupBy(*key).agg(F.max_by("_s", F.struct("_s.risk_score", -F.col("_first"))).alias("s"))
    return best.select(*key, "s.*")


