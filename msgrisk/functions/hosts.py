"""Links, hosts and domains as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgrisk.functions import text as tx
from msgrisk.functions.text import _col


def domains_align(left, right) -> Column:
    """Equal, or parent and subdomain on a label boundary; empty never aligns."""
    a, b = _col(left), _col(right)
    dot = F.lit(".")
    related = (a == b) | a.endswith(F.concat(dot, b)) | b.endswith(F.concat(dot, a))
    return F.coalesce((a != "") & (b != "") & related, F.lit(False))


def label_suffixes(host, min_labels: int = 1) -> Column:
    """``a.b.c`` gives ``[a.b.c, b.c, c]``, most specific first."""
    def tails(labels: Column) -> Column:
        last = F.size(labels) - min_labels + 1
        return F.when(
            last >= 1,
            F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")),
        ).otherwise(F.array().cast("array<string>"))

    return tx.let(F.split(F.regexp_replace(F.lower(tx.strip(host)), r"\.+$", ""), r"\."), tails)


def listed_domain(host, domains) -> Column:
    """Most specific entry of a short literal list that equals the host or a parent of it."""
    return F.get(F.filter(label_suffixes(host), lambda s: F.array_contains(tx.literals(domains), s)), 0)


def _remove_dots(path: Column) -> Column:
    """Drop ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        segments,
        empty,
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    trailing = F.when(F.element_at(segments, -1).isin(".", ".."), "/").otherwise("")
    return F.concat(F.array_join(kept, "/"), trailing)


_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _resolve(ref: Column, base: Column) -> Column:
    """Absolute form of a reference without scheme and authority."""
    site = F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*", 0)
    base_path = F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    path, tail = F.regexp_extract(ref, r"^[^?#]*", 0), F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    directory = F.coalesce(F.nullif(F.regexp_extract(base_path, r"^(.*/)", 1), F.lit("")), F.lit("/"))
    absolute = F.when(ref.startswith("/"), path).otherwise(F.concat(directory, path))
    return (
        F.when(base == "", ref)
        .when(ref == "", F.regexp_replace(base, "#.*$", ""))
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), ref))
        .when(ref.startswith("?"), F.concat(site, base_path, ref))
        .otherwise(F.concat(site, tx.let(absolute, _remove_dots), tail))
    )


def _absolute(u: Column, base: Column) -> Column:
    given = F.lower(F.regexp_extract(u, _SCHEME, 1))
    after = F.regexp_replace(u, r"^[A-Za-z]+:", "")
    base_scheme = F.lower(F.regexp_extract(base, _SCHEME, 1))
    web = given.isin("http", "https")
    # "http:path" next to a base of the same scheme is a relative reference.
    relative = web & (given == base_scheme) & ~after.startswith("//")
    outer_scheme = F.coalesce(F.nullif(base_scheme, F.lit("")), F.lit("https"))
    return (
        F.when(relative, tx.let(after, lambda ref: _resolve(ref, base)))
        .when(web, F.concat(given, F.lit("://"), F.regexp_replace(after, "^/+", "")))
        .when(given != "", u)
        .when(u.startswith("//"), F.concat(outer_scheme, F.lit("://"), F.regexp_replace(u, "^/+", "")))
        .otherwise(_resolve(u, base))
    )


def _parts(full: Column) -> Column:
    scheme = F.lower(F.regexp_extract(full, _SCHEME, 1))
    authority = F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)

    def split(authority: Column) -> Column:
        bracketed = r"^(?:.*@)?\[([^\]]*)\]"
        ipv6 = authority.rlike(bracketed)
        raw = F.when(ipv6, F.regexp_extract(authority, bracketed, 1)).otherwise(
            F.regexp_extract(authority, r"^(?:.*@)?([^:@]*)", 1)
        )
        port = F.regexp_extract(authority, r"^(?:.*@)?(?:\[[^\]]*\]|[^:@]*):?(.*)$", 1)
        decoded = F.when(raw.contains("%"), F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))
        host = F.regexp_replace(F.lower(F.coalesce(decoded, raw)), r"\.+$", "")
        legal = (port == "") | (port.rlike(r"^\d{1,5}$") & (port.try_cast("int") <= 65535))
        return F.struct(
            full.alias("url"),
            scheme.alias("scheme"),
            F.regexp_extract(authority, r"^(.*)@", 1).alias("userinfo"),
            host.alias("host"),
            port.try_cast("int").alias("port"),
            (~scheme.isin("http", "https") | ((host != "") & legal)).alias("valid"),
        )

    return tx.let(authority, split)


def parse_destination(url, base=None) -> Column:
    """Struct ``(url, scheme, userinfo, host, port, valid)`` of a link target.

    Repairs obfuscated schemes, stray white space and backslashes the way clients do, then
    resolves against ``base``. Web targets need a host and a legal port to be valid.
    """
    base = F.lit("") if base is None else F.coalesce(_col(base), F.lit(""))
    cleaned = F.regexp_replace(tx.strip(F.coalesce(_col(url), F.lit(""))), r"[\t\r\n]", "")
    opened = F.regexp_replace(cleaned, r"(?i)^hxxp(s?)://", "http$1://")

    def repaired(u: Column) -> Column:
        web = F.lower(F.regexp_extract(u, _SCHEME, 1)).isin("", "http", "https")
        head, tail = F.regexp_extract(u, r"^[^?#]*", 0), F.regexp_extract(u, r"^[^?#]*(.*)$", 1)
        return F.when(web & u.contains("\\"), F.concat(F.translate(head, "\\", "/"), tail)).otherwise(u)

    full = tx.let(tx.let(opened, repaired), lambda u: tx.let(base, lambda b: _absolute(u, b)))
    return tx.let(full, _parts)


def is_ip_host(host) -> Column:
    """IPv6, dotted IPv4 and its legacy forms (integer, abbreviated, hex, octal)."""
    h = _col(host)
    parts = F.split(h, r"\.")

    def number(p: Column) -> Column:
        hexed, octal = p.startswith("0x"), p.rlike("^0[0-9]+$")
        digits = F.regexp_replace(F.when(hexed, F.substring(p, 3, 64)).otherwise(p), "^0+(?=.)", "")
        value = (
            F.when(hexed, F.conv(digits, 16, 10))
            .when(octal, F.when(digits.rlike("^[0-7]+$"), F.conv(digits, 8, 10)))
            .otherwise(digits)
        )
        return F.when(F.length(digits) <= 15, value.try_cast("bigint"))

    shaped = F.forall(parts, lambda p: p.rlike("^(?:0x[0-9a-f]+|[0-9]+)$"))
    inner = F.forall(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.coalesce(number(p) <= 255, F.lit(False)))
    last = number(F.element_at(parts, -1))
    limit = F.pow(F.lit(256.0), F.lit(5) - F.size(parts))
    v4 = F.size(parts).between(1, 4) & shaped & inner & F.coalesce(last < limit, F.lit(False))
    v6 = h.rlike(r"^[0-9a-f:]*:[0-9a-f:]*:[0-9a-f:.]*$") & ~h.contains(":::")
    return F.coalesce(v4 | v6, F.lit(False))


_LABEL = r"(?:xn--)?[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"


def visible_host(label) -> Column:
    """First host-like token of a link text, or empty."""
    return F.regexp_replace(
        F.regexp_extract(F.lower(_col(label)), rf"(?:https?://|www\.)?({_LABEL}(?:\.{_LABEL})+)", 1), r"\.+$", ""
    )


def has_known_shape(address) -> Column:
    """Plausible single mailbox address with an ASCII domain."""
    a = tx.strip(address)
    local, domain = F.regexp_extract(a, r"^([^@]*)@", 1), F.regexp_replace(F.lower(F.regexp_extract(a, r"@([^@]*)$", 1)), r"\.+$", "")
    labels = F.split(domain, r"\.")
    return F.coalesce(
        (F.length(a) - F.length(F.replace(a, F.lit("@"), F.lit(""))) == 1)
        & ~a.rlike(rf"[{tx.SPACE}]")
        & F.length(local).between(1, 64)
        & local.rlike(r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+$")
        & ~local.rlike(r"^\.|\.$|\.\.")
        & (F.length(domain) <= 253)
        & (F.size(labels) >= 2)
        & F.forall(labels, lambda x: x.rlike(r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$")),
        F.lit(False),
    )


# Protected brands, their canonical domains and benign words that contain them.
PROTECTED_BRANDS = {
    "apple": ["apple.com", "icloud.com"],
    "amazon": ["amazon.com", "amazon.co.uk", "amazon.de"],
    "google": ["google.com", "google.co.uk", "googleusercontent.com"],
    "microsoft": ["microsoft.com"],
    "paypal": ["paypal.com"],
}
BENIGN_LABELS = {"apple": ["crabapple", "dapple", "grapple", "pineapple", "snapple"]}


def canonical_for(host, brand: str) -> Column:
    aligned = F.lit(False)
    for domain in PROTECTED_BRANDS[brand]:
        aligned = aligned | domains_align(host, F.lit(domain))
    return aligned


def brand_lookalike(skeleton, brand: str) -> Column:
    """A label skeleton spells the brand as a token, or within its letters unless benign."""
    plain = tx.digit_lookalike(skeleton)
    tokens = F.transform(F.split(plain, "[^a-z0-9]+"), lambda t: F.regexp_replace(t, "[^a-z]", ""))
    compact = F.regexp_replace(plain, "[^a-z]", "")
    inside = compact.contains(brand)
    if BENIGN_LABELS.get(brand):
        inside = inside & ~compact.isin(BENIGN_LABELS[brand])
    return F.array_contains(tokens, brand) | inside
