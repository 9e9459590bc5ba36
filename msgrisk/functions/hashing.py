"""Digest column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgrisk.functions.text import _col

_BLOCK = 64


def tagged_digest(mode, payload) -> Column:
    """SHA-256 of ``mode``, a zero byte and the payload; modes can never collide."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    return F.sha2(F.concat(F.encode(mode, "UTF-8"), F.lit(bytearray(b"\x00")), _col(payload).cast("binary")), 256)


def content_digest(raw, raw_text, subject, body) -> Column:
    """Identity of the effective message input: bytes, then raw text, then subject and body."""
    pair = F.to_json(F.array(F.coalesce(_col(subject), F.lit("")), F.coalesce(_col(body), F.lit(""))))
    return (
        F.when(_col(raw).isNotNull(), tagged_digest("eml-bytes", raw))
        .when(F.coalesce(_col(raw_text), F.lit("")) != "", tagged_digest("raw-unicode", raw_text))
        .otherwise(tagged_digest("subject-body", pair))
    )


def hmac_sha256(key: bytes, text) -> Column:
    """Keyed pseudonym: HMAC written as two SHA-256 calls over padded key blocks."""
    import hashlib

    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\x00")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in key))
    inner = F.unhex(F.sha2(F.concat(inner_pad, F.encode(_col(text), "UTF-8")), 256))
    return F.sha2(F.concat(outer_pad, inner), 256)


def seeded_order(seed, key) -> Column:
    """A reproducible shuffle key: hex digest of seed and key."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), _col(key).cast("string")), 256)


# Plus tags and dots that known providers ignore. Fixed values.
PLUS_TAG_DOMAINS = ["gmail.com", "googlemail.com", "outlook.com", "hotmail.com", "live.com"]
DOT_ALIAS_DOMAINS = ["gmail.com", "googlemail.com"]


def canonical_sender(address) -> Column:
    """One identity per mailbox for providers whose alias rules are known."""
    c = F.lower(F.trim(_col(address)))
    local = F.regexp_extract(c, r"^([^@]*)@", 1)
    domain = F.regexp_extract(c, r"@([^@]*)$", 1)
    host = F.regexp_replace(F.trim(domain), r"\.+$", "")
    tagged = host.isin(PLUS_TAG_DOMAINS) & local.rlike(r"^[^+]+\+[a-z0-9._%+\-]+$")
    base = F.when(tagged, F.regexp_extract(local, r"^([^+]+)\+", 1)).otherwise(local)
    base = F.when(host.isin(DOT_ALIAS_DOMAINS), F.replace(base, F.lit("."), F.lit(""))).otherwise(base)
    one_at = F.length(c) - F.length(F.replace(c, F.lit("@"), F.lit(""))) == 1
    return F.when(one_at, F.concat(base, F.lit("@"), domain)).otherwise(c)
