"""Raw messages assembled from conversations, and checks over their headers and attachments."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgrisk.catalog.registry import query, table
from msgrisk.operators import mail as ops


def raw_messages(spark, d):
    """Every conversation turn as message bytes: its role picks headers and layout."""
    t = table(spark, d, "conversations")
    root = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    system, user = F.col("role") == "system", F.col("role") == "user"
    auth = F.when(system, "mx.example.org; spf=fail; dkim=fail").when(user, "mx.example.org (a; dmarc=fail) 1; spf=softfail; dmarc=pass").otherwise(
        "other.example; dmarc=fail")
    head = F.concat(
        F.lit("From: PayPal Support <box@"), F.when(user, "paypal.com").otherwise("shop.example.net"), F.lit(">\r\nTo: "),
        F.when(system, "box@shop.example.net").otherwise("reader@example.org"), F.lit("\r\nReply-To: help@"),
        F.when(user, "mail.paypal.com").otherwise("elsewhere.org"), F.lit("\r\nSubject: Turn "), F.col("turn").cast("string"),
        F.lit("\r\nAuthentication-Results: "), auth, F.lit("\r\nMIME-Version: 1.0\r\n"))
    plain = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), "text", F.lit("\r\n"))
    mixed = F.concat(
        F.lit('Content-Type: multipart/mixed; boundary="b1"\r\n\r\n--b1\r\n'), plain,
        F.lit('--b1\r\nContent-Type: application/zip\r\nContent-Disposition: attachment; filename="notes.zip"\r\n\r\nPK\r\n'),
        F.lit('--b1\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename="run.exe"\r\n\r\nMZ\r\n--b1--\r\n'))
    layout = F.when(F.col("role") == "assistant", mixed).otherwise(plain)
    return t.select(root.alias("path"), F.encode(F.concat(head, layout), "UTF-8").alias("content"))


_ROOT = "conv_id || '-' || turn AS root_id"


@query("eml_entities", f"""
SELECT {_ROOT}, 'Turn ' || turn AS subject, 1::BIGINT AS parts, CASE WHEN role = 'assistant' THEN 2 ELSE 0 END::BIGINT AS attachments,
  5::BIGINT AS headers FROM conversations""")
def eml_entities(spark, d):
    e = ops.ingest_eml(raw_messages(spark, d))
    count = lambda n: e[n].groupBy("root_id").agg(F.count(F.lit(1)).alias(n))
    out = e["messages"].select("root_id", "subject")
    for n in ("parts", "attachments", "headers"):
        out = out.join(count(n), "root_id", "left")
    return out.na.fill(0, ["parts", "attachments", "headers"])


@query("eml_part_text", f"""SELECT {_ROOT}, sha256(trim(text, chr(10) || chr(13) || ' ')) AS digest FROM conversations""")
def eml_part_text(spark, d):
    parts = ops.ingest_eml(raw_messages(spark, d))["parts"]
    unified = F.replace("content", F.lit("\r\n"), F.lit("\n"))
    return parts.select("root_id", F.sha2(F.trim(unified, F.lit("\n\r ")), 256).alias("digest"))


@query("brand_display_identity", f"SELECT {_ROOT}, 4 AS points FROM conversations WHERE role <> 'user'")
def brand_display_identity(spark, d):
    boxes = ops.mailboxes(ops.ingest_eml(raw_messages(spark, d))["headers"])
    return ops.brand_display_identity(boxes, ["root_id"])


@query("routing_mismatch", f"SELECT {_ROOT}, 2 AS points FROM conversations WHERE role <> 'user'")
def routing_mismatch(spark, d):
    boxes = ops.mailboxes(ops.ingest_eml(raw_messages(spark, d))["headers"])
    return ops.routing_mismatch(boxes, ["root_id"])


@query("recipients", f"SELECT {_ROOT}, false AS no_visible_recipient, role = 'system' AS self_addressed FROM conversations")
def recipients(spark, d):
    e = ops.ingest_eml(raw_messages(spark, d))
    return ops.recipients(ops.mailboxes(e["headers"]), ["root_id"], e["messages"])


@query("auth_verdict", f"""
SELECT {_ROOT}, CASE role WHEN 'system' THEN 'failed' WHEN 'user' THEN 'trusted' ELSE 'none' END AS verdict,
  CASE role WHEN 'system' THEN 6 ELSE 0 END AS points, (role = 'assistant')::BIGINT AS untrusted_claims FROM conversations""")
def auth_verdict(spark, d):
    headers = ops.ingest_eml(raw_messages(spark, d))["headers"]
    return ops.auth_verdict(headers, ["root_id"], ["mx.example.org"]).select("root_id", "verdict", "points", "untrusted_claims")


@query("attachment_risk", f"SELECT {_ROOT}, 6 AS points, 'high' AS floor FROM conversations WHERE role = 'assistant'")
def attachment_risk(spark, d):
    return ops.attachment_risk(ops.ingest_eml(raw_messages(spark, d))["attachments"], ["root_id"])


@query("duplicate_headers", f"SELECT {_ROOT}, 'from' AS name, 0::BIGINT AS n FROM conversations WHERE 1 = 0")
def duplicate_headers(spark, d):
    return ops.duplicate_headers(ops.ingest_eml(raw_messages(spark, d))["headers"], ["root_id"])


def branched_messages(spark, d):
    """Turns with alternative renderings: none (system), one group (assistant), or three groups, one inside another (user)."""
    t = table(spark, d, "conversations")
    root = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    leaf = lambda content: F.concat(F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), content, F.lit("\r\n"))

    def multipart(kind, mark, *children):
        inside = [x for c in children for x in (F.lit(f"--{mark}\r\n"), c)]
        return F.concat(F.lit(f'Content-Type: multipart/{kind}; boundary="{mark}"\r\n\r\n'), *inside, F.lit(f"--{mark}--\r\n"))

    text = F.col("text")
    inner = multipart("alternative", "c", leaf(F.lit("two")), leaf(F.lit("three")))
    branched = multipart("mixed", "m", multipart("alternative", "a", leaf(text), inner), multipart("alternative", "d", leaf(F.lit("four")), leaf(F.lit("five"))))
    layout = F.when(F.col("role") == "user", branched).when(
        F.col("role") == "assistant", multipart("alternative", "a", leaf(text), leaf(F.lit("other")))).otherwise(leaf(text))
    return t.select(root.alias("path"), F.encode(F.concat(F.lit("Subject: s\r\nMIME-Version: 1.0\r\n"), layout), "UTF-8").alias("content"))


@query("mime_views", f"""
WITH v AS (SELECT *, unnest(CASE role WHEN 'user' THEN [text || ' four', text || ' five', 'two four', 'three four', 'two five', 'three five']
    WHEN 'assistant' THEN [text, 'other'] ELSE [text] END) AS body, unnest(range(1, CASE role WHEN 'user' THEN 7 WHEN 'assistant' THEN 3 ELSE 2 END)) AS view FROM conversations)
SELECT {_ROOT}, view::INTEGER AS view, sha256(trim(regexp_replace(body, '[\s\p{{Z}}]+', ' ', 'g'))) AS digest, false AS uncertain, false AS truncated FROM v""")
def mime_views(spark, d):
    views = ops.mime_views(ops.ingest_eml(branched_messages(spark, d))["parts"], ["root_id"])
    body = F.trim(F.regexp_replace("body", r"[\s\p{Z}]+", " "))
    return views.select("root_id", "view", F.sha2(body, 256).alias("digest"), "uncertain", "truncated")
