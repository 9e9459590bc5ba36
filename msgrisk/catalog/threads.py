"""Whole conversations as nested raw messages, and their verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgrisk.catalog import sender
from msgrisk.catalog.pages import KNOWN_HOSTS
from msgrisk.catalog.registry import SQL_SPACE, query, table
from msgrisk.plans import mail

TRUSTED = ["mx.example.org"]
THRESHOLD = 0.7
SENDERS = {"user": "PayPal Support <box@paypal.com>", "system": "PayPal Support <box@shop.example.net>", "assistant": "Team Desk <box@shop.example.net>"}


def by_role(**values):
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("role"))


def nested_threads(spark, d):
    """One raw message for each conversation: every turn is a message attached to the turn before it.

    Role and turn pick headers, layout and attachments; odd turns have an HTML alternative, every text names a nation.
    """
    t = table(spark, d, "conversations").join(table(spark, d, "nation"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(25)) == F.col("n_nationkey"))
    turn = F.col("turn").cast("string")
    subject = F.concat(F.lit("Subject: Turn "), turn, F.when(F.col("turn") % 5 == 4, " ??").otherwise(""), F.lit("\r\n"))
    head = F.concat(
        F.lit("From: "), by_role(**SENDERS), F.lit("\r\nTo: "),
        by_role(user="reader@example.org", system="box@shop.example.net", assistant="reader@example.org"), F.lit("\r\nReply-To: "),
        by_role(user="help@mail.paypal.com", system="help@elsewhere.org", assistant="help@elsewhere.org"), F.lit("\r\n"),
        subject, F.when(F.col("turn") % 4 == 2, subject).otherwise(""), F.lit("Authentication-Results: "),
        by_role(user="mx.example.org; spf=softfail; dmarc=pass", system="mx.example.org; spf=fail; dkim=fail", assistant="mx.example.org; spf=fail"),
        F.lit("\r\nMIME-Version: 1.0\r\n"))
    edge = lambda mark, kind="": F.concat(F.lit(f"\r\n--{mark}"), turn, F.lit(f"{kind}\r\n"))
    plain = F.concat(
        F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: 8bit\r\n\r\n"), "text", F.lit("\r\n"), "n_name",
        F.when(F.col("role") == "system", "\r\nPay $50,000 now!!!").otherwise(""), F.lit("\r\n"))
    html = F.lit('Content-Type: text/html; charset=utf-8\r\n\r\n<p>Hello again</p><a href="https://bit.ly/x">Open</a><img src="https://img.example/x.png">\r\n')
    both = F.concat(F.lit('Content-Type: multipart/alternative; boundary="a'), turn, F.lit('"\r\n'), edge("a"), plain, edge("a"), html, edge("a", "--"))
    attached = by_role(
        user="", assistant='Content-Type: application/zip\r\nContent-Disposition: attachment; filename="notes.zip"\r\n\r\nPK\r\n',
        system='Content-Type: application/octet-stream\r\nContent-Disposition: attachment; filename="run.exe"\r\n\r\nMZ\r\n')
    opened = F.concat(
        head, F.lit('Content-Type: multipart/mixed; boundary="m'), turn, F.lit('"\r\n'), edge("m"), F.when(F.col("turn") % 2 == 1, both).otherwise(plain),
        F.when(attached != "", F.concat(edge("m"), attached)).otherwise(""))
    down = F.concat(edge("m"), F.lit("Content-Type: message/rfc822\r\n\r\n"))
    turns = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", opened.alias("opened"), down.alias("down"), edge("m", "--").alias("closed")))).alias("t"))
    whole = F.concat(
        F.array_join(F.transform("t", lambda x, i: F.concat(F.when(i > 0, F.get("t", i - 1)["down"]).otherwise(""), x["opened"])), ""),
        F.array_join(F.transform(F.reverse("t"), lambda x: x["closed"]), ""))
    return turns.select(F.col("conv_id").cast("string").alias("path"), F.encode(whole, "UTF-8").alias("content"))


def nation_rules(spark, d):
    return table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("ord"), F.col("n_regionkey").cast("string").alias("category"), F.lit("low").alias("level"),
        F.lower("n_name").alias("phrase"))


def turn_score(views):
    """A stand-in for a classifier: every fourth turn is too short to judge."""
    turn = F.regexp_extract("subject", r"Turn (\d+)", 1).cast("int")
    known = turn % 4 != 3
    return views.select(
        *mail.KEY, "view", F.when(known, F.pmod(turn * 37 + F.col("root_id").cast("int") * 13, F.lit(100)) / 100.0).alias("probability"),
        F.when(known, "available").otherwise("insufficient_context").alias("ml_status"))


def _fused(t: str, f: str, p: str, dominant: str, warnings: str) -> dict[str, str]:
    """SQL of the fusion: combined score, level (-1: unknown) and basis from points, floor rank and probability."""
    rules, model = f"least(1.0, {t} / 16.0::DOUBLE)", f"coalesce({p}, 0.0)"
    floor = f"greatest([0.0, 0.10, 0.30, 0.55, 0.80][{f} + 1], CASE WHEN {t} > 0 THEN 0.10 ELSE 0.0 END)::DOUBLE"
    best = f"greatest({rules}, {model}, {floor})"
    signal, support = f"coalesce({p} >= {THRESHOLD}, false)", f"({t} >= 9 OR {f} >= 3)"
    level = (f"CASE WHEN {f} = 4 OR {rules} >= 0.80 OR ({model} >= 0.80 AND {support}) THEN 4 WHEN {f} = 3 OR {rules} >= 0.55 OR {signal} THEN 3 "
             f"WHEN {best} >= 0.30 THEN 2 WHEN {best} >= 0.10 THEN 1 ELSE 0 END")
    weak = f"(({level}) = 0 OR ({dominant} AND ({level}) = 1))"
    unknown = f"(len({warnings}) > 0 AND {weak} AND NOT ({warnings} = ['remote_images'] AND NOT {dominant}))"
    return {
        "level": f"CASE WHEN {unknown} THEN -1 ELSE {level} END", "score": f"round({best} * 100, 1)",
        "basis": f"CASE WHEN {signal} AND {t} = 0 AND {f} = 0 THEN 'model_only' WHEN {signal} AND NOT {support} THEN 'model_led' WHEN {signal} THEN 'corroborated' ELSE 'other' END",
    }


_OWN = _fused("t", "f", "p", "dom", "w")
_NAMES = "['unknown', 'safe', 'low', 'medium', 'high', 'critical']"

# Senders: box@paypal.com has no indicator (no points), box@shop.example.net some weak ones (verdict low, one point).
ANALYZE_EML = rf"""
WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth, turn % 2 = 1 AS html,
    'Turn ' || turn || CASE WHEN turn % 5 = 4 THEN ' ??' ELSE '' END AS s FROM conversations JOIN nation ON (conv_id + turn) % 25 = n_nationkey),
b AS (SELECT conv_id, depth, turn, role, html, n_regionkey, CASE WHEN turn % 4 = 2 THEN s || chr(10) || s ELSE s END AS subject,
    text || ' ' || n_name || CASE WHEN role = 'system' THEN ' Pay $50,000 now!!!' ELSE '' END || CASE WHEN html THEN ' Hello again Open' ELSE '' END AS body FROM c),
x AS (SELECT *, trim(regexp_replace(subject || ' ' || body, '[{SQL_SPACE}]+', ' ', 'g')) AS whole, length(regexp_replace(body, '[{SQL_SPACE}]', '', 'g')) AS shown FROM b),
k AS (SELECT *, list_filter([
    'phrases:' || n_regionkey, CASE WHEN role = 'system' THEN 'exclamations' END, CASE WHEN role = 'system' THEN 'large_amounts' END,
    CASE WHEN length(whole) > 60 AND len(regexp_extract_all(whole, '\p{{Lu}}'))::DOUBLE / len(regexp_extract_all(whole, '\p{{L}}')) > 0.40 THEN 'capitals' END,
    CASE WHEN turn % 5 = 4 THEN 'subject_questions' END, CASE WHEN html THEN 'short_link' END], lambda v: v IS NOT NULL) AS ck,
    list_filter([CASE WHEN role = 'system' THEN 'brand_identity' END, CASE WHEN role <> 'user' THEN 'routing_mismatch' END,
      CASE WHEN role = 'system' THEN 'self_addressed' END, CASE role WHEN 'system' THEN 'authentication:failed' WHEN 'assistant' THEN 'authentication:partial_failure' END,
      CASE WHEN role <> 'user' THEN 'attachments' END], lambda v: v IS NOT NULL) AS sk FROM x),
m AS (SELECT *, (len(ck) + (role = 'system')::INTEGER + html::INTEGER)::INTEGER AS content, CASE role WHEN 'system' THEN 4 + 2 + 1 + 6 + 4 WHEN 'assistant' THEN 2 + 2 + 2 ELSE 0 END AS structure,
    CASE role WHEN 'system' THEN 3 WHEN 'assistant' THEN 2 ELSE 0 END AS f,
    CASE WHEN turn % 4 <> 3 THEN ((turn * 37 + conv_id * 13) % 100) / 100.0::DOUBLE END AS p FROM k),
o AS (SELECT *, content + structure + (role <> 'user')::INTEGER AS t, html::INTEGER AS remote, html AND shown < 80 AS dom, list_sort(list_filter([
    CASE WHEN html THEN 'remote_images' END, CASE WHEN role <> 'user' THEN 'attachment_not_inspected' END, CASE WHEN turn % 4 = 2 THEN 'duplicate_header' END,
    CASE WHEN turn % 4 = 3 THEN 'insufficient_context' END, CASE WHEN turn % 4 = 3 THEN 'mime_alternatives_unscored' END], lambda v: v IS NOT NULL)) AS w FROM m),
r AS (SELECT *, CASE WHEN t > 15 THEN 4 WHEN f = 3 THEN 3 WHEN f = 2 THEN 2 WHEN t > 8 THEN 3 WHEN t > 3 THEN 2
    ELSE CASE WHEN content = 0 THEN 0 WHEN content <= 3 THEN 1 ELSE 2 END END AS rule FROM o),
fold AS (SELECT conv_id, depth, t, f, p, dom, w, remote, 0 AS attached, {_OWN["level"]} AS level FROM r
    WHERE depth = (SELECT max(depth) FROM r y WHERE y.conv_id = r.conv_id)
  UNION ALL
  SELECT conv_id, depth, t, f, p, dom, w, remote, attached, {_OWN["level"]} AS level FROM (
    SELECT r.conv_id, r.depth, greatest(r.t, y.t) AS t, greatest(r.f, y.level) AS f, r.p, r.dom OR (y.remote > 0 AND y.level = -1) AS dom,
      list_sort(list_distinct(list_concat(r.w, CASE WHEN r.remote + y.remote > 0 THEN ['remote_images'] ELSE [] END,
        list_transform(list_filter(y.w, lambda v: v <> 'remote_images'), lambda v: 'attached:' || v)))) AS w, r.remote + y.remote AS remote, y.attached + 1 AS attached
    FROM fold y JOIN r ON r.conv_id = y.conv_id AND r.depth = y.depth - 1))
SELECT conv_id::VARCHAR AS root_id, depth::INTEGER AS depth, subject, CASE role WHEN 'user' THEN 'box@paypal.com' ELSE 'box@shop.example.net' END AS sender, 'low' AS sender_verdict,
  structure::INTEGER AS structure_score, (role <> 'user')::INTEGER AS sender_points, fold.t::INTEGER AS total_score, {_NAMES}[fold.f + 2] AS risk_floor, {_NAMES}[rule + 2] AS rule_level, fold.p AS probability,
  {_NAMES}[level + 2] AS risk_level, CASE WHEN level >= 0 THEN {_fused("fold.t", "fold.f", "fold.p", "fold.dom", "fold.w")["score"]} END AS combined_score,
  {_fused("fold.t", "fold.f", "fold.p", "fold.dom", "fold.w")["basis"]} AS fusion_basis, len(fold.w) = 0 AS analysis_complete, fold.w AS warnings,
  list_sort(list_concat(ck, sk)) AS kinds, html::BIGINT AS url_count, 0 AS data_images, fold.remote::INTEGER AS remote_images, 0 AS unresolved_images, attached::INTEGER AS attached_messages
FROM fold JOIN r USING (conv_id, depth)"""


@query("analyze_eml", ANALYZE_EML)
def analyze_eml(spark, d):
    senders = mail.SenderTables(*sender.registries(spark), sender.NAMES)
    out = mail.analyze_eml(nested_threads(spark, d), nation_rules(spark, d), KNOWN_HOSTS, TRUSTED, senders, turn_score, THRESHOLD)
    return out.withColumn("msg_path", F.size("msg_path")).withColumnRenamed("msg_path", "depth")
