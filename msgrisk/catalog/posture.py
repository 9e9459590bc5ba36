"""Domain records and delivery replies built from suppliers, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgrisk.catalog.registry import query, table
from msgrisk.operators import posture as ops

_SPF = {"AUTOMOBILE": "v=spf1 include:x.example -all", "BUILDING": "v=spf1 mx ~all", "FURNITURE": "v=spf1 bogus -all",
        "HOUSEHOLD": "v=spf1 +all", "MACHINERY": "unrelated"}
_DMARC = {"AUTOMOBILE": "v=DMARC1; p=reject; pct=50", "BUILDING": "v=DMARC1; p=none; p=none", "FURNITURE": "v=DMARC1; p=quarantine",
          "HOUSEHOLD": "v=DMARC1; pct=10", "MACHINERY": "v=DMARC1;p=reject;pct=200"}


def _pick(mapping):
    return F.element_at(F.create_map(*[F.lit(x) for p in mapping.items() for x in p]), F.col("c_mktsegment"))


def records(spark, d):
    """Record snapshots per customer domain; the segment picks the published policy."""
    c = table(spark, d, "customer").withColumn("domain", F.concat(F.lit("c"), F.col("c_custkey"), F.lit(".example.net")))
    at = lambda day: F.lit(f"2024-01-{day:02d}").cast("timestamp")
    def row(kind, value, status, day):
        return F.struct(F.lit(kind).alias("kind"), F.array(value).alias("values"), status.alias("status"), at(day).alias("observed_at"))

    ok = F.lit("ok")
    rows = F.array(
        row("TXT", _pick(_SPF), ok, 2),
        row("TXT", F.lit("v=spf1 ?all"), ok, 1),
        row("DMARC_TXT", _pick(_DMARC), ok, 1),
        row("MX", F.when(F.col("c_nationkey") < 5, "0 .").otherwise("10 mx.example.net"), ok, 1),
        row("PTR", F.lit("mx.example.net"), F.when(F.col("c_acctbal") < 0, "timeout").otherwise("ok"), 1),
        row("CREATED", F.when(F.col("c_nationkey") == 7, "2024-01-20").otherwise("2020-05-01"), ok, 1),
    )
    return c.select("domain", F.explode(rows).alias("r")).select("domain", "r.*")


@query("domain_posture", """
WITH c AS (SELECT 'c' || c_custkey || '.example.net' AS domain, c_mktsegment AS s, c_nationkey < 5 AS nomail, c_acctbal < 0 AS slow, c_nationkey = 7 AS young FROM customer),
p AS (SELECT *, s IN ('AUTOMOBILE') AND NOT slow AS done FROM c)
SELECT domain, CASE WHEN nomail THEN 'no_mail_service' WHEN done THEN 'valid' ELSE 'partial' END AS status, NOT nomail AND done AS complete,
  CASE s WHEN 'AUTOMOBILE' THEN 'strict' WHEN 'BUILDING' THEN 'softfail' WHEN 'HOUSEHOLD' THEN 'open' END AS spf_policy,
  CASE s WHEN 'AUTOMOBILE' THEN 'reject' WHEN 'FURNITURE' THEN 'quarantine' END AS dmarc_policy,
  CASE s WHEN 'AUTOMOBILE' THEN 50 WHEN 'FURNITURE' THEN 100 END AS dmarc_pct,
  CASE WHEN young THEN 'under_30_days' ELSE 'established' END AS age, young AS suspicious FROM p""")
def domain_posture(spark, d):
    return ops.domain_posture(records(spark, d), "2024-02-01")


@query("latest_snapshot", """
SELECT 'c' || c_custkey || '.example.net' AS domain, kind FROM customer, (VALUES ('TXT'), ('DMARC_TXT'), ('MX'), ('PTR'), ('CREATED')) t(kind)""")
def latest_snapshot(spark, d):
    return ops.latest_snapshot(records(spark, d)).select("domain", "kind")


_CODES = {"1-URGENT": (250, "OK"), "2-HIGH": (550, "5.1.1 no such user"), "3-MEDIUM": (554, "5.7.1 rejected"), "4-NOT SPECIFIED": (451, "4.3.0 later"), "5-LOW": (552, "5.2.2 full")}


@query("smtp_reply_class", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'exists' WHEN '2-HIGH' THEN 'does_not_exist' WHEN '3-MEDIUM' THEN 'policy_rejected'
  WHEN '4-NOT SPECIFIED' THEN 'temporarily_unavailable' ELSE 'mailbox_full' END AS reply FROM orders""")
def smtp_reply_class(spark, d):
    p = F.col("o_orderpriority")
    pick = lambda i: F.coalesce(*[F.when(p == k, F.lit(v[i])) for k, v in _CODES.items()])
    return table(spark, d, "orders").select("o_orderkey", ops.smtp_reply_class(pick(0), pick(1)).alias("reply"))


@query("public_addresses", """
WITH a AS (SELECT o_orderkey, o_custkey % 256 AS a, o_orderkey % 256 AS b FROM orders)
SELECT o_orderkey, NOT (a IN (0, 10, 127) OR a >= 240 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
  OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19))) AS public FROM a""")
def public_addresses(spark, d):
    o = table(spark, d, "orders")
    ip = F.concat_ws(".", (F.col("o_custkey") % 256).cast("string"), (F.col("o_orderkey") % 256).cast("string"), F.lit("7"), F.lit("9"))
    return o.select("o_orderkey", ops.public_v4(ip).alias("public"))
