"""Sender addresses built from customers and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgrisk.catalog.pages import suffix_rules
from msgrisk.catalog.registry import query, table
from msgrisk.functions import hosts as hx
from msgrisk.functions import wordlists as wl
from msgrisk.operators import sender as ops

# A mailbox shape per market segment: the customer number is {u}.
SHAPES = {
    "AUTOMOBILE": "ana.lopez+{u}@gmail.com",
    "BUILDING": "billing{u}@bpinsgroup.com",
    "FURNITURE": "x7k2q9z{u}@paypa1.com",
    "HOUSEHOLD": "noreply@mail.shop.example-{u}.xyz",
    "MACHINERY": "team.{u}@relay.example.org",
}


def shaped(column, key, shapes):
    out = None
    for name, shape in shapes.items():
        left, right = shape.split("{u}")
        made = F.concat(F.lit(left), F.col(key).cast("string"), F.lit(right))
        out = F.when(F.col(column) == name, made) if out is None else out.when(F.col(column) == name, made)
    return out


def addresses(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", shaped("c_mktsegment", "c_custkey", SHAPES).alias("address"))


def registries(spark):
    disposable = spark.createDataFrame([("throwaway.example",), ("relay.example.org",)], "domain string")
    relays = spark.createDataFrame([("relay.example.org",)], "domain string")
    return disposable, relays, suffix_rules(spark)


NAMES = {"first_names": ["ana", "ben"], "last_names": ["lopez", "smith"], "common_words": ["team", "mail", "info"]}


def features(spark, d):
    return ops.sender_features(addresses(spark, d), ["c_custkey"], *registries(spark), **NAMES)


@query("sender_features", """
WITH a AS (SELECT c_custkey, c_mktsegment AS s, length(c_custkey::VARCHAR) AS n FROM customer)
SELECT c_custkey, CASE WHEN s = 'FURNITURE' THEN -1 ELSE 1 END AS links_in_tags, CASE s WHEN 'AUTOMOBILE' THEN 1 WHEN 'MACHINERY' THEN 1 ELSE -1 END AS sslfinal_state,
  CASE WHEN s = 'HOUSEHOLD' THEN -1 ELSE 1 END AS having_sub_domain, CASE WHEN s = 'HOUSEHOLD' THEN 0 ELSE 1 END AS sfh,
  CASE WHEN s = 'HOUSEHOLD' THEN -1 ELSE 1 END AS statistical_report, CASE WHEN s = 'HOUSEHOLD' THEN -1 ELSE 1 END AS prefix_suffix,
  CASE WHEN s IN ('FURNITURE', 'HOUSEHOLD') THEN -1 ELSE 1 END AS dnsrecord, CASE WHEN s = 'BUILDING' THEN -1 ELSE 1 END AS google_index,
  CASE s WHEN 'MACHINERY' THEN 'privacy_relay' WHEN 'FURNITURE' THEN 'suspicious_mailbox_pattern' ELSE '' END AS class,
  CASE WHEN s = 'BUILDING' THEN 'pattern' ELSE 'none' END AS fabricated FROM a""")
def sender_features(spark, d):
    f = features(spark, d)
    names = ["links_in_tags", "sslfinal_state", "having_sub_domain", "sfh", "statistical_report", "prefix_suffix", "dnsrecord", "google_index"]
    cls = F.when(F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"), F.col("disposable_status")).otherwise("")
    return f.select("c_custkey", *names, cls.alias("class"), "fabricated")


@query("sender_scores")
def sender_scores(spark, d):
    s = ops.sender_score(features(spark, d))
    return s.select("c_custkey", "risk_score", "verdict", "disposable_status", "account_observability", F.col("indicators.code").alias("codes"))


@query("sender_observability", """
SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'provider_account_unverifiable' WHEN 'MACHINERY' THEN 'not_applicable' ELSE 'unknown' END AS account_observability FROM customer""")
def sender_observability(spark, d):
    return features(spark, d).select("c_custkey", "account_observability")


@query("sender_feature_breakdown", "SELECT c_custkey, 10::BIGINT AS shown FROM customer")
def sender_feature_breakdown(spark, d):
    top = ops.feature_breakdown(features(spark, d), ["c_custkey"])
    return top.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("shown"))


@query("address_validity", r"""
WITH a AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN c_name || '@shop.example' WHEN 'FURNITURE' THEN replace(c_name, '#', '..') || '@shop.example'
  WHEN 'HOUSEHOLD' THEN c_name || ' @shop.example' ELSE c_name || '@shop' END AS a, c_mktsegment AS s FROM customer)
SELECT c_custkey, s = 'BUILDING' AS plausible FROM a""")
def address_validity(spark, d):
    seg = F.col("c_mktsegment")
    a = F.when(seg == "BUILDING", F.concat("c_name", F.lit("@shop.example"))).when(
        seg == "FURNITURE", F.concat(F.replace("c_name", F.lit("#"), F.lit("..")), F.lit("@shop.example"))).when(
        seg == "HOUSEHOLD", F.concat("c_name", F.lit(" @shop.example"))).otherwise(F.concat("c_name", F.lit("@shop")))
    return table(spark, d, "customer").select("c_custkey", hx.has_known_shape(a).alias("plausible"))


@query("from_addresses", """
SELECT o_custkey, min(o_orderkey) AS o_orderkey, o_orderpriority AS kind FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey, o_orderpriority""")
def from_addresses(spark, d):
    """Every order names its customer's mailbox in one of five spellings; open orders in a broken one."""
    o = table(spark, d, "orders")
    local = F.concat(F.lit("Box"), F.substring("o_orderpriority", 1, 1))
    at = F.when(F.col("o_orderstatus") == "P", " at ").otherwise("@")
    upper = F.when(F.col("o_orderstatus") == "F", F.upper(local)).otherwise(local)
    boxes = o.select("o_custkey", "o_orderkey", "o_orderpriority", F.concat(upper, at, F.lit("Shop.example")).alias("address"))
    out = ops.from_addresses(boxes, ["o_custkey"], "o_orderkey")
    kinds = F.element_at(F.create_map(*[F.lit(x) for p in
        (("1", "1-URGENT"), ("2", "2-HIGH"), ("3", "3-MEDIUM"), ("4", "4-NOT SPECIFIED"), ("5", "5-LOW")) for x in p]), F.substring("address", 4, 1))
    return out.select("o_custkey", "o_orderkey", kinds.alias("kind"))


@query("riskiest_sender", """
WITH r AS (SELECT o_custkey, o_orderkey, round(o_totalprice / 10000)::INTEGER AS risk_score,
  row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 10000) DESC, o_orderkey) AS k FROM orders)
SELECT o_custkey, 'o' || o_orderkey || '@shop.example' AS address, risk_score FROM r WHERE k = 1""")
def riskiest_sender(spark, d):
    scored = table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.concat(F.lit("o"), F.col("o_orderkey"), F.lit("@shop.example")).alias("address"),
        F.round(F.col("o_totalprice") / 10000).cast("int").alias("risk_score"), F.lit("low").alias("verdict"))
    return ops.riskiest_sender(scored, ["o_custkey"], "o_orderkey").drop("verdict")


@query("registry_minus_relays", """
SELECT DISTINCT c_mktsegment AS domain FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_acctbal > 9900)""")
def registry_minus_relays(spark, d):
    seg = table(spark, d, "customer").select(F.col("c_mktsegment").alias("domain"), "c_acctbal")
    return seg.select("domain").distinct().join(seg.where("c_acctbal > 9900").select("domain").distinct(), "domain", "left_anti")


assert len(wl.FEATURES) == 30
