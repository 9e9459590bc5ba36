"""Text functions and phrase rules over documents, conversations, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgrisk.catalog.registry import SQL_WORD, query, table
from msgrisk.functions import hashing
from msgrisk.functions import text as tx
from msgrisk.operators import rules as ops
from msgrisk.operators import vision


@query("redacted_text", rf"""
WITH r AS (SELECT doc_id, text, regexp_replace(text, '[{SQL_WORD}.!#$%&''*+/=?^`{{|}}~-]+@([{SQL_WORD}.-]+)', '[mailbox]@\1', 'g') AS red FROM documents)
SELECT doc_id, sha256(red) AS digest, (length(red) - length(replace(red, '[mailbox]', ''))) // 9 AS mailboxes FROM r""")
def redacted_text(spark, d):
    docs = table(spark, d, "documents").select("doc_id", tx.redact("text").alias("red"))
    count = ((F.length("red") - F.length(F.replace("red", F.lit("[mailbox]"), F.lit("")))) / 9).cast("bigint")
    return docs.select("doc_id", F.sha2("red", 256).alias("digest"), count.alias("mailboxes"))


@query("redacted_urls", r"""
SELECT page_id, regexp_extract(url, '^(https?://[^?#]*)', 1) AS red FROM pages""")
def redacted_urls(spark, d):
    return table(spark, d, "pages").select("page_id", tx.redact("url").alias("red"))


@query("context_gate", rf"""
WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[{SQL_WORD}]+')) AS words, length(regexp_replace(text, '[\s\p{{Z}}]', '', 'g')) AS chars FROM documents)
SELECT doc_id, words::BIGINT AS words, chars::BIGINT AS chars, words >= 5 AND chars >= 40 AS scorable FROM w""")
def context_gate(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", tx.word_count("text").cast("bigint").alias("words"), tx.nonspace_count("text").cast("bigint").alias("chars"),
        tx.enough_context("text").alias("scorable"))


@query("script_coverage", r"""
SELECT lang, sum(len(regexp_extract_all(text, '\p{Han}')))::BIGINT AS han, count(*) FILTER (WHERE len(regexp_extract_all(text, '\p{Han}')) >= 12)::BIGINT AS limited,
  sum(len(regexp_extract_all(text, '\p{Lu}')))::BIGINT AS capitals FROM documents GROUP BY lang""")
def script_coverage(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("lang").agg(
        F.sum(tx.han_count("text")).cast("bigint").alias("han"), F.count_if(tx.substantial_han("text")).alias("limited"),
        F.sum(tx.class_count("text", r"\p{Lu}")).cast("bigint").alias("capitals"))


@query("entropy_profile", r"""
WITH n AS (SELECT c_custkey, lower(c_name || c_mktsegment) AS s FROM customer),
ch AS (SELECT c_custkey, any_value(length(s)) AS n, c, count(*) AS k FROM n, unnest(string_split(s, '')) t(c) WHERE c <> '' GROUP BY c_custkey, c)
SELECT c_custkey, round(sum(-(k::DOUBLE / n) * log2(k::DOUBLE / n)), 6) AS entropy, round(sum(CASE WHEN c BETWEEN '0' AND '9' THEN k ELSE 0 END)::DOUBLE / any_value(n), 6) AS digits,
  round(sum(CASE WHEN c IN ('a','e','i','o','u') THEN k ELSE 0 END)::DOUBLE / sum(CASE WHEN c BETWEEN 'a' AND 'z' THEN k ELSE 0 END), 6) AS vowels,
  round(count(*)::DOUBLE / any_value(n), 6) AS distinct_share, round(max(k)::DOUBLE / any_value(n), 6) AS top_share FROM ch GROUP BY c_custkey""")
def entropy_profile(spark, d):
    names = table(spark, d, "customer").select("c_custkey", F.lower(F.concat("c_name", "c_mktsegment")).alias("s"))
    return names.select(
        "c_custkey", F.round(tx.shannon_entropy("s"), 6).alias("entropy"), F.round(tx.digit_ratio("s"), 6).alias("digits"),
        F.round(tx.vowel_ratio("s"), 6).alias("vowels"), F.round(tx.unique_ratio("s"), 6).alias("distinct_share"),
        F.round(tx.repeat_ratio("s"), 6).alias("top_share"))


_GLYPH = "lower(c_name || ' vvarn ' || c_mktsegment)"
for _a, _b in tx.DOUBLE_GLYPHS:
    _GLYPH = f"replace({_GLYPH}, '{_a}', '{_b}')"
_GLYPH = f"translate({_GLYPH}, '{''.join(a for a, _ in tx.SINGLE_GLYPHS)}', '{''.join(b for _, b in tx.SINGLE_GLYPHS)}')"


@query("lookalike_normalization", f"SELECT c_custkey, {_GLYPH} AS normal, translate(lower(c_name), '013457', 'oleast') AS link_form FROM customer")
def lookalike_normalization(spark, d):
    c = table(spark, d, "customer")
    return c.select(
        "c_custkey", tx.normalize_homoglyphs(F.concat("c_name", F.lit(" vvarn "), "c_mktsegment")).alias("normal"),
        tx.digit_lookalike(F.lower("c_name")).alias("link_form"))


@query("latin_skeletons", "SELECT doc_id, sha256(strip_accents(lower(upper(text)))) AS skeleton FROM documents")
def latin_skeletons(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(tx.latin_skeleton("text"), 256).alias("skeleton"))


@query("obfuscated_terms", """
SELECT event_id, CASE WHEN value >= 5 THEN ['login', 'account'] ELSE []::VARCHAR[] END AS terms FROM events""")
def obfuscated_terms(spark, d):
    """High-value events spell two protected terms with zeros, the others spell them plainly."""
    events = table(spark, d, "events")
    plain = F.concat(F.lit("account login "), "event_type")
    text = F.when(F.col("value") >= 5, F.translate(plain, "o", "0")).otherwise(plain)
    return events.select("event_id", tx.obfuscated_terms(text).alias("terms"))


@query("large_amounts", """
SELECT o_orderkey, CASE WHEN o_totalprice >= 10000 THEN ['USD ' || o_totalprice] ELSE []::VARCHAR[] END AS amounts FROM orders""")
def large_amounts(spark, d):
    orders = table(spark, d, "orders")
    note = F.concat(F.lit("Order total USD "), F.col("o_totalprice").cast("string"), F.lit(" due"))
    return orders.select("o_orderkey", tx.large_amounts(note).alias("amounts"))


@query("tagged_digests", "SELECT doc_id, sha256('text'::BLOB || '\\x00'::BLOB || encode(text)) AS digest FROM documents")
def tagged_digests(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.tagged_digest("text", "text").alias("digest"))


@query("date_validity", r"""
WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN strftime(o_orderdate, '%Y-%d-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s FROM orders)
SELECT o_orderkey, substr(s, 1, 7) AS month, try_strptime(s, '%Y-%m-%d') IS NOT NULL AS valid FROM t""")
def date_validity(spark, d):
    """Open orders write day and month in the wrong order, which is often no calendar date."""
    orders = table(spark, d, "orders")
    s = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "yyyy-dd-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return orders.select("o_orderkey", tx.month_of(s).alias("month"), tx.is_calendar_date(s).alias("valid"))


@query("bounded_conversations", """
WITH p AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM conversations)
SELECT conv_id, turn, substr(text, 1, greatest(1000 - spent, 0)::BIGINT) AS text, length(text) > greatest(1000 - spent, 0) AS truncated FROM p""")
def bounded_conversations(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return ops.bounded_text(turns, "conv_id", "turn", "text", budget=1000)


# --- phrase rules --------------------------------------------------------------------


def passage_openings(spark, d):
    """One rule per benchmark passage: its first three words."""
    words = F.slice(F.split(F.lower("text"), " "), 1, 3)
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("ord"), F.when(F.length("text") > 150, "long").otherwise("short").alias("category"),
        F.lit("high").alias("level"), F.regexp_replace(F.array_join(words, " "), "[.,]+$", "").alias("phrase"))


def passage_bigrams(spark, d):
    """Every two neighboring words of the benchmark passages that have no punctuation between them."""
    words = F.split(F.regexp_replace(F.lower("text"), "[.,]", " . "), " +")
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, F.lit(2)), " "))
    pairs = table(spark, d, "benchmark").select(words.alias("w")).where("size(w) > 1").select(F.explode(grams).alias("phrase"))
    pairs = pairs.where(~F.col("phrase").contains(".")).where("length(phrase) >= 9").distinct()
    return pairs.select(F.xxhash64("phrase").alias("ord"), F.substring("phrase", 1, 1).alias("category"), F.lit("low").alias("level"), "phrase")


def as_messages(spark, d):
    return table(spark, d, "documents").select("doc_id", ops.message_text(F.lit(""), "text").alias("text"))


_MSG = r"m AS (SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g')) AS text, lower(trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))) AS low FROM documents)"


@query("keyword_rules", rf"""
WITH {_MSG},
r AS (SELECT item_id AS ord, CASE WHEN length(text) > 150 THEN 'long' ELSE 'short' END AS category,
  regexp_replace(array_to_string(string_split(lower(text), ' ')[1:3], ' '), '[.,]+$', '') AS phrase FROM benchmark),
h AS (SELECT doc_id, category, ord, phrase FROM m JOIN r ON contains(low, phrase)
  AND regexp_matches(low, '(^|[^{SQL_WORD}])' || regexp_escape(phrase) || '($|[^{SQL_WORD}])'))
SELECT doc_id, category, list(phrase ORDER BY ord) AS matched, count(*)::BIGINT AS count, least(count(*), 5)::BIGINT AS score FROM h GROUP BY doc_id, category""")
def keyword_rules(spark, d):
    out = ops.keyword_rules(as_messages(spark, d), passage_openings(spark, d), "doc_id")
    return out.withColumn("count", F.col("count").cast("bigint")).withColumn("score", F.col("score").cast("bigint"))


@query("keyword_rules_large", rf"""
WITH {_MSG},
w AS (SELECT regexp_split_to_array(regexp_replace(lower(text), '[.,]', ' . ', 'g'), ' +') AS w FROM benchmark),
r AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS phrase FROM w, unnest(range(1, len(w))) t(i) WHERE len(w) > 1),
rr AS (SELECT phrase, substr(phrase, 1, 1) AS category FROM r WHERE NOT contains(phrase, '.') AND length(phrase) >= 9),
p AS (SELECT doc_id, regexp_extract_all(low, '[{SQL_WORD}]+|[^{SQL_WORD}]+') AS p FROM m),
g AS (SELECT DISTINCT doc_id, p[i] || p[i + 1] || p[i + 2] AS phrase FROM p, unnest(range(1, len(p) - 1)) t(i))
SELECT doc_id, category, count(*)::BIGINT AS count, least(count(*), 5)::BIGINT AS score FROM g JOIN rr USING (phrase) GROUP BY doc_id, category""")
def keyword_rules_large(spark, d):
    out = ops.keyword_rules(as_messages(spark, d), passage_bigrams(spark, d), "doc_id")
    return out.select("doc_id", "category", F.col("count").cast("bigint").alias("count"), F.col("score").cast("bigint").alias("score"))


@query("text_signals", rf"""
WITH {_MSG},
s AS (SELECT doc_id, length(text) - length(replace(text, '!', '')) AS ex, len(regexp_extract_all(text, '\p{{Lu}}'))::DOUBLE / nullif(len(regexp_extract_all(text, '\p{{L}}')), 0) AS caps, length(text) AS n FROM m)
SELECT doc_id, 'exclamations' AS signal, 'medium' AS level, 1 AS points FROM s WHERE ex >= 3
UNION ALL SELECT doc_id, 'capitals', 'medium', 1 FROM s WHERE n > 60 AND caps > 0.40""")
def text_signals(spark, d):
    messages = as_messages(spark, d).withColumn("subject", F.lit("")).withColumn("url_count", F.lit(0))
    return ops.text_signals(messages, "doc_id")


@query("safety_context", """
SELECT conv_id, turn, contains(lower(text), 'sent from') AS sent_from, contains(lower(text), 'unsubscribe') AS unsubscribe FROM conversations""")
def safety_context(spark, d):
    turns = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("k"), "text")
    out = ops.safety_context(turns, "k")
    return out.select("k.conv_id", "k.turn", F.array_contains("safety", "sent from").alias("sent_from"),
                      F.array_contains("safety", "unsubscribe").alias("unsubscribe"))


# --- recognition benchmark -----------------------------------------------------------


def _recognition(spark, d):
    """Part names as reference texts; small parts were never read, others confuse o and 0."""
    part = table(spark, d, "part")
    manifest = part.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, "eng").otherwise("chi_sim").alias("language"),
        F.when(F.col("p_retailprice") > 1200, "phishing").otherwise("benign").alias("label"), F.col("p_name").alias("expected_text"),
        F.array("p_brand").alias("expected_qr_payloads"), F.lit(None).cast("array<string>").alias("expected_urls"))
    outcomes = part.where("p_size > 5").select(
        F.col("p_partkey").alias("id"), F.lit("processed").alias("status"), F.translate("p_name", "o", "0").alias("text"),
        F.when(F.col("p_size") > 40, F.array("p_brand", "p_type")).otherwise(F.array("p_brand")).alias("qr_payloads"),
        F.col("p_size").cast("double").alias("elapsed_ms"), F.when(F.col("p_retailprice") > 1000, "high").otherwise("safe").alias("risk_level"))
    return manifest, outcomes


@query("ocr_summary", """
WITH r AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN 'eng' ELSE 'chi_sim' END AS language, p_size > 5 AS usable, p_name,
  CASE WHEN p_size > 5 THEN translate(p_name, 'o', '0') ELSE '' END AS text, p_size > 40 AS extra,
  CASE WHEN p_retailprice > 1200 THEN 'phishing' ELSE 'benign' END AS label, CASE WHEN p_retailprice > 1000 THEN 'phishing' ELSE 'benign' END AS pred FROM part)
SELECT language, count(*)::BIGINT AS count, round(sum(CASE WHEN usable THEN length(p_name) - length(replace(p_name, 'o', '')) ELSE length(p_name) END)::DOUBLE / sum(length(p_name)), 6) AS character_error_rate,
  round(count(*) FILTER (WHERE usable AND text = p_name)::DOUBLE / count(*), 6) AS text_exact_rate,
  round(count(*) FILTER (WHERE usable AND NOT extra)::DOUBLE / count(*), 6) AS qr_exact_set_rate,
  round(count(*) FILTER (WHERE usable)::DOUBLE / count(*), 6) AS qr_payload_recall, count(*) FILTER (WHERE extra)::BIGINT AS qr_extra_payload_count,
  round(count(*) FILTER (WHERE usable AND pred = label)::DOUBLE / count(*), 6) AS risk_correct_rate, count(*) FILTER (WHERE NOT usable)::BIGINT AS missing FROM r GROUP BY language""")
def ocr_summary(spark, d):
    out = vision.ocr_summary(vision.score_outcomes(*_recognition(spark, d)), ["language"])
    rates = ["character_error_rate", "text_exact_rate", "qr_exact_set_rate", "qr_payload_recall", "risk_correct_rate"]
    return out.select("language", "count", *[F.round(r, 6).alias(r) for r in rates],
                      F.col("qr_extra_payload_count").cast("bigint").alias("qr_extra_payload_count"), "missing")


@query("ocr_rows", """
SELECT p_partkey AS id, CASE WHEN p_size > 5 THEN 'processed' ELSE 'missing' END AS status,
  levenshtein(p_name, CASE WHEN p_size > 5 THEN translate(p_name, 'o', '0') ELSE '' END)::BIGINT AS edit_distance FROM part""")
def ocr_rows(spark, d):
    return vision.score_outcomes(*_recognition(spark, d)).select("id", "status", F.col("edit_distance").cast("bigint").alias("edit_distance"))
