"""Phrase rules and text signals.

Rules are data: a table ``(ord, category, level, phrase)`` supplied by the caller. Scores are
capped per category, so long rule lists cannot outvote structure.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgrisk.functions import text as tx
from msgrisk.functions.text import WORD
from msgrisk.operators.scale import small_or_none

UNROLLED_RULES = 400

RULES_SCHEMA = "ord BIGINT, category STRING, level STRING, phrase STRING"


def load_rules(spark, path: str) -> DataFrame:
    """Rules from JSON lines ``{"ord", "category", "level", "phrase"}``."""
    return spark.read.schema(RULES_SCHEMA).json(path)


def message_text(subject, body) -> Column:
    """Subject and body as one line of single-spaced text without invisible controls."""
    joined = F.concat_ws("\n", F.coalesce(tx._col(subject), F.lit("")), F.coalesce(tx._col(body), F.lit("")))
    return tx.strip_format_controls(tx.squeeze_space(joined))


def _score(matched: DataFrame, key: str) -> DataFrame:
    return matched.select(
        key,
        "category",
        F.transform(F.array_sort("hits"), lambda h: h["phrase"]).alias("matched"),
        F.size("hits").alias("count"),
        F.least(F.size("hits"), F.lit(5)).alias("score"),
    )


def keyword_rules(messages: DataFrame, rules: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Matched phrases per message and category in rule order, count, capped score.

    Up to ``UNROLLED_RULES`` phrases are tested inside the projection, without any shuffle.
    Larger tables are matched as word n-grams by an equi-join. Both find the same phrases.
    """
    few = rules.select("ord", "category", "phrase").limit(UNROLLED_RULES + 1).collect()
    if len(few) <= UNROLLED_RULES:
        return _unrolled(messages, few, key, text)
    return _joined(messages, rules, key, text)


def _lead(phrase: str) -> str | None:
    """First word of a phrase, if a match must contain it as a whole word."""
    found = re.search(r"\w+", phrase.lower())
    return None if found is None or phrase.startswith("_") else found[0]


def _lowered(messages: DataFrame, rules, key: str, text: str) -> DataFrame:
    """Lower-cased text and the rule lead words it contains.

    One pass over the words decides which phrases are worth a search, so the cost hardly
    depends on how many phrases there are.
    """
    leads = sorted({_lead(r.phrase) for r in rules} - {None})
    low = messages.select(key, F.lower(text).alias("_low"))
    words = F.regexp_extract_all("_low", F.lit(rf"([{WORD}]+)"), 1)
    return low.withColumn("_leads", F.array_intersect(words, tx.literals(leads)))


def _listed(rows: DataFrame, key: str, found: Column, name: str) -> DataFrame:
    """One row for each element of ``found``; a plain ``explode`` would compute the costly array once more to drop empty ones."""
    return rows.select(key, F.explode_outer(found).alias(name)).where(F.col(name).isNotNull())


def _hit(r) -> Column:
    lead = _lead(r.phrase)
    found = tx.keyword_match("_low", r.phrase)
    return found if lead is None else F.array_contains("_leads", lead) & found


def _unrolled(messages: DataFrame, rules, key: str, text: str) -> DataFrame:
    lowered = _lowered(messages, rules, key, text)
    per_category = []
    for category in sorted({r.category for r in rules}):
        hits = [
            F.when(_hit(r), F.struct(F.lit(r.ord).cast("bigint").alias("ord"), F.lit(r.phrase).alias("phrase")))
            for r in sorted(rules, key=lambda r: r.ord)
            if r.category == category
        ]
        per_category.append(F.struct(F.lit(category).alias("category"), F.array_compact(F.array(*hits)).alias("hits")))
    found = _listed(lowered, key, F.filter(F.array(*per_category), lambda c: F.size(c["hits"]) > 0), "c")
    return _score(found.select(key, "c.category", "c.hits"), key)


def _joined(messages: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """N-gram form. A phrase with a word character at both ends matches exactly when the
    message has the same run of words and separators, so equality on runs is complete."""
    rules = rules.select("ord", "category", "phrase", F.lower("phrase").alias("gram"))
    # An underscore at an edge asks for no boundary, so such a phrase may begin or end inside a word.
    word_edges = F.col("gram").rlike(rf"^(?!_)[{WORD}]") & F.col("gram").rlike(rf"(?!_)[{WORD}]$")
    lengths = [r[0] for r in rules.where(word_edges).select(tx.word_count("gram")).distinct().collect()]
    low = messages.select(key, F.lower(text).alias("_low"))

    def runs(n: int) -> Column:
        # Every word is consumed whole; what it captures are the n words from it on (empty at the last ones).
        ahead = rf"[{WORD}]++(?:[^{WORD}]++[{WORD}]++){{{n - 1}}}" if n > 1 else rf"[{WORD}]++"
        return F.regexp_extract_all("_low", F.lit(rf"(?:(?=({ahead})))?[{WORD}]++"), 1)

    grams = _listed(low, key, F.array_distinct(F.flatten(F.array(*[runs(n) for n in sorted(lengths)]))), "gram")
    plain = rules.where(word_edges)
    matched = grams.join(small_or_none(plain) or plain, "gram").select(key, "category", "ord", "phrase")
    edged = rules.where(~word_edges).orderBy("ord").collect()
    for at in range(0, len(edged), UNROLLED_RULES):
        matched = matched.unionByName(_unrolled_hits(messages, edged[at : at + UNROLLED_RULES], key, text))
    grouped = matched.groupBy(key, "category").agg(F.collect_list(F.struct("ord", "phrase")).alias("hits"))
    return _score(grouped, key)


def _unrolled_hits(messages: DataFrame, rules, key: str, text: str) -> DataFrame:
    hits = [
        F.when(_hit(r), F.struct(F.lit(r.category).alias("category"), F.lit(r.ord).cast("bigint").alias("ord"), F.lit(r.phrase).alias("phrase")))
        for r in rules
    ]
    lowered = _lowered(messages, rules, key, text)
    return _listed(lowered, key, F.array_compact(F.array(*hits)), "h").select(key, "h.*")


# --- structural text signals ---------------------------------------------------------


def text_signals(messages: DataFrame, key: str, text: str = "text", subject: str = "subject", url_count: str = "url_count") -> DataFrame:
    """Weak text signals with their points: one row per message and signal."""
    t = F.col(text)
    n = F.length(t)
    exclamations = n - F.length(F.replace(t, F.lit("!"), F.lit("")))
    s = F.coalesce(F.col(subject), F.lit(""))
    questions = F.length(s) - F.length(F.replace(s, F.lit("?"), F.lit("")))
    signals = [
        ("exclamations", "medium", 1, exclamations >= 3),
        ("capitals", "medium", 1, (n > 60) & (tx.uppercase_ratio(t) > 0.40)),
        ("subject_questions", "medium", 1, questions >= 2),
        ("many_urls", "medium", 1, F.col(url_count) > 6),
        ("generic_salutation", "medium", 2, tx.generic_salutation(t)),
        ("large_amounts", "high", 2, F.size(tx.large_amounts(t)) > 0),
        ("generic_cta", "medium", 1, tx.count_generic_cta(t) >= 2),
        ("obfuscation", "high", 3, F.size(tx.obfuscated_terms(t)) > 0),
    ]
    rows = [
        F.when(hit, F.struct(F.lit(name).alias("signal"), F.lit(level).alias("level"), F.lit(points).alias("points")))
        for name, level, points, hit in signals
    ]
    return messages.select(key, F.explode(F.array_compact(F.array(*rows))).alias("s")).select(key, "s.*")


def safety_context(messages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Legitimacy phrases and regional wording: shown as context, never scored."""
    return messages.select(
        key,
        tx.contained_phrases(text, tx.SAFETY_PHRASES).alias("safety"),
        tx.regional_phrases(text).alias("regional"),
    )


def bounded_text(parts: DataFrame, message: str, order: str, text: str, budget: int = 60_000, bucket: str | None = None) -> DataFrame:
    """Spend one character budget over the ordered parts of each message."""
    from msgrisk.operators.scale import ordered_within_key, range_bucket, range_cuts

    sized = parts.withColumn("_len", F.length(text).cast("bigint"))
    if bucket is None:
        sized, bucket = range_bucket(sized, order, range_cuts(sized, order)), "_bucket"
    spent = ordered_within_key(sized, [message], [order], bucket, position="_pos", running={"_len": "_spent"})
    left = F.greatest(F.lit(budget) - F.col("_spent"), F.lit(0))
    return spent.withColumn("truncated", F.col("_len") > left).withColumn(
        text, F.substring(F.col(text), F.lit(1), left.cast("int"))
    ).drop("_len", "_pos", "_spent", "_bucket")
