"""End-to-end message analysis: one plan from message tables to verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.functions import text as tx
from msgrisk.operators import fuse, links, pages, rules
from msgrisk.session import materialize

SIGNAL_FLOOR = "safe"


def analyze_messages(
    messages: DataFrame,
    key: list[str],
    phrase_rules: DataFrame,
    known_hosts: list[str] = (),
    probability: DataFrame | None = None,
    threshold: float = 0.5,
    urgency: list[str] | None = None,
    threats: list[str] | None = None,
) -> DataFrame:
    """Verdict table for ``messages(key..., subject, body, is_html)``.

    Documents are parsed once and written to the checkpoint folder; phrase rules, text
    signals, link findings and markup signals are sibling branches over that table, and only
    their small finding rows are shuffled by message.
    """
    body = F.coalesce("body", F.lit(""))
    html = messages.where("is_html").select(*key, "subject", body.alias("html"))
    facts = pages.page_facts(html, [*key, "subject"])
    parsed_html = facts.select(
        *key, "subject", "text", "links", "base_href", "style_hides", "uncertain_style",
        pages.hidden_padding_signal().alias("padded"), "password_form", pages.rendering_warnings().alias("warnings"),
        "visible_chars",
    )
    images = pages.html_image_refs(facts, key)
    plain = messages.where("NOT is_html").select(
        *key, "subject", body.alias("text"), F.array().cast("array<struct<visible:string,href:string>>").alias("links"),
        F.lit(None).cast("string").alias("base_href"), F.lit(False).alias("style_hides"), F.lit(False).alias("uncertain_style"),
        F.lit(False).alias("padded"), F.lit(False).alias("password_form"), F.array().cast("array<string>").alias("warnings"),
        tx.nonspace_count(body).cast("int").alias("visible_chars"),
    )
    parsed = materialize(parsed_html.unionByName(plain))
    unsure = F.col("style_hides") | F.col("uncertain_style")
    # Extracted once: both the counts and the findings read the narrow link table.
    found_links = materialize(pages.html_links(parsed, key))
    # Text that a style sheet may hide is never scored as prose; targets still are.
    texts = parsed.select(
        *key, "subject", F.when(unsure, F.lit("")).otherwise(F.col("text")).alias("text"), "warnings", "padded", "password_form",
        unsure.alias("rendering_uncertain"), "visible_chars",
    )
    verdicts = content_scores(texts, found_links, images, key, phrase_rules, known_hosts, urgency, threats)
    if probability is None:
        verdicts = verdicts.withColumn("probability", F.lit(None).cast("double"))
    else:
        verdicts = verdicts.join(probability, key, "left")
    fused = fuse.abstain(fuse.fuse_risk(verdicts, "probability", threshold))
    return fused.select(
        *key, "total_score", "risk_floor", "rule_level", "risk_level", "combined_score", "fusion_basis", "analysis_complete",
        "warnings", "kinds", "url_count",
    )


IMAGES = ["data_images", "remote_images", "unresolved_images"]


def content_scores(
    texts: DataFrame, found_links: DataFrame, images: DataFrame, key: list[str], phrase_rules: DataFrame,
    known_hosts: list[str] = (), urgency: list[str] | None = None, threats: list[str] | None = None,
) -> DataFrame:
    """Points, floor and warnings of each message's subject, text, links and images, before fusion.

    ``texts(key..., subject, text, warnings, padded, password_form, rendering_uncertain, visible_chars)`` has one row for
    each message, ``found_links`` its links and ``images`` its image counts. Sibling branches give small finding rows;
    only those are shuffled by message.
    """
    scored = texts.withColumn("text", rules.message_text("subject", "text"))
    host = links.hx.parse_destination("destination")["host"]
    url_counts = found_links.groupBy(*key).agg(
        F.count_if(F.col("destination").rlike("(?i)^https?://")).alias("url_count"), F.max(links.shortener_host(host)).alias("shortened"),
    )
    whole = scored.join(url_counts, key, "left").na.fill({"url_count": 0, "shortened": False})
    keyed = whole.select(F.struct(*key).alias("k"), "*")
    phrases = rules.keyword_rules(keyed.select("k", "text"), phrase_rules, "k").select(
        "k", F.concat(F.lit("phrases:"), "category").alias("kind"), F.col("score").alias("points"), F.lit("safe").alias("floor")
    )
    signals = rules.text_signals(keyed, "k").select("k", F.col("signal").alias("kind"), "points", F.lit(SIGNAL_FLOOR).alias("floor"))
    flags = {
        "hidden_padding": (F.col("padded"), 4, "medium"),
        "password_form": (F.col("password_form"), 4, "medium"),
        "short_link": (F.col("shortened"), 2, "safe"),
    }
    if urgency and threats:
        flags["pressured_request"] = (tx.pressured_credential_request("text", urgency, threats), 4, "high")
    structural = keyed.select(
        "k",
        F.explode(F.array_compact(F.array(*[
            F.when(c, F.struct(F.lit(n).alias("kind"), F.lit(p).alias("points"), F.lit(f).alias("floor")))
            for n, (c, p, f) in flags.items()
        ]))).alias("s"),
    ).select("k", "s.*")
    found = links.link_findings(found_links, key, list(known_hosts))
    link_rows = found.select(F.struct(*key).alias("k"), F.concat(F.lit("link:"), "finding").alias("kind"), "points", "floor")
    rolled = fuse.message_rollup(phrases.unionByName(signals).unionByName(structural).unionByName(link_rows), ["k"])
    # A target that cannot be read leaves the analysis incomplete.
    malformed = found.where("finding = 'malformed-target'").select(*key, F.lit("malformed_link").alias("_malformed"))
    verdicts = keyed.join(rolled, "k", "left").na.fill({"total_score": 0, "risk_floor": "safe"}).join(malformed, key, "left")
    verdicts = verdicts.join(images, key, "left").na.fill(0, IMAGES)
    told = [F.when(F.col(c) > 0, F.lit(c)) for c in IMAGES] + [F.col("_malformed"), F.when(tx.substantial_han("text"), F.lit("han_text"))]
    return verdicts.select(
        *key, "subject", "text", "url_count", "rendering_uncertain", "total_score", "risk_floor", *IMAGES,
        F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"),
        F.array_distinct(F.concat("warnings", F.array_compact(F.array(*told)))).alias("warnings"),
        ((F.col("remote_images") > 0) & (F.col("visible_chars") < pages.MIN_VISIBLE)).alias("remote_image_dominant"),
        fuse.rule_verdict("total_score", "risk_floor").alias("rule_level"),
    )
