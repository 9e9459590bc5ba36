"""Raw messages to verdicts: one ingest, sibling branches, attached messages folded upwards, one fusion for each message."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgrisk.functions import text as tx
from msgrisk.functions.stats import level_of, level_rank
from msgrisk.operators import fuse, mail, pages, sender
from msgrisk.plans.analyze import IMAGES, content_scores
from msgrisk.session import cut_lineage, materialize

KEY = mail.KEY
#: Warnings that a parent states itself, from the image counts it inherits.
IMAGE_WARNINGS = IMAGES


@dataclass
class SenderTables:
    """What sender checks compare with: registries, public-suffix rules, and word lists by name."""

    disposable: DataFrame
    relays: DataFrame
    suffix_rules: DataFrame
    names: dict[str, list[str]] = field(default_factory=dict)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def readable_parts(parts: DataFrame) -> DataFrame:
    """Text parts with what a reader sees of them; markup is parsed once and written to shared storage.

    ``(root_id, msg_path, part_ord, alternative_path, text, uncertain, padded, password_form, warnings, visible_chars, links,
    base_href, style_hides, uncertain_style, <image counts>)``.
    """
    own = [*KEY, "part_ord", "alternative_path"]
    html = F.lower("content_type") == "text/html"
    facts = pages.page_facts(parts.where(html).select(*own, F.col("content").alias("html")), own)
    unsure = F.col("style_hides") | F.col("uncertain_style")
    shown = facts.select(
        *own, "text", unsure.alias("uncertain"), pages.hidden_padding_signal().alias("padded"), "password_form",
        pages.rendering_warnings().alias("warnings"), "visible_chars", "links", "base_href", "style_hides", "uncertain_style",
    ).join(pages.html_image_refs(facts, own), own)
    no = F.lit(False)
    plain = parts.where(~html).select(
        *own, F.col("content").alias("text"), no.alias("uncertain"), no.alias("padded"), no.alias("password_form"),
        _empty("string").alias("warnings"), tx.nonspace_count(F.col("content")).cast("int").alias("visible_chars"),
        _empty("struct<visible:string,href:string>").alias("links"), F.lit(None).cast("string").alias("base_href"),
        no.alias("style_hides"), no.alias("uncertain_style"), *[F.lit(0).alias(c) for c in IMAGES],
    )
    return materialize(shown.unionByName(plain))


def message_contents(messages: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts, links and image counts of all messages, from their readable parts in order."""
    text = F.when(F.col("uncertain"), F.lit("")).otherwise(F.col("text"))
    whole = parts.groupBy(*KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_ord", text.alias("t")))), lambda p: p["t"]), "\n").alias("text"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("warnings")))).alias("_told"),
        F.bool_or("padded").alias("padded"), F.bool_or("password_form").alias("password_form"),
        F.bool_or("uncertain").alias("rendering_uncertain"), F.sum("visible_chars").cast("int").alias("visible_chars"),
        *[F.sum(c).cast("int").alias(c) for c in IMAGES],
    )
    texts = messages.select(*KEY, "subject").join(whole.drop(*IMAGES), KEY, "left").na.fill(
        {"text": "", "padded": False, "password_form": False, "rendering_uncertain": False, "visible_chars": 0})
    texts = texts.withColumn("warnings", F.coalesce("_told", _empty("string"))).drop("_told")
    by_part = pages.html_links(parts, [*KEY, "part_ord"])
    links = by_part.withColumn("link_ord", F.struct("part_ord", "link_ord")).drop("part_ord")
    return texts, materialize(links), whole.select(*KEY, *IMAGES)


def structure_scores(entities: dict[str, DataFrame], trusted_ids: list[str]) -> DataFrame:
    """Points, floor and warnings from headers, routing, authentication and attachments: one row for each message."""
    headers, messages, files = (entities[n] for n in ("headers", "messages", "attachments"))
    boxes = materialize(mail.mailboxes(headers))
    brand = mail.brand_display_identity(boxes, KEY).select(*KEY, F.lit("brand_identity").alias("kind"), "points", F.lit("high").alias("floor"))
    routing = mail.routing_mismatch(boxes, KEY).select(*KEY, F.lit("routing_mismatch").alias("kind"), "points", F.lit("safe").alias("floor"))
    own = mail.recipients(boxes, KEY, messages).where("self_addressed").select(
        *KEY, F.lit("self_addressed").alias("kind"), F.lit(1).alias("points"), F.lit("safe").alias("floor"))
    auth = mail.auth_verdict(headers, KEY, trusted_ids)
    failed = auth.where("points > 0").select(*KEY, F.concat(F.lit("authentication:"), "verdict").alias("kind"), "points", "floor")
    risky = mail.attachment_risk(files, KEY).select(*KEY, F.lit("attachments").alias("kind"), "points", "floor")
    rows = brand.unionByName(routing).unionByName(own).unionByName(failed).unionByName(risky)
    scores = rows.groupBy(*KEY).agg(
        F.sum("points").cast("int").alias("structure_score"), F.max(level_rank("floor")).alias("structure_rank"),
        F.array_sort(F.collect_set("kind")).alias("structure_kinds"),
    )
    nested = F.lower("content_type").isin("message/rfc822", "message/global")
    told = (
        mail.duplicate_headers(headers, KEY).where("name NOT IN ('to', 'cc')").select(*KEY, F.lit("duplicate_header").alias("w"))
        .unionByName(auth.where("incomplete > 0").select(*KEY, F.lit("authentication_syntax").alias("w")))
        .unionByName(files.where(~nested).select(*KEY, F.lit("attachment_not_inspected").alias("w")))
        .groupBy(*KEY).agg(F.collect_set("w").alias("_w"))
    )
    out = messages.join(scores, KEY, "left").join(told, KEY, "left").na.fill({"structure_score": 0, "structure_rank": 0})
    empty = _empty("string")
    return out.select(
        *KEY, "structure_score", "structure_rank", F.coalesce("structure_kinds", empty).alias("structure_kinds"),
        F.array_sort(F.array_union(F.coalesce("warnings", empty), F.coalesce("_w", empty))).alias("structure_warnings"),
    )


def sender_scores(headers: DataFrame, tables: SenderTables) -> DataFrame:
    """Contribution of each message's riskiest From mailbox (key..., sender, sender_verdict, sender_points, sender_rank)."""
    boxes = mail.mailboxes(headers.where("name = 'from'"))
    order = F.struct("ord", "box_ord")
    known = sender.from_addresses(boxes.select(*KEY, order.alias("place"), "address"), KEY, "place")
    features = sender.sender_features(known, [*KEY, "place"], tables.disposable, tables.relays, tables.suffix_rules, **tables.names)
    riskiest = sender.riskiest_sender(sender.sender_score(features).withColumn("n", F.col("place.ord") * 100_000 + F.col("place.box_ord")), KEY, "n")
    return riskiest.select(
        *KEY, F.col("address").alias("sender"), F.col("verdict").alias("sender_verdict"),
        fuse.sender_contribution("verdict", "risk_score").alias("sender_points"), level_rank(fuse.sender_floor("verdict")).alias("sender_rank"),
    )


def view_probabilities(messages: DataFrame, parts: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Highest probability over a message's certain renderings (key..., probability, ml_warnings).

    ``score`` takes ``(root_id, msg_path, view, subject, body)`` and returns one row for each with ``probability`` (null where
    it abstains) and ``ml_status``.
    """
    contents = parts.select(*KEY, "part_ord", "alternative_path", F.col("text").alias("content"), "uncertain")
    views = mail.mime_views(contents, KEY)
    bare = messages.join(parts.select(*KEY).distinct(), KEY, "left_anti")  # a message without text has one empty view
    none = bare.select(*KEY, F.lit(1).alias("view"), F.lit("").alias("body"), F.lit(False).alias("uncertain"), F.lit(False).alias("truncated"))
    views = materialize(views.unionByName(none).join(messages.select(*KEY, "subject"), KEY))
    scored = score(views.where("NOT uncertain").select(*KEY, "view", "subject", "body")).select(*KEY, "view", "probability", "ml_status")
    joined = views.select(*KEY, "view", "uncertain", "truncated").join(scored, [*KEY, "view"], "left")
    best = joined.groupBy(*KEY).agg(
        F.max("probability").alias("probability"), F.count(F.lit(1)).alias("_views"), F.count("probability").alias("_scored"),
        F.bool_or("truncated").alias("_cut"), F.min_by("ml_status", F.when(F.col("ml_status").isNotNull(), F.col("view"))).alias("_status"),
    )
    abstained = F.col("probability").isNull()
    told = F.array_compact(F.array(
        F.when((F.col("_views") > 1) & (F.col("_scored") < F.col("_views")), F.lit("mime_alternatives_unscored")),
        F.when(F.col("_cut"), F.lit("mime_alternatives_truncated")),
        F.when(abstained & F.col("_status").isin("insufficient_context", "insufficient_feature_coverage"), F.col("_status")),
    ))
    return best.select(*KEY, "probability", told.alias("ml_warnings"))


def fold_attached(messages: DataFrame, threshold: float) -> DataFrame:
    """Fuse every message, deepest first; what an attached message has become is evidence for the one around it.

    The outer message takes the highest points of both, the attached verdict as a floor (unknown counts as safe), its image
    counts, and its warnings with a prefix, save those about images, which follow from the counts.
    """
    current = messages.withColumn("_depth", F.size("msg_path"))
    deepest = current.agg(F.max("_depth")).first()[0] or 0
    settled = None
    for depth in range(deepest, -1, -1):
        level = current.where(F.col("_depth") == depth)
        seen = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in IMAGES]))
        level = level.withColumn("warnings", F.array_sort(F.array_distinct(F.concat("warnings", seen))))
        level = fuse.abstain(fuse.fuse_risk(level, "probability", threshold)).drop("_depth")
        if depth:
            level = cut_lineage(level)  # read by the result and by the level above
            up = level.groupBy("root_id", F.slice("msg_path", F.lit(1), F.size("msg_path") - 1).alias("msg_path")).agg(
                F.max("total_score").alias("_score"), F.max(level_rank("risk_level")).alias("_rank"),
                *[F.sum(c).cast("int").alias(f"_{c}") for c in IMAGES],
                F.array_distinct(F.flatten(F.collect_list("warnings"))).alias("_told"),
                F.bool_or((F.col("remote_images") > 0) & (F.col("risk_level") == "unknown")).alias("_dominant"),
                F.sum(F.lit(1) + F.col("attached_messages")).cast("int").alias("_attached"),
            )
            told = F.transform(
                F.filter(F.coalesce("_told", _empty("string")), lambda w: ~w.isin(IMAGE_WARNINGS)), lambda w: F.concat(F.lit("attached:"), w))
            above = current.where(F.col("_depth") < depth).join(up, KEY, "left")
            current = above.withColumns({
                "total_score": F.greatest("total_score", F.coalesce("_score", F.lit(0))),
                "risk_floor": level_of(F.greatest(level_rank("risk_floor"), F.coalesce("_rank", F.lit(0)))),
                "warnings": F.concat("warnings", told),
                "remote_image_dominant": F.col("remote_image_dominant") | F.coalesce("_dominant", F.lit(False)),
                "attached_messages": F.col("attached_messages") + F.coalesce("_attached", F.lit(0)),
                **{c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in IMAGES},
            }).drop("_score", "_rank", "_told", "_dominant", "_attached", *[f"_{c}" for c in IMAGES])
        settled = level if settled is None else settled.unionByName(level)
    return settled


def analyze_eml(
    raw: DataFrame, phrase_rules: DataFrame, known_hosts: list[str] = (), trusted_ids: list[str] = (), senders: SenderTables | None = None,
    score: Callable[[DataFrame], DataFrame] | None = None, threshold: float = 0.5, urgency: list[str] | None = None,
    threats: list[str] | None = None, root: str = "path", content: str = "content",
) -> DataFrame:
    """Verdicts of raw messages and of all messages attached to them, one row each (an outer message has an empty path).

    Bytes are decoded once. Four branches read the decoded entities: texts, links and images of the readable parts; headers,
    routing, authentication and attachments; the riskiest sender (if ``senders`` is given); and a text classifier over all
    renderings (if ``score`` is given, see ``view_probabilities``). They meet once for each message, then attached messages
    fold into the ones around them. A null ``content`` has no rows; an empty one is a message without parts or headers.
    """
    entities = mail.ingest_eml(raw, root, content)
    messages = entities["messages"]
    parts = readable_parts(entities["parts"])
    own = content_scores(*message_contents(messages, parts), KEY, phrase_rules, known_hosts, urgency, threats)
    met = own.join(structure_scores(entities, list(trusted_ids)), KEY)
    if senders is None:
        met = met.withColumns({"sender": F.lit(None).cast("string"), "sender_verdict": F.lit(None).cast("string"), "sender_points": F.lit(0), "sender_rank": F.lit(0)})
    else:
        met = met.join(sender_scores(entities["headers"], senders), KEY, "left").na.fill({"sender_points": 0, "sender_rank": 0})
    if score is None:
        met = met.withColumns({"probability": F.lit(None).cast("double"), "ml_warnings": _empty("string")})
    else:
        met = met.join(view_probabilities(messages, parts, score), KEY, "left")
    met = met.withColumns({
        "total_score": F.col("total_score") + F.col("structure_score") + F.col("sender_points"),
        "risk_floor": level_of(F.greatest(level_rank("risk_floor"), "structure_rank", "sender_rank")),
        "kinds": F.array_sort(F.array_union("kinds", "structure_kinds")),
        "warnings": F.concat("warnings", "structure_warnings", F.coalesce("ml_warnings", _empty("string"))),
        "attached_messages": F.lit(0),
    })
    met = met.withColumn("rule_level", fuse.structured_verdict("total_score", "risk_floor", "rule_level"))
    folded = fold_attached(materialize(met), threshold)
    return folded.select(
        F.col("root_id"), "msg_path", "subject", "sender", "sender_verdict", "structure_score", "sender_points", "total_score", "risk_floor",
        "rule_level", "probability", "risk_level", "combined_score", "fusion_basis", "analysis_complete", "warnings", "kinds", "url_count",
        *IMAGES, "attached_messages",
    )
