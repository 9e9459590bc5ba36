"""From findings to verdicts: message rollup, nested messages, conservative fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgrisk.functions.stats import level_of, level_rank
from msgrisk.session import cut_lineage


def message_rollup(findings: DataFrame, key: list[str]) -> DataFrame:
    """Total points and highest floor per message.

    ``findings(key..., kind, points, floor)``: a kind counts once per message, with the most
    points it was given.
    """
    once = findings.groupBy(*key, "kind").agg(F.max("points").alias("points"), F.max(level_rank("floor")).alias("rank"))
    return once.groupBy(*key).agg(
        F.sum("points").cast("int").alias("total_score"), level_of(F.max("rank")).alias("risk_floor"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
    )


def rule_verdict(total, floor) -> Column:
    """Verdict of a subject-and-body check from points and floor."""
    t, f = F.col(total), F.col(floor)
    return (
        F.when(t > 15, "critical")
        .when(f == "high", "high")
        .when((f == "medium") & (t <= 8), "medium")
        .when(t == 0, "safe")
        .when(t <= 3, "low")
        .when(t <= 8, "medium")
        .otherwise("high")
    )


def structured_verdict(total, floor, before) -> Column:
    """Verdict of a full message: a medium floor holds even with many points."""
    t, f = F.col(total), F.col(floor)
    return (
        F.when(t > 15, "critical").when(f == "high", "high").when(f == "medium", "medium").when(t > 8, "high")
        .when(t > 3, "medium").otherwise(F.col(before))
    )


def sender_contribution(verdict, score) -> Column:
    v = F.col(verdict)
    return (
        F.when(v == "critical", 6).when(v == "high", 5).when(v == "medium", 3).when(F.col(score) > 0, 1).otherwise(0)
    )


def sender_floor(verdict) -> Column:
    v = F.col(verdict)
    return F.when(v.isin("critical", "high"), "high").when(v == "medium", "medium").otherwise("safe")


# Lowest combined score a floor guarantees.
FLOOR_SCORES = {"safe": 0.0, "low": 0.10, "medium": 0.30, "high": 0.55, "critical": 0.80}


def fuse_risk(df: DataFrame, probability: str, threshold: float, score: str = "total_score", floor: str = "risk_floor") -> DataFrame:
    """Strongest evidence wins; critical needs more than the model alone."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    p = F.col(probability)
    df = df.withColumns({
        "_rules": unit(F.col(score) / F.lit(16.0)),
        "_model": F.coalesce(unit(p.cast("double")), F.lit(0.0)),
        "_floor": F.greatest(
            F.coalesce(*[F.when(F.col(floor) == n, F.lit(v)) for n, v in FLOOR_SCORES.items()], F.lit(0.0)),
            F.when(F.col(score) > 0, 0.10).otherwise(0.0),
        ),
        "_signal": p.isNotNull() & (F.coalesce(unit(p.cast("double")), F.lit(0.0)) >= threshold),
        "_support": (F.col(score) >= 9) | F.col(floor).isin("high", "critical"),
    })
    combined = F.greatest("_rules", "_model", "_floor")
    model_only = F.col("_signal") & (F.col(score) == 0) & (F.col(floor) == "safe")
    level = (
        F.when((F.col(floor) == "critical") | (F.col("_rules") >= 0.80) | ((F.col("_model") >= 0.80) & F.col("_support")), "critical")
        .when((F.col(floor) == "high") | (F.col("_rules") >= 0.55) | F.col("_signal"), "high")
        .when(combined >= 0.30, "medium")
        .when(combined >= 0.10, "low")
        .otherwise("safe")
    )
    basis = (
        F.when(model_only, "model_only").when(F.col("_signal") & ~F.col("_support"), "model_led")
        .when(F.col("_signal"), "corroborated").otherwise("other")
    )
    return df.withColumns({
        "combined_score": F.round(combined * 100, 1), "risk_level": level, "fusion_basis": basis,
    }).drop("_rules", "_model", "_floor", "_signal", "_support")


def abstain(df: DataFrame, warnings: str = "warnings", uncertain: str = "rendering_uncertain", dominant: str = "remote_image_dominant") -> DataFrame:
    """Incomplete evidence never shows as safe: the level becomes unknown and the score null.

    A lone remote-image warning beside enough visible text is the one exception.
    """
    complete = F.size(warnings) == 0
    weak = (F.col("risk_level") == "safe") | ((F.col(uncertain) | F.col(dominant)) & (F.col("risk_level") == "low"))
    only_remote = (F.size(warnings) == 1) & (F.get(warnings, 0) == "remote_images") & ~F.col(dominant)
    unknown = ~complete & weak & ~only_remote
    return df.withColumns({
        "analysis_complete": complete,
        "combined_score": F.when(~unknown, F.col("combined_score")),
        "risk_level": F.when(unknown, "unknown").otherwise(F.col("risk_level")),
    })


IMAGE_COUNTS = ["inline_images", "remote_images", "unresolved_images"]
#: Warnings about the images themselves: a parent states its own from the counts it inherits.
IMAGE_WARNINGS = ["inline_images", "remote_images", "unresolved_images"]


def nested_rollup(messages: DataFrame, counts: list[str] | None = None) -> DataFrame:
    """Fold attached messages into their parents, deepest level first, whatever the depth.

    ``messages(root_id, msg_path, total_score, risk_floor, risk_level, <image counts>, warnings)``; the path of a child
    extends its parent's by one position. A parent takes the highest score of its children; the verdict of a folded
    child (unknown counts as safe) becomes a floor of the parent, image counts add up one by one, and warnings come
    up with a prefix unless they are about images. The result has the verdict of each outer message.
    """
    counts = IMAGE_COUNTS if counts is None else counts
    current = messages.withColumn("_depth", F.size("msg_path"))
    deepest = current.agg(F.max("_depth")).first()[0] or 0
    for depth in range(deepest, 0, -1):
        parent = F.slice("msg_path", F.lit(1), F.size("msg_path") - 1)
        verdict = structured_verdict("total_score", "risk_floor", "risk_level")
        up = current.where(F.col("_depth") == depth).groupBy("root_id", parent.alias("msg_path")).agg(
            F.max("total_score").alias("_score"),
            F.max(level_rank(verdict)).alias("_rank"),
            *[F.sum(c).alias(f"_{c}") for c in counts],
            F.array_distinct(F.flatten(F.collect_list("warnings"))).alias("_warn"),
        )
        joined = current.where(F.col("_depth") < depth).join(up, ["root_id", "msg_path"], "left")
        told = F.filter(F.coalesce("_warn", F.array().cast("array<string>")), lambda w: ~w.isin(IMAGE_WARNINGS))
        attached = F.transform(told, lambda w: F.concat(F.lit("attached:"), w))
        current = joined.select(
            "root_id", "msg_path", "_depth",
            F.greatest("total_score", F.coalesce("_score", F.lit(0))).alias("total_score"),
            level_of(F.greatest(level_rank("risk_floor"), F.coalesce("_rank", F.lit(0)))).alias("risk_floor"), "risk_level",
            *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in counts],
            F.array_distinct(F.concat("warnings", attached)).alias("warnings"),
        )
        if depth % 8 == 1:
            current = cut_lineage(current)  # long chains of levels stay cheap to plan
    roots = current.where("_depth = 0").drop("_depth", "msg_path")
    return roots.withColumn("risk_level", structured_verdict("total_score", "risk_floor", "risk_level"))


def merge_visual_findings(base: DataFrame, observations: DataFrame, key: list[str]) -> DataFrame:
    """Image evidence may raise a verdict, never lower it; unverified images make safe unknown.

    ``observations(key..., risk_level, combined_score, total_score)``, one row per image.
    """
    seen = observations.groupBy(*key).agg(
        F.max(F.struct(level_rank("risk_level").alias("rank"), F.coalesce("combined_score", F.lit(-1.0)).alias("score"))).alias("_top"),
        F.max("total_score").alias("_total"),
        F.count(F.lit(1)).alias("images_seen"),
    )
    joined = base.join(seen, key, "left")
    own, top = level_rank("risk_level"), F.coalesce(F.col("_top.rank"), F.lit(0))
    raised, images = top > own, F.coalesce("images_seen", F.lit(0)) > 0
    level = F.when(raised, level_of(top)).when(images & (F.col("risk_level") == "safe"), "unknown").otherwise(F.col("risk_level"))
    best = F.nullif(F.col("_top.score"), F.lit(-1.0))
    score = F.when(raised, best).when(images & (F.col("risk_level") == "safe"), F.lit(None)).when(
        (top == own) & best.isNotNull(), F.greatest(F.coalesce("combined_score", F.lit(0.0)), best)).otherwise(F.col("combined_score"))
    return joined.withColumns({
        "risk_level": level, "combined_score": score,
        "total_score": F.greatest("total_score", F.coalesce("_total", F.lit(0))),
        "fusion_basis": F.when(raised, "visual_evidence").otherwise(F.col("fusion_basis")),
        "images_seen": F.coalesce("images_seen", F.lit(0)),
    }).drop("_top", "_total")


def best_mime_view(views: DataFrame, key: list[str], order: str, probability: str) -> DataFrame:
    """Most suspicious scorable rendering of a message, else its first abstention."""
    rank = F.struct(F.col(probability).isNotNull(), F.coalesce(probability, F.lit(0.0)), -F.col(order))
    return views.groupBy(*key).agg(F.max_by(F.struct(order, probability), rank).alias("v")).select(*key, "v.*")
