"""Labeled message corpora: families, isolation, folds, samples.

A corpus has one row per message with a unique, data-derived order column (``row_ord``).
Grouping always runs on narrow columns (family digest, order, label); message text only
moves once, when kept rows are fetched by their unique order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from msgrisk.functions.hashing import seeded_order
from msgrisk.functions.text import family_id, template_fingerprint
from msgrisk.operators.scale import (
    dimension_join,
    hash_bucket,
    ordered_within_key,
    range_bucket,
    range_cuts,
    salted_join,
)
from msgrisk.session import cut_lineage, materialize


def with_family(corpus: DataFrame, text: str = "text") -> DataFrame:
    return corpus.withColumn("family", family_id(text))


def family_stats(families: DataFrame, order: str = "row_ord", label: str = "label") -> DataFrame:
    """One narrow row per family: first row, number of copies, label agreement."""
    return families.groupBy("family").agg(
        F.min(order).alias("first_ord"),
        F.count(F.lit(1)).alias("copies"),
        (F.min(label) != F.max(label)).alias("_conflict"),
    ).withColumn("conflict", F.coalesce("_conflict", F.lit(False))).drop("_conflict")


def dedup_families(corpus: DataFrame, order: str = "row_ord") -> DataFrame:
    """Keep the first row of every family whose labels agree."""
    stats = family_stats(with_family(corpus), order)
    kept = stats.where(~F.col("conflict")).select(F.col("first_ord").alias(order), "family", "copies")
    return corpus.join(kept, order)


def family_report(corpus: DataFrame, order: str = "row_ord") -> DataFrame:
    """Per source: rows, kept rows, duplicates removed, rows of conflicting families."""
    per_source = with_family(corpus).groupBy("family", "source").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(order).alias("first_ord"),
        F.min("label").alias("low"),
        F.max("label").alias("high"),
    )
    # Already collapsed to one row per (family, source), so this window stays small.
    family = Window.partitionBy("family")
    judged = per_source.select(
        "source",
        "n",
        F.coalesce(F.min("low").over(family) != F.max("high").over(family), F.lit(False)).alias("conflict"),
        (F.col("first_ord") == F.min("first_ord").over(family)).alias("holds_first"),
    )
    kept = F.when(~F.col("conflict") & F.col("holds_first"), 1).otherwise(0)
    return judged.groupBy("source").agg(
        F.sum("n").alias("n_rows"),
        F.sum(kept).cast("bigint").alias("kept"),
        F.sum(F.when(F.col("conflict"), 0).otherwise(F.col("n") - kept)).cast("bigint").alias("duplicates"),
        F.sum(F.when(F.col("conflict"), F.col("n")).otherwise(0)).cast("bigint").alias("conflicting"),
    )


def source_profile(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("label") == 1).cast("bigint")).alias("phishing"),
        F.sum((F.col("label") == 0).cast("bigint")).alias("legitimate"),
    )


def union_corpora(*corpora: DataFrame) -> DataFrame:
    """Concatenate corpora in the given order; earlier sources win ties in ``row_ord``."""
    out = None
    for rank, part in enumerate(corpora):
        part = part.withColumn("source_rank", F.lit(rank))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("row_ord", F.struct("source_rank", "row_ord"))


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key by a unique order column; heavy keys collapse before the shuffle."""
    first = df.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def duplicate_ordinal(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """How many earlier copies each row has, and where the first one is."""
    bucketed = range_bucket(df, order, range_cuts(df, order))
    numbered = ordered_within_key(bucketed, keys, [order], "_bucket", position="ordinal").drop("_bucket")
    first = df.groupBy(*keys).agg(F.min(order).alias("first_ord"))
    return salted_join(numbered, first, keys, "inner", [order])


# --- isolation -----------------------------------------------------------------------


def exclude_reserved_families(corpus: DataFrame, reserved: DataFrame, order: str = "row_ord") -> DataFrame:
    """Rows whose family is neither reserved nor repeated earlier in the corpus.

    The narrow tables of families are written, so no later filter computes them again from the texts.
    """
    taken = materialize(with_family(reserved).select("family").distinct())
    firsts = materialize(with_family(corpus).groupBy("family").agg(F.min(order).alias(order)))
    kept = firsts.join(taken, "family", "left_anti")
    return corpus.join(kept, order)


def temporal_partition(observed_at: Column, cutoff: str, holdout_start: str) -> Column:
    """Holdout from its start, validation from the cutoff, everything older or undated trains."""
    start, cut = F.lit(holdout_start).cast("timestamp"), F.lit(cutoff).cast("timestamp")
    return F.when(observed_at >= start, "holdout").when(observed_at >= cut, "validation").otherwise("train")


def temporal_family_isolation(df: DataFrame, family: str = "family", order: str = "row_ord") -> DataFrame:
    """Let every family live in its latest partition only.

    Input has ``partition``; output has one row per family and kept partition: first row,
    copies, and how many of the family's earlier-partition rows were excluded.
    """
    in_part = {p: F.col("partition") == p for p in ("train", "validation", "holdout")}
    counted = df.groupBy(family).agg(
        *[F.count_if(c).alias(f"n_{p}") for p, c in in_part.items()],
        *[F.min(F.when(c, F.col(order))).alias(f"first_{p}") for p, c in in_part.items()],
    )
    kept = F.when(F.col("n_holdout") > 0, "holdout").when(F.col("n_validation") > 0, "validation").otherwise("train")
    return counted.withColumn("partition", kept).select(
        family,
        "partition",
        F.coalesce(
            *[F.when(F.col("partition") == p, F.col(f"first_{p}")) for p in in_part]
        ).alias("first_ord"),
        F.coalesce(*[F.when(F.col("partition") == p, F.col(f"n_{p}")) for p in in_part]).alias("copies"),
        F.when(F.col("partition") == "holdout", F.col("n_train") + F.col("n_validation"))
        .when(F.col("partition") == "validation", F.col("n_train"))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("excluded"),
    )


def exclude_heldout_groups(train: DataFrame, test: DataFrame, group: str = "group_id", spread_by: str = "row_ord") -> DataFrame:
    return salted_join(train, test.select(group).distinct(), [group], "left_anti", [spread_by])


def overlap_counts(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """How many distinct values occur on both sides."""
    shared = left.select(column).intersect(right.select(column))
    return shared.agg(F.count(F.lit(1)).alias("shared"))


def reference_overlap(cohort: DataFrame, reference: DataFrame, order: str = "row_ord") -> DataFrame:
    """One row per distinct cohort text: copies, first row, and why it is kept or not.

    Texts are read and normalized once; the joins work on a narrow table of digests.
    """
    def keyed(df):
        return materialize(df.select(order, F.sha2("text", 256).alias("exact"), template_fingerprint("text").alias("template")))

    distinct = keyed(cohort).groupBy("exact").agg(
        F.min(order).alias("first_ord"), F.count(F.lit(1)).alias("copies"), F.first("template").alias("template")
    )
    ref = keyed(reference).select("exact", "template")
    ref_exact = ref.select("exact").distinct().withColumn("in_exact", F.lit(True))
    ref_template = ref.select("template").where("template IS NOT NULL").distinct().withColumn("in_template", F.lit(True))
    joined = distinct.join(ref_exact, "exact", "left")
    joined = salted_join(joined, ref_template, ["template"], "left", ["exact"])
    status = F.when(F.col("in_exact"), "overlap_exact").when(F.col("in_template"), "overlap_template").otherwise("kept")
    return joined.select("exact", "template", "first_ord", "copies", status.alias("status"))


def overlap_summary(overlap: DataFrame) -> DataFrame:
    """Row counts by outcome; copies after the first are duplicates."""
    return overlap.agg(
        F.sum("copies").alias("input"),
        F.sum(F.col("copies") - 1).cast("bigint").alias("duplicates"),
        F.count_if(F.col("status") == "overlap_exact").alias("overlap_exact"),
        F.count_if(F.col("status") == "overlap_template").alias("overlap_template"),
        F.count_if(F.col("status") == "kept").alias("eligible"),
    )


def label_conflicts(df: DataFrame, key: str, metadata: list[str]) -> DataFrame:
    """Content keys seen with more than one label or metadata tuple."""
    tuple_ = F.struct(*metadata)
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(tuple_).alias("_low"), F.max(tuple_).alias("_high")
    ).where(F.col("_low") != F.col("_high")).select(key, "n_rows")


# --- connected groups ----------------------------------------------------------------


def _checksum(edges: DataFrame):
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def _star(edges: DataFrame, small: bool, few_edges: bool) -> DataFrame:
    """One contraction step: hang the neighbors of every node on its least neighbor.

    ``few_edges`` says that the counted edge set is small, so its nodes can be broadcast;
    otherwise nodes of high degree are salted.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    linked = both.join(F.broadcast(least), "u") if few_edges else salted_join(both, least, ["u"], "inner", ["v"])
    if small:
        moved = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
    return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _downward(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def connected_groups(edges: DataFrame, max_rounds: int = 50, broadcast_edges: int = 200_000) -> DataFrame:
    """Connected components of an edge table ``(u, v)``: alternating star contraction.

    Each round is two shuffles over a shrinking edge set and is checkpointed, so lineage
    stays short and a lost executor replays one round. Output ``(node, component)`` names a
    component by its least node; nodes without an edge to another node are their own.
    """
    nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    current = cut_lineage(_downward(edges))
    seen = _checksum(current)
    for _ in range(max_rounds):
        few = seen[0] <= broadcast_edges
        current = cut_lineage(_star(_downward(_star(current, False, few)), True, few))
        now = _checksum(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def merge_campaign_groups(corpus: DataFrame, group: str = "group_id", order: str = "row_ord") -> DataFrame:
    """Groups linked by a shared family whose labels agree, with their component.

    Edges run between families and groups, so a family shared by many groups costs one edge
    per group, never a pair of groups.
    """
    families = materialize(with_family(corpus).select(order, group, "label", "family"))
    clean = family_stats(families, order).where(~F.col("conflict")).select("family")
    pairs = families.select("family", group).distinct().join(clean, "family", "left_semi")
    # Group names sort before family names, so a component is named by its least group.
    edges = pairs.select(F.concat(F.lit("1:"), "family").alias("u"), F.concat(F.lit("0:"), F.col(group)).alias("v"))
    parts = connected_groups(edges).where(F.col("node").startswith("0:"))
    named = parts.select(F.substr(F.col("node"), F.lit(3)).alias(group), F.substr(F.col("component"), F.lit(3)).alias("component"))
    every = corpus.select(group).distinct()
    return every.join(named, group, "left").select(group, F.coalesce("component", group).alias("component"))


# --- folds and samples ---------------------------------------------------------------


def fold_of_groups(df: DataFrame, group: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """A fold per group, balanced within each label signature up to one group."""
    groups = df.groupBy(group).agg(F.min(label).alias("_low"), F.max(label).alias("_high"), F.count(F.lit(1)).alias("rows"))
    keyed = groups.withColumn("stratum", F.concat_ws("-", "_low", "_high")).withColumn("_hash", seeded_order(seed, group))
    keyed = keyed.withColumn("_bucket", hash_bucket(F.col("_hash")))
    numbered = ordered_within_key(keyed, ["stratum"], ["_hash", group], "_bucket")
    return numbered.select(group, "stratum", "rows", ((F.col("position") - 1) % k).cast("int").alias("fold"))


def fold_assignment(df: DataFrame, group: str, label: str, k: int, spread_by: str, seed: int = 42) -> DataFrame:
    folds = fold_of_groups(df, group, label, k, seed).select(group, "fold")
    return salted_join(df, folds, [group], "inner", [spread_by])


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Per class, the first ``floor(share * n)`` rows of a seeded shuffle become the test side."""
    keyed = df.withColumn("_hash", seeded_order(seed, key)).withColumn("_bucket", hash_bucket(F.col("_hash")))
    numbered = ordered_within_key(keyed, [label], ["_hash", key], "_bucket")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_class_rows"))
    is_test = F.col("position") <= F.floor(F.col("_class_rows") * F.lit(share))
    return dimension_join(numbered, sizes, [label], "inner", [key]).withColumn(
        "side", F.when(is_test, "test").otherwise("train")
    ).drop("_hash", "_bucket", "position", "_class_rows")


def sample_balanced(df: DataFrame, source: str, key: str, n: int, size: Column | None = None, seed: int = 42,
                    max_bytes: int = 60_000) -> DataFrame:
    """A seeded uniform sample of ``n`` size-eligible rows per source.

    The rank filter is pushed below the shuffle, so each task sends at most ``n`` rows per source.
    """
    eligible = df if size is None else df.where((size > 0) & (size <= max_bytes))
    order = Window.partitionBy(source).orderBy(seeded_order(seed, key), key)
    return eligible.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


# --- generated text ------------------------------------------------------------------


def _pick(pool: list[str], *salt) -> Column:
    values = F.array(*[F.lit(v) for v in pool])
    return F.element_at(values, (F.pmod(F.xxhash64(*salt), F.lit(len(pool))) + 1).cast("int"))


def fill_templates(templates: DataFrame, pools: dict[str, list[str]], variants: int, seed: int = 42,
                   filler: list[str] | None = None, filler_percent: int = 35) -> DataFrame:
    """Template variants: every ``{name}`` placeholder takes a seeded pick from its pool.

    ``templates`` has ``group_id, label, template``; every variant of a template shares its group.
    """
    rows = templates.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    text = F.col("template")
    for name, pool in pools.items():
        text = F.replace(text, F.lit("{" + name + "}"), _pick(pool, F.lit(seed), "group_id", "variant", F.lit(name)))
    if filler:
        lucky = F.pmod(F.xxhash64(F.lit(seed), "group_id", "variant", F.lit("filler?")), F.lit(100)) < filler_percent
        extra = F.concat(F.lit("\n\n"), _pick(filler, F.lit(seed), "group_id", "variant", F.lit("filler")))
        text = F.when((F.col("label") == 1) & lucky, F.concat(text, extra)).otherwise(text)
    return rows.select("group_id", "label", "variant", text.alias("text"))


def hard_negatives(templates: DataFrame, pools: dict[str, list[str]], variants: int, seed: int = 42) -> DataFrame:
    """Legitimate-only variants without filler, exact repeats removed (first variant stays)."""
    made = fill_templates(templates.withColumn("label", F.lit(0)), pools, variants, seed)
    return made.groupBy("text").agg(F.min(F.struct("group_id", "variant")).alias("_first")).select(
        "_first.group_id", F.lit(0).alias("label"), "_first.variant", "text"
    )


def random_feature_table(spark, features: list[str], n: int, seed: int = 42,
                         phishing_signs: list[str] = (), safe_signs: list[str] = ()) -> DataFrame:
    """Tri-state demo features (-1, 0, 1 at .45/.10/.45) with a -1/1 label at .55/.45."""
    def u(name):
        return (F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(name)), F.lit(1_000_000)) / 1_000_000)

    rows = spark.range(n)
    label = F.when(u("result") < 0.55, 1).otherwise(-1)
    def value(name):
        base = F.when(u(name) < 0.45, -1).when(u(name) < 0.55, 0).otherwise(1)
        if name in phishing_signs:
            return F.when(label == -1, F.lit(-1)).otherwise(base)
        if name in safe_signs:
            return F.when(label == 1, F.lit(1)).otherwise(base)
        return base
    return rows.select("id", *[value(f).alias(f) for f in features], label.alias("result"))
