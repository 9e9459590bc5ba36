"""Corpus building: families, isolation, folds, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from msgrisk.catalog.registry import query, sql_family, sql_family_id, sql_template, table
from msgrisk.operators import corpus as ops
from msgrisk.session import materialize


def documents(spark, d):
    """Documents as a corpus; unlabeled rows carry a null label."""
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "lang")
    return docs.join(labels, "doc_id", "left").withColumnRenamed("doc_id", "row_ord")


_FAM = f"""
fam AS (
  SELECT d.doc_id, d.source, d.lang, d.text, l.toxic AS label, {sql_family_id('d.text')} AS family
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
),
stat AS (
  SELECT family, min(doc_id) AS first_ord, count(*) AS copies,
         coalesce(min(label) <> max(label), false) AS conflict
  FROM fam GROUP BY family
)"""


@query("family_dedup_counts", f"""
WITH {_FAM}
SELECT source, count(*)::BIGINT AS n_rows,
  sum(CASE WHEN NOT conflict AND doc_id = first_ord THEN 1 ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN NOT conflict AND doc_id <> first_ord THEN 1 ELSE 0 END)::BIGINT AS duplicates,
  sum(CASE WHEN conflict THEN 1 ELSE 0 END)::BIGINT AS conflicting
FROM fam JOIN stat USING (family) GROUP BY source""")
def family_dedup_counts(spark, d):
    return ops.family_report(documents(spark, d))


@query("family_keep_first", f"""
WITH {_FAM}
SELECT doc_id AS row_ord, family, copies::BIGINT AS copies, label, length(text)::BIGINT AS n_chars
FROM fam JOIN stat USING (family) WHERE NOT conflict AND doc_id = first_ord""")
def family_keep_first(spark, d):
    kept = ops.dedup_families(documents(spark, d))
    return kept.select("row_ord", "family", "copies", "label", F.length("text").cast("bigint").alias("n_chars"))


@query("source_profile", """
SELECT d.source, count(*)::BIGINT AS n, count(*) FILTER (WHERE l.toxic = 1)::BIGINT AS phishing,
       count(*) FILTER (WHERE l.toxic = 0)::BIGINT AS legitimate
FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source""")
def source_profile(spark, d):
    profile = ops.source_profile(documents(spark, d).where("label IS NOT NULL"))
    return profile.select("source", "n", F.col("phishing").cast("bigint"), F.col("legitimate").cast("bigint"))


@query("union_source_profile", """
SELECT kind, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM (
  SELECT 'documents' AS kind, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations
  UNION ALL SELECT 'benchmark', text FROM benchmark) GROUP BY kind""")
def union_source_profile(spark, d):
    parts = [
        table(spark, d, name).select(F.lit(name).alias("kind"), "text", F.col(key).alias("row_ord"))
        for name, key in (("documents", "doc_id"), ("conversations", "conv_id"), ("benchmark", "item_id"))
    ]
    union = ops.union_corpora(*parts)
    return union.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("bigint")).alias("chars"))


@query("label_conflicts", f"""
WITH {_FAM}
SELECT family, count(*)::BIGINT AS n_rows FROM fam GROUP BY family HAVING count(DISTINCT (lang, source)) > 1""")
def label_conflicts(spark, d):
    return ops.label_conflicts(ops.with_family(documents(spark, d)), "family", ["lang", "source"])


@query("duplicate_ordinal", f"""
WITH {_FAM}
SELECT doc_id AS row_ord, family, (row_number() OVER (PARTITION BY family ORDER BY doc_id))::BIGINT AS ordinal,
  min(doc_id) OVER (PARTITION BY family) AS first_ord FROM fam""")
def duplicate_ordinal(spark, d):
    fam = materialize(ops.with_family(table(spark, d, "documents").withColumnRenamed("doc_id", "row_ord")).select("row_ord", "family"))
    out = ops.duplicate_ordinal(fam, ["family"], "row_ord")
    return out.select("row_ord", "family", F.col("ordinal").cast("bigint").alias("ordinal"), "first_ord")


@query("reserved_family_exclusion", f"""
WITH {_FAM}
SELECT min(doc_id) AS row_ord, family FROM fam WHERE label IS NULL
  AND family NOT IN (SELECT family FROM fam WHERE label IS NOT NULL) GROUP BY family""")
def reserved_family_exclusion(spark, d):
    """Unlabeled documents, minus every family that the labeled ones reserve."""
    docs = documents(spark, d)
    kept = ops.exclude_reserved_families(docs.where("label IS NULL"), docs.where("label IS NOT NULL"))
    return kept.select("row_ord", "family")


@query("heldout_group_exclusion", """
SELECT doc_id AS row_ord, lang FROM documents
WHERE source NOT IN (SELECT source FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 AND l.quality = 0)""")
def heldout_group_exclusion(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("row_ord"), F.col("source").alias("group_id"), "lang")
    bad = table(spark, d, "labels").where("toxic = 1 AND quality = 0").select(F.col("doc_id").alias("row_ord"))
    heldout = docs.join(bad, "row_ord", "left_semi")
    return ops.exclude_heldout_groups(docs, heldout).select("row_ord", "lang")


@query("reference_overlap", f"""
WITH keyed AS (
  SELECT d.doc_id, l.toxic AS label, sha256(text) AS exact, {sql_template('text')} AS t
  FROM documents d LEFT JOIN labels l USING (doc_id)),
tpl AS (SELECT doc_id, label, exact,
  CASE WHEN length(t) >= 80 AND len(string_split(t, ' ')) >= 12 THEN sha256(t) END AS template FROM keyed),
ref AS (SELECT * FROM tpl WHERE label IS NOT NULL),
coh AS (SELECT exact, any_value(template) AS template, min(doc_id) AS first_ord, count(*) AS copies
        FROM tpl WHERE label IS NULL GROUP BY exact)
SELECT exact, first_ord, copies::BIGINT AS copies,
  CASE WHEN exact IN (SELECT exact FROM ref) THEN 'overlap_exact'
       WHEN template IN (SELECT template FROM ref WHERE template IS NOT NULL) THEN 'overlap_template' ELSE 'kept' END AS status
FROM coh""")
def reference_overlap(spark, d):
    docs = documents(spark, d)
    out = ops.reference_overlap(docs.where("label IS NULL"), docs.where("label IS NOT NULL"))
    return out.select("exact", "first_ord", "copies", "status")


@query("connected_groups", f"""
WITH RECURSIVE {_FAM},
clean AS (SELECT DISTINCT family, source || '/' || lang AS g FROM fam JOIN stat USING (family) WHERE NOT conflict),
first_of AS (SELECT family, min(g) AS m FROM clean GROUP BY family),
edge AS (SELECT DISTINCT g AS a, m AS b FROM clean JOIN first_of USING (family) UNION SELECT DISTINCT m, g FROM clean JOIN first_of USING (family)),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
comp AS (SELECT a AS group_id, min(b) AS component FROM reach GROUP BY a)
SELECT g.group_id, least(g.group_id, coalesce(c.component, g.group_id)) AS component
FROM (SELECT DISTINCT source || '/' || lang AS group_id FROM fam) g LEFT JOIN comp c USING (group_id)""")
def connected_groups(spark, d):
    docs = documents(spark, d).withColumn("group_id", F.concat("source", F.lit("/"), "lang"))
    return ops.merge_campaign_groups(docs)


@query("temporal_partition_isolation", """
WITH p AS (
  SELECT event_id, user_id, CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN 'holdout'
    WHEN ts >= TIMESTAMP '2024-01-20' THEN 'validation' ELSE 'train' END AS part,
    user_id || ':' || json_extract_string(props, '$.k') AS family FROM events),
best AS (SELECT family, max(CASE part WHEN 'holdout' THEN 2 WHEN 'validation' THEN 1 ELSE 0 END) AS k FROM p GROUP BY family)
SELECT family, CASE k WHEN 2 THEN 'holdout' WHEN 1 THEN 'validation' ELSE 'train' END AS partition,
  min(event_id) FILTER (WHERE (CASE part WHEN 'holdout' THEN 2 WHEN 'validation' THEN 1 ELSE 0 END) = k) AS first_ord,
  count(*) FILTER (WHERE (CASE part WHEN 'holdout' THEN 2 WHEN 'validation' THEN 1 ELSE 0 END) = k)::BIGINT AS copies,
  count(*) FILTER (WHERE (CASE part WHEN 'holdout' THEN 2 WHEN 'validation' THEN 1 ELSE 0 END) < k)::BIGINT AS excluded
FROM p JOIN best USING (family) GROUP BY family, k""")
def temporal_partition_isolation(spark, d):
    events = table(spark, d, "events").select(
        F.col("event_id").alias("row_ord"),
        F.concat_ws(":", F.col("user_id").cast("string"), F.get_json_object("props", "$.k")).alias("family"),
        ops.temporal_partition(F.col("ts"), "2024-01-20", "2024-01-25").alias("partition"),
    )
    return ops.temporal_family_isolation(events)


@query("partition_overlap", """
WITH p AS (SELECT user_id, ts >= TIMESTAMP '2024-01-25' AS late FROM events)
SELECT count(*)::BIGINT AS shared FROM (SELECT user_id FROM p WHERE late INTERSECT SELECT user_id FROM p WHERE NOT late)""")
def partition_overlap(spark, d):
    events = table(spark, d, "events")
    split = F.lit("2024-01-25").cast("timestamp")
    return ops.overlap_counts(events.where(F.col("ts") >= split), events.where(F.col("ts") < split), "user_id")


_FOLD = """
WITH g AS (SELECT d.lang || '/' || d.source AS group_id, min(l.toxic) AS lo, max(l.toxic) AS hi, count(*) AS n
           FROM documents d JOIN labels l USING (doc_id) GROUP BY 1),
f AS (SELECT group_id, (row_number() OVER (PARTITION BY lo, hi ORDER BY sha256('42:' || group_id), group_id) - 1) % 3 AS fold FROM g)"""


@query("fold_assignment", _FOLD + """
SELECT d.doc_id AS row_ord, f.group_id, f.fold::INTEGER AS fold FROM documents d JOIN labels l USING (doc_id)
JOIN f ON f.group_id = d.lang || '/' || d.source""")
def fold_assignment(spark, d):
    docs = documents(spark, d).where("label IS NOT NULL").withColumn("group_id", F.concat("lang", F.lit("/"), "source"))
    docs = docs.select("row_ord", "group_id", "label")
    return ops.fold_assignment(docs, "group_id", "label", 3, "row_ord").select("row_ord", "group_id", "fold")


@query("stratified_split", """
WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('42:' || o_orderkey)) AS k,
           count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN k <= floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS side FROM r""")
def stratified_split(spark, d):
    return ops.stratified_split(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query("sample_balanced", """
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('7:' || doc_id), doc_id) AS k
           FROM documents WHERE octet_length(encode(text)) BETWEEN 1 AND 60000)
SELECT doc_id, source FROM r WHERE k <= 10""")
def sample_balanced(spark, d):
    docs = table(spark, d, "documents")
    return ops.sample_balanced(docs, "source", "doc_id", 10, F.octet_length("text"), seed=7).select("doc_id", "source")


@query("template_variants")
def template_variants(spark, d):
    """Documents as templates: every one gets seeded variants of a greeting and a closing."""
    templates = table(spark, d, "documents").select(
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("group_id"), F.lit(1).alias("label"),
        F.concat(F.lit("Hello {name},\n\n"), "text", F.lit("\n\n{closing}")).alias("template"),
    )
    pools = {"name": ["Ana", "Ben", "Chloe"], "closing": ["Thanks", "Regards"]}
    made = ops.fill_templates(templates, pools, variants=4, filler=["Reply before noon."])
    return made.groupBy("group_id").agg(F.count(F.lit(1)).alias("variants"), F.count_distinct("text").alias("distinct_texts"))
