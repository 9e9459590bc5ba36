"""A training corpus in stages, each kept under a key of its content: an unchanged stage is read, not run again."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgrisk.operators import corpus as ops
from msgrisk.operators.evaluate import multiset_fingerprint

#: Version of the operators the stages call: raise it when one of them changes its result.
VERSION = "1"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


@dataclass
class StageCache:
    """Tables below a shared folder, one for each stage and key; a table counts once its writer has marked it complete."""

    spark: SparkSession
    folder: str
    runs: list[tuple[str, str, bool]] = field(default_factory=list)

    def source(self, name: str, df: DataFrame) -> tuple[DataFrame, str]:
        """A table and the digest of its rows, in any order, column names and types included."""
        columns = sorted(df.columns)
        record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        return df, multiset_fingerprint(df, record, json.dumps([name, sorted(df.dtypes)])).first()["fingerprint"]

    def stage(self, name: str, work: Callable[..., DataFrame], *inputs: tuple[DataFrame, str], **params) -> tuple[DataFrame, str]:
        """``work(*tables, **params)``, read from the cache if its inputs, parameters and code are those of an earlier run."""
        lineage = [VERSION, name, inspect.getsource(work), [digest for _, digest in inputs], params]
        key = hashlib.sha256(json.dumps(lineage, sort_keys=True).encode()).hexdigest()
        path = f"{self.folder}/{name}-{key}"
        known = _exists(self.spark, f"{path}/_SUCCESS")
        if not known:
            work(*[df for df, _ in inputs], **params).write.mode("overwrite").parquet(path)
        self.runs.append((name, key, known))
        return self.spark.read.parquet(path), key


COLUMNS = ["row_ord", "source", "group_id", "label", "text"]


def unite(*corpora: DataFrame) -> DataFrame:
    """All sources one behind the other; rows are numbered by source and their own order."""
    return ops.union_corpora(*[c.select(*COLUMNS) for c in corpora]).select(*COLUMNS)


def deduplicate(united: DataFrame) -> DataFrame:
    """The first row of each family whose labels agree."""
    return ops.dedup_families(united).select(*COLUMNS)


def split(kept: DataFrame, folds: int, seed: int) -> DataFrame:
    """Whole groups on one side: the first of ``folds`` balanced folds is the test side."""
    fold = ops.fold_of_groups(kept, "group_id", "label", folds, seed).select("group_id", F.when(F.col("fold") == 0, "test").otherwise("train").alias("side"))
    placed = kept.join(fold, "group_id").withColumn("row_ord", F.to_json("row_ord"))  # one text key for rows of any origin
    return placed.select(*COLUMNS, "side")


def admit(sides: DataFrame, extra: DataFrame, reserved: DataFrame) -> DataFrame:
    """Training-only rows: none of a group under test, none of a family that a side or the reserved texts hold."""
    texts = sides.select("text").unionByName(reserved.select("text"))
    free = ops.exclude_heldout_groups(extra.select(*COLUMNS), sides.where("side = 'test'"))
    return ops.exclude_reserved_families(free, texts).select(*COLUMNS, F.lit("train").alias("side"))


def assemble(sides: DataFrame, *additions: DataFrame) -> DataFrame:
    """Both sides with everything admitted to training."""
    out = sides
    for part in additions:
        out = out.unionByName(part.withColumn("row_ord", F.concat_ws(":", "source", F.col("row_ord").cast("string"))))
    return out


def build_corpus_pipeline(
    corpora: list[DataFrame], extra: DataFrame, hard_negatives: DataFrame, reserved: DataFrame, cache: StageCache, folds: int = 5, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """The corpus (row_ord, source, group_id, label, text, side) and one provenance row a stage.

    Sources are united, reduced to one row a family and split by group; dated training rows and hard negatives join the
    training side only, after everything that is held out or ``reserved`` (text) for later evaluation has left them.
    Provenance: stage, rows, positives, lineage key, and whether the stage was read from the cache.
    """
    taken = [cache.source(f"corpus-{i}", c.select(*COLUMNS)) for i, c in enumerate(corpora)]
    added = cache.source("extra", extra.select(*COLUMNS))
    hard = cache.source("hard_negatives", hard_negatives.select(*COLUMNS))
    held = cache.source("reserved", reserved.select("text"))
    united = cache.stage("united", unite, *taken)
    kept = cache.stage("deduplicated", deduplicate, united)
    sides = cache.stage("split", split, kept, folds=folds, seed=seed)
    dated = cache.stage("extra", admit, sides, added, held)
    with_extra = cache.stage("with_extra", assemble, sides, dated)
    negatives = cache.stage("hard_negatives", admit, with_extra, hard, held)
    whole = cache.stage("corpus", assemble, with_extra, negatives)
    stages = [("united", united), ("deduplicated", kept), ("split", sides), ("extra", dated), ("with_extra", with_extra), ("hard_negatives", negatives), ("corpus", whole)]
    seen = {name: (key, known) for name, key, known in cache.runs}
    rows = None
    for order, (name, (table, _)) in enumerate(stages):
        side = F.col("side") if "side" in table.columns else F.lit(None)
        row = table.agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(side == "test").alias("held_out"),
        ).select(F.lit(order).alias("ord"), F.lit(name).alias("stage"), "*", F.lit(seen[name][0]).alias("lineage"), F.lit(seen[name][1]).alias("cached"))
        rows = row if rows is None else rows.unionByName(row)
    return whole[0], rows
