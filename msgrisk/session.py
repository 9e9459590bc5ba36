"""Session defaults and durable lineage cuts."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(app_name: str = "msgrisk", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (AQE on, UTC, Arrow on)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a fresh temporary folder; on a cluster a
    machine-local folder would be lost with its executor, so an unset value is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="msgrisk-checkpoint-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared checkpoint folder; survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back.

    For results of costly parsing that several branches use: columns can still be pruned. With ``schema`` the table is read
    under other types that are stored alike.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(schema or df.schema).parquet(folder)


def let_go(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are out of use; the JVM hears a second later what Python has let go."""
    gc.collect()
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()


def bounded_batches(df: DataFrame, rows: int = 256) -> DataFrame:
    """``df``, with Arrow batches of at most ``rows`` rows for the session: rows that hold whole texts must not pile up in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df
