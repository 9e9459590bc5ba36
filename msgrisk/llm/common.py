"""Small helpers that several operators share: row tasks over Arrow batches, shared files, word hashes."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import time
import uuid
import weakref
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from msgrisk.session import ensure_checkpoint_dir

#: Rows of an Arrow batch.
BATCH_ROWS = 1_000
#: Rows of text handled at once inside a task are cut to about this many characters.
SLICE_CHARS = 2_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = SLICE_CHARS) -> Iterator[dict[str, list]]:
    """Arrow batches as dicts of Python lists, cut so that ``column`` holds about ``chars`` characters at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        group = (np.cumsum(sizes) - sizes) // chars
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.slice(a, b - a).to_pydict()


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, Any]]], schema: str) -> DataFrame:
    """``mapInArrow`` for a generator of column dicts that match ``schema``.

    Rows hold whole texts, so batches of a thousand rows replace Spark's ten thousand; this holds for the session.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin_task(work.__module__)
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[n], type=target.field(n).type, from_pandas=False) for n in names], schema=target
            )

    return df.mapInArrow(task, schema)


class Memo(dict):
    """A cache of a pure function of a string; it stops growing at about ``limit`` bytes, results never depend on it."""

    known: list[weakref.ref[Memo]] = []

    def __init__(self, work: Callable[[str], Any], limit: int = 48 << 20, longest: int = 64):
        super().__init__()
        self.work, self.limit, self.longest, self.size = work, limit, longest, 0
        Memo.known.append(weakref.ref(self))

    def __missing__(self, key: str) -> Any:
        value = self.work(key)
        self.offer(key, value)
        return value

    def offer(self, key: str, value: Any) -> None:
        """Keep a value if there is room."""
        if self.size < self.limit and len(key) <= self.longest:
            # The two strings, what a tuple adds, and a slot of the table.
            self.size += 2 * len(key) + 250 + (len(value) if isinstance(value, bytes) else sum(map(len, value or ())) + 100)
            self[key] = value

    @classmethod
    def forget(cls) -> None:
        """Empty all caches of this process."""
        for ref in cls.known:
            cache = ref()
            if cache is not None:
                cache.clear()
                cache.size = 0


_last_work: str | None = None


def _begin_task(work: str) -> None:
    """A worker process serves many operators in turn: what one has cached goes when another begins, and memory that
    tasks before have freed is given back."""
    global _last_work
    if _last_work != work:
        Memo.forget()
        _last_work = work
        gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64 finalizer) over unsigned integers."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z ^= z >> np.uint64(30)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(27)
        z *= np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        return z


def release(spark: SparkSession, settled: bool = False) -> None:
    """Let the driver forget plans that are out of use, so that Spark's cleaner drops their shuffle files now.

    The JVM hears up to a second later what Python has let go; ``settled`` waits for that, so that files of the step just
    done go as well, and for the cleaner, which works through what it finds after the call.
    """
    gc.collect()
    if settled:
        time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()
    if settled:
        time.sleep(1.5)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(folder: str):
    """The file system of a folder's URI and the folder's path in it; works on driver and executors."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", folder)
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class Scratch:
    """Tables that one operation writes to shared storage, each deleted once no later step reads it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folders: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        folder = shared_folder(self.spark, "scratch")
        df.write.parquet(folder)
        table = self.spark.read.schema(df.schema).parquet(folder)
        self.folders[id(table)] = folder
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            system, path = filesystem(self.folders.pop(id(table)))
            system.delete_dir(path)
        release(self.spark)


def write_file(folder: str, name: str, parts: list[bytes]) -> None:
    """Write a file under another name, then rename it: a repeated attempt replaces it by the same bytes."""
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    system.move(draft, f"{path}/{name}")
