"""Token-id files with a minimal perfect hash index: keyed access to raw id payloads in constant time.

Layout of a store (one folder in shared storage):

* ``shard-NNNNNN.bin``: magic, item size, document count, end offsets (unsigned 64-bit, in ids), then the raw ids as
  little-endian unsigned 16- or 32-bit integers; documents ascend by key inside a shard and from shard to shard,
  null keys first;
* ``index-NNNNNN.bin``: a minimal perfect hash over the keys that a 64-bit mixer sends to this part, and at each slot
  a 32-bit fingerprint, the shard, the document's number in it, and how many documents follow under the same key;
* ``parts.txt``: the number of index parts;
* ``manifest``: one Parquet row for each document (key, shard, number, ids).

The hash is a cascade of bit arrays: a key that is alone at its place in a level sets its bit, the others go on to
the next level; the slot of a key is the number of bits before its own. A key that was never stored meets a foreign
fingerprint and is reported as absent (a chance of 2**-32 a look-up remains).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from msgrisk.llm.common import arrow_map, filesystem, mix, slices, write_file
from msgrisk.llm.tokens import encoder

MAGIC = b"IDSHARD1"
INDEX_MAGIC = b"IDINDEX1"
#: Bits of a level for each key that reaches it.
GAMMA = 2


# --- minimal perfect hash ---------------------------------------------------------------


class PerfectHash:
    """Slots 0 .. n-1 for n distinct unsigned 64-bit keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(np.unpackbits(bits, bitorder="little"), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], np.unique(keys)
        while len(left):
            size = -(-len(left) * GAMMA // 8) * 8
            place = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            left = left[~alone[place]]
        return cls(np.asarray(sizes, dtype=np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where every level says that the key was not stored."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            place = (mix(keys[todo], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            hit = (self.bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            out[todo[hit]] = self.rank[place[hit]]
            todo = todo[~hit]
        return out


_FIELDS = np.dtype([("print", "<u4"), ("shard", "<u4"), ("number", "<u4"), ("copies", "<u4")])


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 977) >> np.uint64(32)).astype(np.uint32)


# --- writing ----------------------------------------------------------------------------


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, keys_per_index: int = 1_000_000,
                least_parts: int = 32) -> None:
    """Encode ``doc_id``/``text`` rows and write shards, manifest and index below ``folder`` (a new shared folder).

    A null or empty text is the end id alone. Rows that share a key stay together in one shard, in no promised order
    among themselves unless their texts are equal; null keys are stored first and are not in the index. Other columns
    are ignored. An empty table gives a store without shards.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        codec = encoder(tokenizer)
        kind = np.dtype("<u2" if max(codec.vocabulary, end_id + 1) <= 65_536 else "<u4")
        end = np.asarray([end_id], dtype=kind).tobytes()
        shard = TaskContext.get().partitionId()
        keys: list = []
        payload: list[bytes] = []
        for part in slices(batches, "text"):
            for doc, text in zip(part["doc_id"], part["text"]):
                keys.append(doc)
                payload.append(np.frombuffer(codec.encode(text), dtype="<u4").astype(kind).tobytes() + end)
        if not keys:
            return
        sizes = np.asarray([len(x) // kind.itemsize for x in payload], dtype=np.int64)
        ends = np.cumsum(sizes).astype("<u8")
        head = MAGIC + np.asarray([kind.itemsize, len(keys)], dtype="<u8").tobytes()
        write_file(folder, f"shard-{shard:06d}.bin", [head, ends.tobytes(), *payload])
        yield {"doc_id": keys, "shard": [shard] * len(keys), "number": list(range(len(keys))), "ids": sizes}

    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    arrow_map(ordered, write, "doc_id long, shard int, number int, ids long").write.parquet(f"{folder}/manifest")

    manifest = spark.read.parquet(f"{folder}/manifest")
    runs = manifest.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("shard").alias("shard"), F.min("number").alias("number"), F.count(F.lit(1)).alias("copies")
    )
    parts = max(least_parts, -(-manifest.count() // keys_per_index))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        gathered = [b.to_pandas() for b in batches if b.num_rows]
        names: list[int] = []
        counts: list[int] = []
        if gathered:
            import pandas as pd

            for part, rows in pd.concat(gathered, ignore_index=True).groupby("part"):
                keys = rows["doc_id"].to_numpy(dtype=np.int64).view(np.uint64)
                hashing = PerfectHash.build(keys)
                table = np.zeros(len(keys), dtype=_FIELDS)
                at = hashing.slots(keys)
                for field, values in (("print", _prints(keys)), ("shard", rows["shard"]), ("number", rows["number"]), ("copies", rows["copies"])):
                    table[field][at] = values
                write_file(folder, f"index-{part:06d}.bin", [
                    INDEX_MAGIC, np.asarray([len(hashing.sizes), len(hashing.bits), len(keys)], dtype="<u8").tobytes(),
                    hashing.sizes.astype("<u8").tobytes(), hashing.bits.tobytes(), table.tobytes(),
                ])
                names.append(int(part))
                counts.append(len(keys))
        yield {"part": names, "keys": counts}

    placed = runs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).repartition("part")
    arrow_map(placed, index, "part int, keys long").write.parquet(f"{folder}/parts")
    write_file(folder, "parts.txt", [str(parts).encode()])


# --- reading ----------------------------------------------------------------------------


def _load_index(folder: str, part: int) -> tuple[PerfectHash, np.ndarray] | None:
    system, path = filesystem(folder)
    from pyarrow import fs

    name = f"{path}/index-{part:06d}.bin"
    if system.get_file_info(name).type == fs.FileType.NotFound:
        return None
    with system.open_input_file(name) as f:
        data = f.read()
    levels, size, keys = np.frombuffer(data, "<u8", 3, 8).tolist()
    at = 8 + 24
    sizes = np.frombuffer(data, "<u8", levels, at).astype(np.int64)
    bits = np.frombuffer(data, np.uint8, size, at + 8 * levels)
    return PerfectHash(sizes, bits), np.frombuffer(data, _FIELDS, keys, at + 8 * levels + size)


def locate(keys: DataFrame, folder: str) -> DataFrame:
    """Place of each row's ``doc_id`` by one look-up in its index part: shard, number, copies (null if absent)."""
    system, path = filesystem(folder)
    with system.open_input_file(f"{path}/parts.txt") as f:
        parts = int(f.read())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        loaded: dict[int, tuple | None] = {}
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False)
            key = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            shard, number, copies = (np.full(len(key), -1, dtype=np.int64) for _ in range(3))
            for p in np.unique(part).tolist():
                if p not in loaded:
                    if len(loaded) >= 4:
                        loaded.clear()
                    loaded[p] = _load_index(folder, p)
                if loaded[p] is None:
                    continue
                hashing, entries = loaded[p]
                rows = np.flatnonzero(part == p)
                bits = key[rows].view(np.uint64)
                slot = hashing.slots(bits)
                ok = slot >= 0
                ok[ok] = entries["print"][slot[ok]] == _prints(bits[ok])
                rows, slot = rows[ok], slot[ok]
                for field, out in (("shard", shard), ("number", number), ("copies", copies)):
                    out[rows] = entries[field][slot]
            yield {"doc_id": key, **{
                n: [None if x < 0 else x for x in v.tolist()] for n, v in (("shard", shard), ("number", number), ("copies", copies))
            }}

    asked = keys.where("doc_id IS NOT NULL").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"))
    return arrow_map(asked.repartition("part").sortWithinPartitions("part"), look, "doc_id long, shard int, number int, copies int")


def read_located(places: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Ids (or their length and crc32) of located documents, one row for each stored document under the key.

    Places are grouped by shard and sorted, so each shard is opened once and read forwards.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        system, path = filesystem(folder)
        opened: int | None = None
        file = ends = None
        item = base = 0
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "shard": [], "before": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
            rows = batch.to_pydict()
            for doc, shard, number, copies in zip(rows["doc_id"], rows["shard"], rows["number"], rows["copies"]):
                if shard != opened:
                    if file is not None:
                        file.close()
                    file, opened = system.open_input_file(f"{path}/shard-{shard:06d}.bin"), shard
                    head = file.read(24)
                    if head[:8] != MAGIC:
                        raise ValueError(f"shard {shard} is not a token shard")
                    item, count = np.frombuffer(head, "<u8", 2, 8).tolist()
                    ends = np.concatenate([[0], np.frombuffer(file.read(8 * count), "<u8").astype(np.int64)])
                    base = 24 + 8 * count
                for i in range(number, number + copies):
                    a, b = int(ends[i]), int(ends[i + 1])
                    file.seek(base + a * item)
                    ids = np.frombuffer(file.read((b - a) * item), f"<u{item}").astype("<u4")
                    out["doc_id"].append(doc)
                    out["shard"].append(shard)
                    out["before"].append(a)
                    out["n_tokens"].append(b - a)
                    out["ids_crc32"].append(zlib.crc32(ids.tobytes()))
                    if with_ids:
                        out["ids"].append(ids.astype(np.int64))
            if out["doc_id"]:
                yield out
        if file is not None:
            file.close()

    schema = "doc_id long, shard int, before long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    grouped = places.select("doc_id", "shard", "number", "copies").repartition("shard").sortWithinPartitions("shard", "number")
    return arrow_map(grouped, read, schema)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored document in key order: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Each distinct key of the manifest is looked up in the index and read from its shard; null keys, which no index
    holds, are read by their manifest rows. Raises if a stored key is not found again.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    keyed = locate(manifest.where("doc_id IS NOT NULL AND number IS NOT NULL").select("doc_id").distinct(), folder)
    keyed = keyed.withColumn("shard", F.when(F.col("shard").isNull(), F.raise_error(F.lit("a stored key is missing from the index"))).otherwise(F.col("shard")))
    plain = manifest.where("doc_id IS NULL").select("doc_id", "shard", "number", F.lit(1).alias("copies"))
    read = read_located(keyed.unionByName(plain), folder)
    totals = manifest.groupBy("shard").agg(F.sum("ids").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    bases = totals.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return read.join(bases, "shard").select("doc_id", (F.col("_base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "shard")
