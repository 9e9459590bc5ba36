"""Packing of token sequences by Karmarkar-Karp multiway differencing.

A document's ids (with an end id) are cut into whole windows and one rest; a rest is cut into halves of halves. The pieces of a block of windows are dealt out by multiway differencing: every piece starts as a
partial partition, the two partial partitions with the largest imbalance are merged with their orders opposed, and
so on until one is left. The block's ids leave a small slack, so the near-equal windows fit; when one exceeds the
capacity all the same, the number of windows rises by one and the block is dealt out again.

Rows are packed inside the partitions of the input: no shuffle, no key that could be hot, memory bounded by one
block and one text. A lost task is repeated from its input partition and numbers its sequences as before.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from msgrisk.llm.common import arrow_map, slices
from msgrisk.llm.tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Item numbers of each of ``ways`` parts with nearly equal sums.

    A partial partition is a falling list of (sum, items) with its empty parts left out, all sums less the smallest.
    """
    if not sizes:
        return [[] for _ in range(ways)]
    heap = [(-size, number, [(size, [number])]) for number, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heap[0][2]
        meet = len(a) + len(b) - ways
        if meet <= 0:
            merged = a + b
        else:  # the smallest parts of one meet the smallest of the other, largest with smallest
            keep = len(a) - meet
            last = len(b) - 1
            merged = a[:keep]
            for i in range(meet):
                x, y = a[keep + i], b[last - i]
                merged.append((x[0] + y[0], x[1] + y[1]))
            merged += b[: last + 1 - meet]
        merged.sort(key=_sum, reverse=True)
        if len(merged) == ways and (low := merged[-1][0]):
            merged = [(s - low, items) for s, items in merged]
        spread = merged[0][0] if len(merged) < ways else merged[0][0] - merged[-1][0]
        heapq.heapreplace(heap, (-spread, serial, merged))
        serial += 1
    return [items for _, items in heap[0][2]]


_sum = itemgetter(0)


def halves(length: int, largest: int, smallest: int) -> list[int]:
    """A rest cut into ever smaller pieces: the small ones even out what the large ones leave."""
    out = []
    while length > smallest:
        out.append(min((length + 1) // 2, largest))
        length -= out[-1]
    return [*out, length] if length else out


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Fewest near-equal windows that differencing finds with no sum above ``capacity``."""
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, ways)
        if max(sum(sizes[i] for i in part) for part in parts) <= capacity:
            return [part for part in parts if part]
        ways += 1


def pack_sequences(
    docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, largest: int = 512,
    smallest: int = 16, block: int = 16, slack: int = 2, with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents packed into sequences of at most ``capacity`` ids.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names. A null or empty text is the end
    id alone; a null doc_id stays null; repeated rows are packed once each; an empty table gives no rows. One row for
    each piece: its document's ids before it (start), its length, crc32 over its little-endian 32-bit ids, the
    document's length, the sequence and the place in it; with ``with_ids`` also the ids.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()
    target = block * (capacity - slack)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode = encoder(tokenizer).encode
        first = TaskContext.get().partitionId() << 40
        serial = 0
        pending: list[tuple] = []  # ((doc_id, row), start, ids, document's length)
        row = 0
        held = 0
        rows: list[tuple] = []

        def place(items: list[tuple]) -> None:
            nonlocal serial
            at = 0
            for (doc, _), start, ids, total in items:
                size = len(ids) // 4
                rows.append((doc, start, size, zlib.crc32(ids), total, first + serial, at, ids if with_ids else None))
                at += size
            serial += 1

        def deal() -> None:
            nonlocal held
            pieces = []
            for owner, start, ids, total in pending:
                count = len(ids) // 4
                a = 0
                for size in halves(count, largest, smallest):
                    pieces.append((owner, start + a, ids[a * 4 : (a + size) * 4], total))
                    a += size
            for part in windows_of([len(x[2]) // 4 for x in pieces], capacity):
                place(joined([pieces[i] for i in sorted(part)]))
            pending.clear()
            held = 0

        def flush() -> dict:
            columns = dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"), map(list, zip(*rows))))
            rows.clear()
            if with_ids:
                columns["ids"] = [np.frombuffer(x, dtype="<u4").astype(np.int64) for x in columns["ids"]]
            return columns

        for part in slices(batches, "text"):
            for doc, text in zip(part["doc_id"], part["text"]):
                ids = encode(text) + end
                owner, row = (doc, row), row + 1
                count = len(ids) // 4
                whole = count // capacity * capacity
                for a in range(0, whole, capacity):
                    place([(owner, a, ids[a * 4 : (a + capacity) * 4], count)])
                while whole < count:
                    take = min(count - whole, target - held)
                    pending.append((owner, whole, ids[whole * 4 : (whole + take) * 4], count))
                    whole += take
                    held += take
                    if held == target:
                        deal()
            if len(rows) >= 20_000 or with_ids and rows:
                yield flush()
        if pending:
            deal()
        if rows:
            yield flush()

    return arrow_map(docs.select("doc_id", "text"), work, SCHEMA + (", ids array<long>" if with_ids else ""))


def joined(pieces: list[tuple]) -> list[tuple]:
    """Neighbouring pieces of one row (the first element names it) as one piece."""
    out: list[tuple] = []
    for doc, start, ids, total in pieces:
        if out and out[-1][0] == doc and out[-1][3] == total and out[-1][1] + len(out[-1][2]) // 4 == start:
            out[-1] = (doc, out[-1][1], out[-1][2] + ids, total)
        else:
            out.append((doc, start, ids, total))
    return out
