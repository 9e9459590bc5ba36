"""Removal of long repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if it lies in a string of ``window`` bytes that also starts in a document with a smaller key. The work is
cut so that no suffix order of the whole corpus is needed:

1. Each window of a text names its least 16-byte gram (by hash); neighbouring windows with the same one form a
   segment. Equal windows always name the same gram and agree in the bytes on one side of it, so a window whose gram
   and sides are found in one document only cannot repeat. A shuffle by gram finds the others; what repeats inside a
   task sends one row only.
2. The segments with shared grams go to the task of their gram. Copies met in the same task are settled before the
   shuffle by the smallest key among them. Segments of a very common gram go on as single windows instead, each to the
   task of its own hash.
3. A task holds the different segments of its grams as shards. Each shard is transformed (its rotations sorted, the
   characters before them noted), and the shards are merged by refining an interleave: a stable distribution of the
   merged rows by the characters before them turns an order by h characters into one by h + 2, without sorting the
   suffixes again. Boundaries that appear on the way are the common prefixes; blocks left at ``window`` characters are
   the repeated strings, and the smallest key in a block settles its members.
4. The settled intervals of a document meet its text again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.llm.common import Scratch, arrow_map, mix, release, slices
from msgrisk.operators.scale import small_or_none
from msgrisk.session import materialize

GRAM = 16
#: Bytes of a text that are cut into segments at once; their hashes fit a processor's cache.
STRETCH = 1 << 16
#: Segments that a task holds before it looks for repeats among them.
FLUSH = 1_000_000
_LAST = (1 << 63) - 1


# --- segments ---------------------------------------------------------------------------


def gram_hashes(data: bytes, places: np.ndarray | None = None) -> np.ndarray:
    """A hash of the 16 bytes from each place on, or from the given places on."""
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    low, high = (words[:-8], words[8:].copy()) if places is None else (words[places], words[places + 8])
    with np.errstate(over="ignore"):
        return mix(low * np.uint64(0x9E3779B97F4A7C15) + mix(high), 3)


def segments(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Text number, first window, windows, place of the least gram and its hash, for all segments of the texts."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for number, text in enumerate(texts):
        for at in range(0, max(0, len(text) - window + 1), STRETCH):
            part = text[at : at + STRETCH + window - 1]
            held.append((number, at, part))
            size += len(part)
            if size >= STRETCH:
                yield _segments(held, window)
                held, size = [], 0
    if held:
        yield _segments(held, window)


def _segments(parts: list[tuple[int, int, bytes]], window: int) -> tuple[np.ndarray, ...]:
    data = b"".join(p for _, _, p in parts)
    sizes = np.asarray([len(p) for _, _, p in parts], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    hashes = gram_hashes(data)
    low = np.uint64((1 << 24) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # ties go to the left
    span, reach = window - GRAM + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    owner = np.repeat(np.arange(len(parts)), sizes)[: len(least)]
    inside = np.arange(len(least)) - first[owner]
    valid = inside + window <= sizes[owner]
    place = (least & low).astype(np.int64)
    new = np.ones(len(least), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new & valid)
    # A segment ends at the next start or at its text's last window.
    stop = np.minimum(np.append(np.flatnonzero(new)[1:], len(least))[np.searchsorted(np.flatnonzero(new), at)], (first + sizes - window + 1)[owner[at]])
    own = owner[at]
    numbers = np.asarray([n for n, _, _ in parts], dtype=np.int64)[own]
    begins = np.asarray([b for _, b, _ in parts], dtype=np.int64)[own]
    return numbers, begins + at - first[own], stop - at, begins + place[at] - first[own], hashes[place[at]]


# --- transforms -------------------------------------------------------------------------


def rotations(codes: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of all rotations of the strings (each with its end mark) by ``depth`` codes or more; the place before each.

    Rotations that agree in all the codes compared come in any order.
    """
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    following, previous = np.arange(1, total + 1), np.arange(-1, total - 1)
    following[ends - 1] = ends - lengths
    previous[ends - lengths] = ends - 1
    key, code = codes.astype(np.int64), codes
    for _ in range(6):
        code = code[following]
        key = (key << 9) | code
    two = following[following]
    ahead = two[two][two][following]  # seven places on
    reach = 7
    while True:
        order = np.argsort(key)
        if reach >= depth:
            return order, previous
        sorted_key = key[order]
        rank = np.zeros(total, dtype=np.int64)
        rank[order[1:]] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
        key = rank * (total + 1) + rank[ahead]
        reach *= 2
        ahead = ahead[ahead]


def merge_shards(shards: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the merged order of all shards' rotations: string number, place in it, block of equal first codes.

    Blocks agree in ``window`` codes; a row whose first codes run over the end of its string is in a block of its own
    kind, as the end mark is a code.
    """
    strings = [s for shard in shards for s in shard]
    raw = np.frombuffer(b"".join(strings), dtype=np.uint8)
    used = np.zeros(256, dtype=bool)
    used[raw] = True
    code_of = np.cumsum(used).astype(np.int64)  # 0 is the end mark
    width = int(code_of[-1]) + 1
    step = 2 if window % 2 == 0 and width * width <= 1 << 16 else 1
    kind = np.uint16
    before, string_of, place_of, shard_of = [], [], [], []
    number = at = 0
    for shard_number, shard in enumerate(shards):
        lengths = np.asarray([len(s) + 1 for s in shard], dtype=np.int64)
        ends = np.cumsum(lengths) - 1
        codes = np.zeros(int(lengths.sum()), dtype=np.int64)
        solid = np.ones(len(codes), dtype=bool)
        solid[ends] = False
        codes[solid] = code_of[raw[at : at + int(solid.sum())]]
        at += int(solid.sum())
        order, previous = rotations(codes, lengths, window)
        symbol = codes[previous]
        if step == 2:
            symbol = codes[previous[previous]] * width + symbol
        owner = np.repeat(np.arange(len(shard)), lengths)
        before.append(symbol[order].astype(kind))
        string_of.append(owner[order] + number)
        place_of.append((np.arange(len(codes)) - (ends + 1 - lengths)[owner])[order])
        shard_of.append(np.full(len(codes), shard_number, dtype=np.uint8))
        number += len(shard)
    symbols = np.concatenate(before)
    shard = np.concatenate(shard_of)
    block = np.zeros(len(shard), dtype=np.int32)
    merged = np.empty_like(symbols)
    edge = np.zeros(len(shard), dtype=np.int32)
    for _ in range(window // step):
        merged[np.argsort(shard, kind="stable")] = symbols
        order = np.argsort(merged, kind="stable")
        shard, block, sorted_symbols = shard[order], block[order], merged[order]
        edge[1:] = (sorted_symbols[1:] != sorted_symbols[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(edge, dtype=np.int32)
    rank = np.argsort(shard, kind="stable")
    strings_out, places_out = np.empty(len(shard), dtype=np.int64), np.empty(len(shard), dtype=np.int64)
    strings_out[rank], places_out[rank] = np.concatenate(string_of), np.concatenate(place_of)
    return strings_out, places_out, block


def repeated(strings: list[bytes], keys: np.ndarray, window: int, shard_bytes: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """String number and place of every window that also starts in a string with a smaller key."""
    shards: list[list[bytes]] = [[]]
    size = 0
    goal = max(shard_bytes, sum(map(len, strings)) // 200)
    for s in strings:
        if size > goal:
            shards.append([])
            size = 0
        shards[-1].append(s)
        size += len(s)
    string, place, block = merge_shards(shards, window)
    whole = place + window <= np.asarray([len(s) for s in strings], dtype=np.int64)[string]
    starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    least = np.minimum.reduceat(np.where(whole, keys[string], _LAST), starts)[block]
    gone = whole & (least < keys[string])
    return string[gone], place[gone]


def united(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of intervals."""
    runs: list[list[int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return runs


def united_spans(spans: Sequence[int]) -> list[list[int]]:
    """The same of intervals written as first << 32 | last + 1."""
    ordered = np.sort(np.asarray(spans, dtype=np.int64))
    first, upto = ordered >> 32, np.maximum.accumulate(ordered & 0xFFFFFFFF)
    new = np.flatnonzero(first[1:] > upto[:-1]) + 1
    return np.stack([first[[0, *new]], upto[[*(new - 1), -1]]], axis=1).tolist() if len(ordered) else []


# --- tasks ------------------------------------------------------------------------------


def context_keys(data: bytes, places: np.ndarray, reach: int) -> np.ndarray:
    """40 bits of the hash of each gram and 12 bits each of the ``reach`` bytes before and after it."""
    padded = b"\0" * (reach + 7) + data + b"\0" * (reach + 7)
    shift = reach + 7
    words = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))

    def hashed(begin: np.ndarray, size: int) -> np.ndarray:
        total = np.zeros(len(begin), dtype=np.uint64)
        for at in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
            total = mix(total + words[begin + at])
        return total

    gram = gram_hashes(data, places)
    before, after = hashed(places + shift - reach, reach), hashed(places + shift + GRAM, reach)
    return (gram & ~np.uint64((1 << 24) - 1)) | ((before >> np.uint64(52)) << np.uint64(12)) | (after >> np.uint64(52))


def _several(group: np.ndarray, rid: np.ndarray) -> np.ndarray:
    """Rows whose group (any order) holds rows of different rids."""
    order = np.argsort(group)
    sorted_group = group[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]]))
    rows = rid[order]
    mixed = np.maximum.reduceat(rows, starts) != np.minimum.reduceat(rows, starts)
    out = np.empty(len(group), dtype=bool)
    out[order] = np.repeat(mixed, np.diff(np.append(starts, len(group))))
    return out


def _sides(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram with the bytes before it, and gram with those after it, as two numbers."""
    low = np.int64((1 << 12) - 1)
    return key & ~low, (key & ~np.int64((1 << 24) - 1)) | (key & low)


#: packed = place << 32 | copies in the task (to 32767) << 17 | settled << 16 | windows << 8 | gram's place in the segment
_COPIES, _SETTLED = np.int64(17), np.int64(1 << 16)


def _shared_grams(docs: DataFrame, window: int, hot: int) -> DataFrame:
    """Segments that another row may share: (rid, packed). Rows with a null rid name the very common grams.

    Every window that contains a gram also contains the (window - 16) / 2 bytes before it or those after it, so two
    rows can only share a window if gram and one side agree; a hash of gram and sides is the key.
    """
    reach = (window - GRAM) // 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        carried: int | None = None  # the last row of the flush before

        def flush() -> dict:
            nonlocal carried
            key, rid, packed = (np.concatenate(x) for x in zip(*held))
            held.clear()
            torn = (rid == rid[-1]) | (rid == carried) if carried is not None else rid == rid[-1]
            carried = int(rid[-1])
            before, after = _sides(key)
            known = _several(before, rid) | _several(after, rid)
            order = np.argsort(key)
            sorted_key = key[order]
            starts = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
            first = order[starts]
            copies = np.minimum(np.diff(np.append(starts, len(key))), 32_767)
            asks = ~known
            asks[first] = True  # one row of those known to repeat speaks for all of its rid and the others
            # A row with segments in other flushes would meet only itself there: one of another rid asks as well.
            group = np.repeat(np.arange(len(first)), np.diff(np.append(starts, len(key))))
            differ = np.flatnonzero((rid[order] != rid[first][group]) & torn[first][group])
            groups, at = np.unique(group[differ], return_index=True)
            asks[order[differ[at]]] = True
            copies[groups] -= 1
            n = np.ones(len(key), dtype=np.int64)
            n[first] = np.where(known[first], copies, 1)
            told = np.flatnonzero(known)
            with np.errstate(over="ignore"):
                apart = mix(rid[told].view(np.uint64)).view(np.int64)
            return {
                "key": np.concatenate([key[asks], apart]), "rid": np.concatenate([rid[asks], rid[told]]),
                "packed": np.concatenate([packed[asks] | (n[asks] << _COPIES), packed[told] | _SETTLED]),
            }

        for part in slices(batches, "text", 4 * STRETCH):
            rids = np.asarray(part["rid"], dtype=np.int64)
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part["text"]]
            joined, starts = b"".join(texts), np.cumsum([0, *map(len, texts)])
            for number, at, windows, place, _ in segments(texts, window):
                key = context_keys(joined, starts[number] + place, reach).view(np.int64)
                held.append((key, rids[number], (at << 32) | (windows << 8) | (place - at)))
                size += len(key)
                if size > FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        gram = ~np.int64((1 << 24) - 1)

        def settle(rows: tuple[np.ndarray, ...]) -> dict:
            key, rid, packed = rows
            # Most grams are alone; rows come sorted, so neighbours tell.
            same = (key[1:] & gram) == (key[:-1] & gram)
            near = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            key, rid, packed = key[near], rid[near], packed[near]
            if not len(key):
                return {"rid": [], "packed": []}
            n = (packed >> _COPIES) & 32_767
            kept = np.zeros(len(key), dtype=bool)
            common: list[np.ndarray] = []
            for side in _sides(key):
                kept |= _several(side, rid)
                names, which = np.unique(side, return_inverse=True)
                common.append(names[np.bincount(which, weights=n) > hot] & gram)
            hot_grams = np.unique(np.concatenate(common))
            return {"rid": [*rid[kept].tolist(), *[None] * len(hot_grams)], "packed": np.concatenate([packed[kept], hot_grams])}

        for batch in batches:
            key, rid, packed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "rid", "packed"))
            settled = packed & _SETTLED != 0
            if settled.any():
                yield {"rid": rid[settled], "packed": packed[settled]}
            held.append((key[~settled], rid[~settled], packed[~settled]))
            size += int((~settled).sum())
            if size > 500_000:
                rows = tuple(np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(rows[0], rows[0][-1] & gram))  # the last gram may go on
                if cut:
                    yield settle(tuple(x[:cut] for x in rows))
                held, size = [tuple(x[cut:] for x in rows)], len(rows[0]) - cut
        if held:
            yield settle(tuple(np.concatenate(x) for x in zip(*held)))

    rows = arrow_map(docs.select("rid", "text"), find, "key long, rid long, packed long")
    return arrow_map(rows.repartition(F.shiftright("key", 24)).sortWithinPartitions("key"), keep, "rid long, packed long")


def _intervals(texts: DataFrame, common_grams: np.ndarray, window: int) -> DataFrame:
    """Removed intervals (rid, span = first byte << 32 | last byte + 1) from texts with their shared segments."""
    shared = texts.sparkSession.sparkContext.broadcast(np.sort(common_grams))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("key", "settled", "doc", "rid", "at", "data", "upto")
        known = shared.value
        asked: dict[bytes, list] = {}  # the key, then its places
        held = 0

        def flush() -> dict:
            keys, docs, rids, places, strings = [], [], [], [], []
            done: dict[int, list[tuple[int, int]]] = {}
            for s, entry in asked.items():
                least = entry[1][0] if len(entry) == 2 else min(entry[1:])[0]
                for doc, rid, at in entry[1:]:
                    if doc > least:
                        done.setdefault(rid, []).append((at, at + len(s)))
                    else:
                        keys.append(entry[0])
                        docs.append(doc)
                        rids.append(rid)
                        places.append(at)
                        strings.append(s)
            asked.clear()
            runs = [(rid, a, b) for rid, spans in done.items() for a, b in united(spans)]
            owners, firsts, ends = (list(x) for x in zip(*runs)) if runs else ([], [], [])
            open_rows, none = len(keys), [0] * len(runs)
            columns = (
                keys + owners, [False] * open_rows + [True] * len(runs), docs + none, rids + owners, places + firsts,
                strings + [b""] * len(runs), [0] * open_rows + ends,
            )
            return dict(zip(names, columns))

        for part in slices(batches, "text"):
            for doc, rid, text, packs in zip(part["doc"], part["rid"], part["text"], part["packs"]):
                data = text.encode("utf-8", "surrogatepass")
                packed = np.asarray(packs, dtype=np.int64)
                start, windows, gram = packed >> 32, (packed >> 8) & 255, packed & 255
                hashes = gram_hashes(data, start + gram).view(np.int64) & ~np.int64((1 << 24) - 1)
                spot = np.searchsorted(known, hashes)
                common = known[np.minimum(spot, len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)
                stop = start + windows + (window - 1)
                for at, upto, h, single in zip(start.tolist(), stop.tolist(), hashes.tolist(), common.tolist()):
                    if single:
                        for p in range(at, upto - window + 1):
                            s = data[p : p + window]
                            entry = asked.get(s)
                            if entry is None:
                                asked[s] = [xxhash.xxh3_64_intdigest(s) - (1 << 63), (doc, rid, p)]
                            else:
                                entry.append((doc, rid, p))
                    else:
                        s = data[at:upto]
                        entry = asked.get(s)
                        if entry is None:
                            asked[s] = [h, (doc, rid, at)]
                        else:
                            entry.append((doc, rid, at))
                held += len(packed)
                if held > 250_000 or len(asked) > 250_000:
                    yield flush()
                    held = 0
        if asked:
            yield flush()

    def settle(rows: list[tuple]) -> dict:
        """Rows of whole grams: (key, doc, rid, at, data)."""
        rids: list[int] = []
        spans: list[int] = []

        def add(rid: int, a: int, b: int) -> None:
            rids.append(rid)
            spans.append(a << 32 | b)

        same: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        different: dict[int, int] = {}
        for key, doc, rid, at, data in rows:
            known = same.get((key, data))
            if known is None:
                same[key, data] = [(doc, rid, at)]
                different[key] = different.get(key, 0) + 1
            else:
                known.append((doc, rid, at))
        strings, least, holders = [], [], []
        for (key, data), places in same.items():
            doc = places[0][0]
            if len(places) > 1:
                doc = min(places)[0]
                for d, rid, at in places:
                    if d > doc:
                        add(rid, at, at + len(data))
            if different[key] > 1:
                strings.append(data)
                least.append(doc)
                holders.append([(rid, at) for d, rid, at in places if d == doc])
        if strings:
            string, place = repeated(strings, np.asarray(least, dtype=np.int64), window)
            order = np.lexsort((place, string))
            string, place = string[order], place[order]
            cut_at = np.flatnonzero((np.diff(string) != 0) | (np.diff(place) > window)) + 1
            for a, b in zip(np.concatenate([[0], cut_at]).tolist(), np.concatenate([cut_at, [len(string)]]).tolist()):
                if b > a:
                    for rid, at in holders[string[a]]:
                        add(rid, at + int(place[a]), at + int(place[b - 1]) + window)
        return {"rid": rids, "span": spans}

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        columns = ("key", "doc", "rid", "at", "data")
        held: list[tuple] = []
        size = 0
        for batch in batches:
            settled = batch.column("settled").to_numpy(zero_copy_only=False)
            if settled.any():
                rid, at, upto = (batch.column(c).to_numpy(zero_copy_only=False)[settled] for c in ("rid", "at", "upto"))
                yield {"rid": rid, "span": at << 32 | upto}
                batch = batch.filter(pa.array(~settled))
                if not batch.num_rows:
                    continue
            if size > 1_000_000:
                key = batch.column("key").to_numpy(zero_copy_only=False)
                rest = int(np.argmax(key != held[-1][0])) if key[-1] != held[-1][0] else len(key)
                if rest < len(key):  # the gram held last ends here
                    held += zip(*(batch.column(c).slice(0, rest).to_pylist() for c in columns))
                    yield settle(held)
                    held, size = [], 0
                    batch = batch.slice(rest)
            held += zip(*(batch.column(c).to_pylist() for c in columns))
            size += pc.sum(pc.binary_length(batch.column("data"))).as_py()
        if held:
            yield settle(held)

    rows = arrow_map(texts, cut, "key long, settled boolean, doc long, rid long, at long, data binary, upto long")
    return arrow_map(rows.repartition("key").sortWithinPartitions("settled", "key"), merge, "rid long, span long")


def remove_repeats(docs: DataFrame, window: int = 50, hot: int | None = None, keep: list[str] | None = None, texts: bool = False) -> DataFrame:
    """Texts without the bytes of ``window``-byte strings that also start in a document with a smaller doc_id.

    One row for each row of ``docs`` (doc_id and text; other columns are passed on only if named in ``keep``):
    n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and, with ``texts``, the kept text as kept_text
    (bytes that a cut left without their character are dropped there). Strings are judged on the input. A null text
    is empty; a text of under ``window`` bytes loses nothing; rows with the same doc_id do not remove from each other;
    a null doc_id comes after all others. ``hot`` (default: segments for 0.5 % of the rows) only chooses how very common
    grams are dealt out.
    """
    keep = keep or []
    spark = docs.sparkSession
    full = F.xxhash64("doc_id", "text")
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST - 1))
    facts = materialize(docs.select(
        order.alias("doc"), full.alias("full"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit("text"), "text").alias("b")
    ))
    # The number itself is the key of a row unless different texts share it; it packs better than a hash.
    clash = facts.groupBy("doc").agg(F.min("full").alias("x"), F.max("full").alias("y")).where("x <> y").limit(1).count()
    rid = full if clash else order
    whole = docs.select("doc_id", *[c for c in keep if c not in ("doc_id", "text")], "text", rid.alias("rid"))
    # Of equal texts only those with the smallest number go on; the others lose all they have.
    least = facts.groupBy("a", "b").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("most > least")
    copies = materialize(facts.join(least, ["a", "b"]).where("doc > least").select((F.col("full") if clash else F.col("doc")).alias("rid")).distinct())
    firsts = whole.select(order.alias("doc"), "rid", "text").join(small_or_none(copies) or copies, "rid", "left_anti")
    hot = hot if hot is not None else max(2_000, int(0.005 * facts.count()))
    scratch = Scratch(spark)
    found = scratch.keep(_shared_grams(firsts, window, hot))
    release(spark, settled=True)
    # Each stands for over ``hot`` segments, so there are at most (segments of a document) / 0.005 of them.
    common = found.where("rid IS NULL").select("packed").toPandas()["packed"].to_numpy(dtype=np.int64)
    shared = found.where("rid IS NOT NULL").groupBy("rid").agg(F.collect_set("packed").alias("packs"))
    gone = _intervals(firsts.join(shared, "rid").select("doc", "rid", "text", "packs"), common, window)
    gone = gone.unionByName(copies.select("rid", F.lit(-1).cast("long").alias("span")))
    spans = materialize(gone.groupBy("rid").agg(F.collect_set("span").alias("spans")))
    del gone, shared
    scratch.drop(found)

    names = [c for c in whole.columns if c not in ("text", "rid")]
    types = dict(whole.dtypes)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in slices(batches, "text"):
            out: dict[str, list] = {c: part[c] for c in names} | {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
            if texts:
                out["kept_text"] = []
            for text, cuts in zip(part["text"], part["spans"]):
                data = (text or "").encode("utf-8", "surrogatepass")
                if cuts and -1 in cuts:  # a copy
                    runs = [[0, len(data)]] if len(data) >= window else []
                else:
                    runs = united_spans(cuts or ())
                edges = [0, *(x for run in runs for x in run), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(kept))
                out["n_spans"].append(len(runs))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if texts:
                    out["kept_text"].append(kept.decode("utf-8", "ignore"))
            yield out

    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if texts:
        schema += ", kept_text string"
    return arrow_map(whole.join(spans, "rid", "left").drop("rid"), finish, schema)
