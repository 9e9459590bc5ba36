"""Exact set-similarity join of texts by their word n-grams, through token-combination prefixes.

Two sets with Jaccard similarity of at least t share many of the first tokens in any common order. The order here puts
tokens that are known to repeat last, most frequent at the end, so the prefix of a set (all but ceil(t n) tokens, and
one more) holds rare tokens unless nearly all its tokens are frequent:

* a rare token of the prefix is an index entry of its own;
* hot tokens, shared by a given share of all sets, enter as combinations of two: sets that share no rare token of
  their prefixes share two hot ones, because the prefix was extended by one.

Index lists are sorted by set size. A short list gives all its pairs. The prefix is extended further by a fiftieth of the
set, and sets that link share more tokens of their prefixes than the smaller extension has: a pair that met in too few
lists goes, unless tokens of long lists or hot ones, which no pair was counted for, could make up for it. Of the pairs
left, one whose class counts bound the overlap too low is dropped. A long list gives a chain instead, broken where sizes
rule a link out; that of a rare token leads only through members that could link by long lists and hot tokens alone. So
n-grams that large texts share by chance, whose pairs grow with the square of the corpus, neither carry class counts nor
tie clusters together. What hangs together is a candidate cluster; its sets are compared exactly, in blocks, by inverted lists. Nothing
is ever emitted for each pair of a long list, and no list or cluster is held by one task.

Frequencies only decide the order, so links never depend on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from msgrisk.llm.common import Scratch, arrow_map, mix, slices
from msgrisk.operators.corpus import connected_groups
from msgrisk.operators.scale import ordered_within_key

_FACTORS = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
#: Tokens that one part of a block of a cluster holds, and what every set adds to its own.
BLOCK_TOKENS, BLOCK_FLOOR = 400_000, 400
#: The prefix of a set is extended by one of so many of its tokens.
SPARE_PART = 50
#: What an index list gives.
PAIR, ENTRY, CHAIN = 0, 1, 2


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; a shorter text is one run, no words are none."""
    listed = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not listed:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, listed)), dtype=np.uint64)
    runs = max(1, len(hashes) - words + 1)
    total = np.full(runs, min(len(hashes), words), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(words, len(hashes))):
            total = mix(total * _FACTORS[0] + hashes[j : j + runs] * _FACTORS[1])
    return np.unique(total)


def classes(tokens: np.ndarray) -> bytes:
    """How many tokens fall in each of 2**k equal ranges (k follows the size): one byte each, 255 for more."""
    bits = max(3, int(len(tokens)).bit_length() - 2)
    counts = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def overlap_bound(a: bytes, b: bytes) -> int:
    """No two sets with these class counts share more tokens."""
    x, y = (np.frombuffer(v, dtype=np.uint8).astype(np.int64) for v in (a, b))
    if x.max() == 255 or y.max() == 255:
        return 1 << 40
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(size, -1).sum(1), y.reshape(size, -1).sum(1)).sum())


def prefix_size(n, percent: int, spare: int = 1):
    """Tokens of the prefix, extended by ``spare``, of a set of ``n``."""
    return np.minimum(n, n + (-(percent * n) // 100) + 1 + spare)


def spare(n: int) -> int:
    """Tokens by which the prefix of a set of ``n`` is extended; two sets that link share one more than the smaller's."""
    return max(1, n // SPARE_PART)


def _pairs_of(tokens: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of all combinations of two of the sorted tokens, some rows at a time."""
    with np.errstate(over="ignore"):
        for i in range(len(tokens) - 1):
            yield mix(tokens[i] * _FACTORS[0] + tokens[i + 1 :] * _FACTORS[1], 5)


def _first_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[dict, list[np.ndarray], list[int | None], list[bool]]]:
    """Batches with the sets of their texts, the keys of the sets, and which are (mostly) the first of their kind in the task."""
    seen: set[int] = set()
    for part in slices(batches, "text"):
        found = [shingles(t, words) for t in part["text"]]
        sids = [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) if len(x) else None for x in found]
        first = []
        for sid in sids:
            first.append(sid is not None and sid not in seen)
            if first[-1] and len(seen) < 300_000:
                seen.add(sid)
        yield part, found, sids, first


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def _frequent(docs: DataFrame, words: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that repeat inside tasks and how often, the most frequent ``limit`` or fewer: the order of tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: list[np.ndarray] = []
        size = 0

        def count() -> dict:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            again = counts > 1
            return {"token": tokens[again].view(np.int64), "cnt": counts[again]}

        for _, found, _, first in _first_sets(batches, words):
            for own, told in zip(found, first):
                if told and len(own) > 1:
                    held.append(own)
                    size += len(own)
            if size > 2_000_000:
                yield count()
                size = 0
        if held:
            yield count()

    scratch = Scratch(docs.sparkSession)
    counted = scratch.keep(arrow_map(docs.select("text"), work, "token long, cnt long").groupBy("token").agg(F.sum("cnt").alias("cnt")))
    steps = counted.groupBy(F.floor(F.log2("cnt") * 8).alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()
    least, total = 0, 0
    for row in steps:  # a few hundred rows at most
        if total + row["n"] > limit:
            break
        least, total = row["step"], total + row["n"]
    kept = counted.where(F.floor(F.log2("cnt") * 8) >= (least if total else 1 << 30)).toPandas()
    scratch.drop(counted)
    tokens, counts = kept["token"].to_numpy(dtype=np.int64).view(np.uint64), kept["cnt"].to_numpy(dtype=np.int64)
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _sets(docs: DataFrame, words: int, frequent: tuple[np.ndarray, np.ndarray], hot: int, percent: int) -> DataFrame:
    """A row for each document, with the rare and the hot tokens of its prefix only.

    Hot ones are those of the prefix extended by one, ``hidden`` counts them in the whole prefix. Of equal sets in a task the
    first carries them and its class counts, the others (mostly) none. Whole sets are not written: those that are compared
    are made again from their texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most the limit given to _frequent

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known, often = shared.value

        def prefix(tokens: np.ndarray) -> tuple[bytes, bytes, int]:
            count = np.zeros(len(tokens), dtype=np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
                same = known[at] == tokens
                count[same] = often[at[same]]
            first = np.argsort(count, kind="stable")[: int(prefix_size(len(tokens), percent, spare(len(tokens))))]
            rare = count[first] < hot
            near = first[: int(prefix_size(len(tokens), percent))]
            return tokens[first[rare]].tobytes(), np.sort(tokens[near[~rare[: len(near)]]]).tobytes(), int((~rare).sum())

        for part, found, sids, first in _first_sets(batches, words):
            prefixes = [prefix(x) if f else (b"", b"", 0) for x, f in zip(found, first)]
            yield {
                "doc_id": part["doc_id"], "rid": part["rid"], "n": [len(x) for x in found], "sid": sids,
                "classes": [classes(x) if f else b"" for x, f in zip(found, first)],
                "rare": [x for x, _, _ in prefixes], "hot": [x for _, x, _ in prefixes], "hidden": [x for _, _, x in prefixes],
            }

    rows = docs.select(F.col("doc_id").cast("long"), "text", _row_key().alias("rid"))
    return arrow_map(rows, work, "doc_id long, rid long, n int, sid long, classes binary, rare binary, hot binary, hidden int")


def _index_entries(sets: DataFrame) -> DataFrame:
    """Index entries; the lowest bit of ``sig`` tells a combination of hot tokens (1) from a rare token (0)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[int] = set()  # spares repeated sets; the lists drop those that are left
        sigs: list[np.ndarray] = []
        sids: list[int] = []
        sizes: list[int] = []
        lengths: list[int] = []
        held = 0

        def flush() -> dict:
            out = {
                "sig": np.concatenate(sigs).view(np.int64), "sid": np.repeat(np.asarray(sids, dtype=np.int64), lengths),
                "n": np.repeat(np.asarray(sizes, dtype=np.int32), lengths),
            }
            for x in (sigs, sids, sizes, lengths):
                x.clear()
            return out

        for batch in batches:
            for sid, n, *parts in zip(batch.column("sid").to_pylist(), batch.column("n").to_pylist(), batch.column("rare"), batch.column("hot")):
                if sid in seen:
                    continue
                if len(seen) < 300_000:
                    seen.add(sid)
                rare, hot = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in parts)
                for entry in (rare & ~np.uint64(1), *(x | np.uint64(1) for x in _pairs_of(hot))):
                    if len(entry):
                        sigs.append(entry)
                        sids.append(sid)
                        sizes.append(n)
                        lengths.append(len(entry))
                        held += len(entry)
                        if held > 200_000:
                            yield flush()
                            held = 0
        if sigs:
            yield flush()

    return arrow_map(sets.where("n > 1 AND length(classes) > 0").select("sid", "n", "rare", "hot"), work, "sig long, sid long, n int")


def _list_edges(entries: DataFrame, short: int, percent: int) -> DataFrame:
    """Pairs of short lists ``(a, b, na, nb, shared)``, what long ones give, and which it is (``kind``).

    ``shared`` counts the rare tokens among the lists. A long list of a rare token gives its entries, its sig as ``a`` and a set
    as ``b``; that of a combination gives a chain through its members, of whose equal links a task emits (mostly) one. One list
    after the other streams through a task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last, token = None, 0  # the list that a batch may have cut
        held_sid, held_n, long = [], [], False
        names = ("kind", "a", "b", "na", "nb", "shared")
        out: list[tuple] = []
        chained: set[tuple[int, int]] = set()

        def link(i: int, s: int, k: int) -> None:
            pair = (min(held_sid[i], s), max(held_sid[i], s))
            if held_n[i] * 100 >= percent * k and pair not in chained:
                if len(chained) < 300_000:
                    chained.add(pair)
                out.append((CHAIN, *pair, 0, 0, 0))

        def close() -> None:
            if not long:
                for i in range(len(held_sid)):
                    for j in range(i + 1, len(held_sid)):
                        if held_n[i] * 100 >= percent * held_n[j]:
                            pair = sorted(((held_sid[i], held_n[i]), (held_sid[j], held_n[j])))
                            out.append((PAIR, pair[0][0], pair[1][0], pair[0][1], pair[1][1], token))

        def table() -> dict:
            return dict(zip(names, map(list, zip(*out))))

        for batch in batches:
            sig, sid, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "sid", "n"))
            new = np.empty(len(sig), dtype=bool)
            new[0] = last is None or sig[0] != last
            new[1:] = sig[1:] != sig[:-1]
            starts = np.flatnonzero(new)
            if not new[0]:  # the list goes on from the batch before, maybe through this whole batch
                starts = np.insert(starts, 0, 0)
            ends = np.append(starts[1:], len(sig))
            wanted = (ends - starts > 1) | (starts == 0) | (ends == len(sig))
            for a, b in zip(starts[wanted].tolist(), ends[wanted].tolist()):
                if last is None or sig[a] != last:
                    close()
                    last, token, held_sid, held_n, long = int(sig[a]), 1 - int(sig[a] & 1), [], [], False
                for s, k in zip(sid[a:b].tolist(), n[a:b].tolist()):
                    if held_sid and held_sid[-1] == s:
                        continue
                    held_sid.append(s)
                    held_n.append(k)
                    if not long and len(held_sid) <= short:
                        continue
                    if token:
                        out += [(ENTRY, last, x, 0, y, token) for x, y in zip(held_sid[int(long) :], held_n[int(long) :])]
                    else:
                        for i in range(len(held_sid) - 1):
                            link(i, held_sid[i + 1], held_n[i + 1])
                    held_sid, held_n, long = [s], [k], True
            if len(out) > 50_000:
                yield table()
                out.clear()
        close()
        if out:
            yield table()

    sorted_lists = entries.repartition("sig").sortWithinPartitions("sig", "n", "sid")
    edges = arrow_map(sorted_lists, work, "kind int, a long, b long, na int, nb int, shared int")
    return edges.groupBy("kind", "a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("shared").alias("shared"))


def _unseen(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """For sets that have such, the tokens of their prefix that no pair was counted for: hot ones and those of long lists."""
    hot = sets.where("hidden > 0").groupBy("sid").agg(F.max("hidden").cast("long").alias("unseen"))
    listed = edges.where(F.col("kind") == ENTRY).groupBy(F.col("b").alias("sid")).agg(F.count(F.lit(1)).alias("unseen"))
    return hot.unionByName(listed).groupBy("sid").agg(F.sum("unseen").alias("unseen"))


def _spare(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / SPARE_PART))


def _counted(edges: DataFrame, unseen: DataFrame) -> DataFrame:
    """Pairs that share enough tokens of their prefixes, as far as these were counted."""
    pairs = edges.where(F.col("kind") == PAIR).select("a", "b", "na", "nb", "shared", F.least(_spare(F.col("na")), _spare(F.col("nb"))).alias("beyond"))
    sides = [unseen.select(F.col("sid").alias(c), F.col("unseen").alias(f"_{c}")) for c in ("a", "b")]
    others = pairs.where("shared <= beyond").join(sides[0], "a").join(sides[1], "b").where(F.col("shared") + F.least("_a", "_b") > F.col("beyond"))
    columns = ["a", "b", "na", "nb"]
    return pairs.where("shared > beyond").select(*columns).unionByName(others.select(*columns))


def _chains(edges: DataFrame, unseen: DataFrame, percent: int) -> DataFrame:
    """Chains of combinations, and one through each long list of a rare token of those sets that could link by what is unseen alone.

    The lists of a group of near copies hold the same sets in the same order: of equal links a task emits (mostly) one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[tuple[int, int]] = set()
        last = [np.zeros(0, dtype=np.int64)] * 3
        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sig", "sid", "n")]
            sig, sid, n = map(np.concatenate, zip(last, own))
            last = [x[-1:] for x in (sig, sid, n)]
            linked = (sig[1:] == sig[:-1]) & (n[:-1] * 100 >= percent * n[1:])
            found = dict.fromkeys(zip(np.minimum(sid[1:], sid[:-1])[linked].tolist(), np.maximum(sid[1:], sid[:-1])[linked].tolist()))
            new = [x for x in found if x not in seen]
            if len(seen) < 300_000:
                seen.update(new)
            yield {"u": [u for u, _ in new], "v": [v for _, v in new]}

    least = F.expr(f"(cast(nb AS long) * {percent} + 99) div 100")  # of a set that links with it
    listed = edges.where(F.col("kind") == ENTRY).select(F.col("a").alias("sig"), F.col("b").alias("sid"), F.col("nb").alias("n"), _spare(least).alias("beyond"))
    own = listed.join(unseen, "sid").where("unseen > beyond").select("sig", "sid", "n")
    chains = edges.where(F.col("kind") == CHAIN).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return arrow_map(own.repartition("sig").sortWithinPartitions("sig", "n", "sid"), work, "u long, v long").unionByName(chains).distinct()


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Those pairs whose class counts allow a link; and the scratch table these are read from."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows = batch.to_pydict()
            keep = [
                overlap_bound(x, y) * (100 + percent) >= percent * (n + m)
                for x, y, n, m in zip(rows["ca"], rows["cb"], rows["na"], rows["nb"])
            ]
            yield {"u": [a for a, k in zip(rows["a"], keep) if k], "v": [b for b, k in zip(rows["b"], keep) if k]}

    counts = sets.where("n > 1").groupBy("sid").agg(F.max("classes").alias("c"))
    counts = scratch.keep(counts.join(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid"))
    met = (
        pairs.join(counts.select(F.col("sid").alias("a"), F.col("c").alias("ca")), "a")
        .join(counts.select(F.col("sid").alias("b"), F.col("c").alias("cb")), "b")
    )
    return arrow_map(met, work, "u long, v long"), counts


def _filter_bits(spark, keys: DataFrame, bits: int = 26) -> np.ndarray:
    """A bit for the hash of every key, 2**bits in all: 8 MB whatever the number of keys."""
    placed = keys.select(F.pmod(F.xxhash64("node"), F.lit(1 << bits)).alias("place"))
    bit = F.expr("shiftleft(cast(1 AS long), cast(place % 64 AS int))")
    words = placed.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("b")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)
    return out


def _placed(sets: DataFrame, clusters: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """For every clustered set its block, its copies and the comparisons that need it (sid, cluster, block, copies, jobs); and the table below.

    Blocks of a cluster hold neighbouring sizes, and only pairs of blocks whose sizes allow a link are compared. Blocks are
    cut by running sums over pieces of a cluster, so no task sums up a whole one. Nothing here carries tokens.
    """
    own = clusters.select(F.col("node").alias("sid"), F.col("component").alias("cluster"))
    sizes = sets.where("n > 1").groupBy("sid").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")).join(own, "sid").withColumns({
        "_cost": F.col("n").cast("long") + BLOCK_FLOOR,
        "_piece": F.col("n").cast("long") * 64 + F.shiftright("sid", 58) + 32,
    })
    summed = ordered_within_key(sizes, ["cluster"], ["n", "sid"], "_piece", running={"_cost": "_before_it"})
    blocks = scratch.keep(summed.select("cluster", "sid", "n", "copies", F.floor(F.col("_before_it") / BLOCK_TOKENS).cast("int").alias("block")))
    ranges = blocks.groupBy("cluster", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = ranges.select("cluster", F.col("block").alias("high"), F.col("least").alias("high_least"))
    jobs = ranges.join(other, "cluster").where((F.col("high") >= F.col("block")) & (F.col("most") * 100 >= percent * F.col("high_least")))
    job = F.struct(F.col("block").alias("low"), "high")
    sides = jobs.select("cluster", job.alias("job"), F.explode(F.array_distinct(F.array("block", "high"))).alias("block"))
    wanted = sides.groupBy("cluster", "block").agg(F.collect_list("job").alias("jobs"))
    return blocks.join(wanted, ["cluster", "block"]).select("sid", "cluster", "block", "copies", "jobs"), blocks


def _members(docs: DataFrame, words: int, sets: DataFrame, clusters: DataFrame, placed: DataFrame) -> DataFrame:
    """Clustered sets, once for each comparison of their block.

    One row of each such set is chosen; a fixed-size bit filter drops most other texts unshuffled before the sets are made
    again. Tokens move by set once, where they meet their block, and then to the comparisons.
    """
    own = sets.where("n > 1 AND length(classes) > 0").groupBy("sid").agg(F.min("rid").alias("rid"))
    chosen = own.join(clusters.select(F.col("node").alias("sid")), "sid").select(F.col("rid").alias("node"))
    shared = docs.sparkSession.sparkContext.broadcast(_filter_bits(docs.sparkSession, chosen))
    bits = int(np.log2(len(shared.value) * 64))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = shared.value.view(np.uint64)

        def likely() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = batch.column("place").to_numpy(zero_copy_only=False)
                keep = (table[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
                yield batch.select(["text"]).filter(pa.array(keep))

        for _, found, sids, first in _first_sets(likely(), words):
            told = [(sid, x.tobytes()) for sid, x, f in zip(sids, found, first) if f and len(x) > 1]
            yield {"sid": [sid for sid, _ in told], "tokens": [x for _, x in told]}

    located = docs.select("text", F.pmod(F.xxhash64(_row_key()), F.lit(1 << bits)).alias("place"))
    whole = arrow_map(located, work, "sid long, tokens binary").groupBy("sid").agg(F.first("tokens").alias("tokens"))
    # Both sides lie by sid: a merge join moves no tokens, whatever the sizes.
    met = whole.hint("merge").join(placed.hint("merge"), "sid")
    rows = met.select("cluster", "block", "sid", "copies", "tokens", F.explode("jobs").alias("job")).select("*", "job.low", "job.high").drop("job")
    # Sets of a cluster are alike: written one behind the other they compress.
    return rows.sortWithinPartitions("cluster", "low", "high", "block", "sid")


def compare_block(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Which sets of ``left`` and ``right`` link (with themselves if right is None), by inverted lists."""
    others = left if right is None else right
    sizes_a, sizes_b = (np.asarray([len(x) for x in side], dtype=np.int64) for side in (left, others))
    tokens = np.concatenate(others)
    owners = np.repeat(np.arange(len(others)), sizes_b)
    order = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[order], owners[order]
    linked = np.zeros((len(left), len(others)), dtype=bool)
    for i, own in enumerate(left):
        lo, hi = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        count = hi - lo
        spots = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        common = np.bincount(owners[spots], minlength=len(others))
        linked[i] = 100 * common >= percent * (sizes_a[i] + sizes_b - common)
    if right is None:
        np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least member number of each row's connected part of a symmetric link matrix."""
    label = np.arange(len(linked))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1, initial=len(label)))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _verify(members: DataFrame, percent: int) -> DataFrame:
    """Exact links inside clusters: for each set a set it hangs together with, and the linked documents counted."""

    def settle(rows: list[tuple]) -> Iterator[tuple]:
        left = [r for r in rows if r[0] == r[1]]
        right = [r for r in rows if r[0] != r[1]]
        whole = left + right
        sids = np.asarray([r[2] for r in whole], dtype=np.int64)
        copies = np.asarray([r[3] for r in whole], dtype=np.int64)
        matrix = np.zeros((len(whole), len(whole)), dtype=bool)
        if right:
            part = compare_block([r[4] for r in left], [r[4] for r in right], percent) if left else np.zeros((0, len(right)), dtype=bool)
            matrix[: len(left), len(left) :] = part
            matrix[len(left) :, : len(left)] = part.T
        else:
            matrix = compare_block([r[4] for r in left], None, percent)
        links = matrix @ copies
        root = _roots(matrix)
        for i in np.flatnonzero(links):
            yield int(sids[i]), int(sids[root[i]]), int(links[i])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last = None
        held: list[tuple] = []
        out: list[tuple] = []

        def table() -> dict:
            return dict(zip(("sid", "root", "links"), map(list, zip(*out))))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("cluster", "low", "high", "block", "sid", "copies")]
            for cluster, low, high, block, sid, copies, value in zip(*columns, batch.column("tokens")):
                key = (cluster, low, high)
                if key != last:
                    if held:
                        out += settle(held)
                    last, held = key, []
                held.append((block, low, sid, copies, np.frombuffer(value.as_buffer(), dtype=np.uint64).copy()))
            if len(out) > 20_000:
                yield table()
                out = []
        if held:
            out += settle(held)
        if out:
            yield table()

    grouped = members.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high", "block", "sid")
    return arrow_map(grouped, work, "sid long, root long, links long")


def ngram_components(
    docs: DataFrame, words: int = 5, percent: int = 80, frequent_tokens: int = 500_000, hot_share: float = 0.005, short_list: int = 16,
    row_key: bool = False,
) -> DataFrame:
    """Connected groups of texts whose word ``words``-gram sets have a Jaccard similarity of ``percent`` / 100 or more.

    ``docs`` needs doc_id and text; other columns are ignored. One row for each row: doc_id, n_shingles, component_id
    (smallest doc_id that links reach, its own included) and n_links (other documents it links with). A null, empty or
    wordless text has an empty set, links with nothing and is its own component; rows with equal sets always link,
    repeated rows too; a null doc_id counts as a document but never names a component that has another.
    ``frequent_tokens`` bounds the broadcast order of tokens, not what is found. With ``row_key`` also rid, the row's
    xxhash64 of doc_id and text, and whether the row is the one of its component that stays.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50: below, a set of one n-gram can link with a larger one")
    scratch = Scratch(docs.sparkSession)
    hot = max(256, int(hot_share * docs.count()))
    sets = scratch.keep(_sets(docs, words, _frequent(docs, words, frequent_tokens), hot, percent))
    rows = scratch.keep(sets.select("doc_id", "rid", "n", "sid"))
    edges = scratch.keep(_list_edges(_index_entries(sets), short_list, percent))
    unseen = scratch.keep(_unseen(edges, sets))
    pairs = scratch.keep(_counted(edges, unseen))
    bounded, counts = _bounded(pairs, sets, percent, scratch)
    allowed = scratch.keep(bounded.unionByName(_chains(edges, unseen, percent)))  # read more than once
    scratch.drop(counts, pairs, unseen, edges)
    clusters = scratch.keep(connected_groups(allowed))
    scratch.drop(allowed)
    placed, blocks = _placed(sets, clusters, percent, scratch)
    links = scratch.keep(_verify(_members(docs, words, sets, clusters, placed), percent))
    scratch.drop(sets, clusters, blocks)
    parts = connected_groups(links.select(F.col("sid").alias("u"), F.col("root").alias("v")))
    linked = links.groupBy("sid").agg(F.sum("links").alias("_links")).join(
        parts.select(F.col("node").alias("sid"), F.col("component").alias("_part")), "sid"
    )
    last = F.lit((1 << 63) - 1)
    row = F.struct(F.coalesce("doc_id", last).alias("doc_id"), "rid")
    by_set = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min(row).alias("_least"), F.count(F.lit(1)).alias("_copies"))
    named = scratch.keep(by_set.join(linked, "sid", "left").withColumn("_part", F.coalesce("_part", "sid")))
    least = named.groupBy("_part").agg(F.min("_least").alias("_first"))
    by_set = named.join(least, "_part").select("sid", "_first", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_links"))
    first = F.when(F.col("sid").isNull(), row).otherwise(F.col("_first"))
    return rows.select("doc_id", "rid", F.col("n").cast("long").alias("n_shingles"), "sid").join(by_set, "sid", "left").select(
        "doc_id", "n_shingles", F.nullif(first["doc_id"], last).alias("component_id"), F.coalesce("_links", F.lit(0)).alias("n_links"),
        *([F.col("rid"), (first["rid"] == F.col("rid")).alias("stays")] if row_key else []),
    )
