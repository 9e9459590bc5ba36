"""Alignment of two tokenizers over the same texts, by divide and conquer at shared cuts.

Both tokenizations of a text spell the same bytes. A byte offset where a token of either ends is a shared cut. An interval
of tokens is cut at one near its middle: the end of the middle token of one side is looked up by bisection among the ends
of the other, then those of its neighbours outward; both halves follow in the same way, and an interval without a cut is a
group. All intervals of a block of texts are cut at once, level by level.

Both encoders work on chunks between which neither ever joins tokens; a cache keeps the ids of short ones.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from msgrisk.llm.common import Memo, Scratch, arrow_map, slices
from msgrisk.llm.tokens import LETTER, TextEncoder
from msgrisk.operators.scale import salted_join

#: Rows of the table of linked id pairs up to which it is broadcast (17 bytes each); beyond, it is joined.
BROADCAST_PAIRS = 2_000_000
#: Different pairs a task gathers before it passes them on.
GATHERED_PAIRS = 1_000_000
_MARK = "▁"
# A chunk ends before one blank or line feed that stands between two characters that are not white space, and between a
# word of Latin letters and a mark.
_CHUNKS = re.compile(rf"[ \n]?{LETTER}+(?=[ \n]\S|[.,;:!?|]|\Z)|\s*\S*(?:(?![ \n]\S)\s+\S*)*")
# How the byte-level file cuts a text before it merges.
_WORDS_OF_A = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class PairEncoder:
    """Ids of a text by a byte-level vocabulary (A) and a piece model (B), with the bytes that every id spells.

    ``encode(text)`` gives both as little-endian 32-bit ids, or None where the bytes they spell differ from a blank and the
    text (B's normalization changed it, or there is no text).
    """

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.a = TextEncoder(byte_path, plain=True)
        if self.a.kind != "byte":
            raise ValueError("the first vocabulary must be byte-level without an added blank")
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        letters = {c: b for b, c in self.a.stand_ins.items()}
        self.bytes_a = {i: bytes(letters[c] for c in t) for t, i in self.a.library.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}
        self.bytes_b = {}
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                self.bytes_b[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_MARK, " ").encode()
        spelled = [self.b.id_to_piece(i) for i in self.bytes_b if not self.b.is_byte(i)]
        self.mark, self.feed = self.b.piece_to_id(_MARK), self.b.piece_to_id("<0x0A>")
        # Chunks are safe if no piece reaches over one of their edges: none holds a blank's mark behind another character, a
        # mark behind a letter, or a line feed.
        crossed = re.compile(rf"{LETTER}[.,;:!?|]|[^{_MARK}]{_MARK}|\n")
        self.chunked = self.mark in self.bytes_b and self.feed in self.bytes_b and not any(map(crossed.search, spelled))
        self.size_b = self.b.get_piece_size()
        self.lengths_a, self.lengths_b = (
            np.asarray([len(table.get(i, b"")) for i in range(size)], dtype=np.int64)
            for table, size in ((self.bytes_a, self.a.vocabulary), (self.bytes_b, self.size_b))
        )
        # The same merges as in the file: a merged token's number is its rank, so ranked merging gives the library's ids.
        self.ranked = tiktoken.Encoding("a", pat_str=_WORDS_OF_A, mergeable_ranks={raw: i for i, raw in self.bytes_a.items()}, special_tokens={})
        self.cache = Memo(lambda chunk: self._chunks([chunk])[0])

    def _ids_b(self, chunks: list[str]) -> list[list[int]]:
        """A chunk that begins with a blank is encoded without it, as the model puts one in front; any other is kept away from
        that blank by a line feed, and both are dropped."""
        asked = [c[1:] if c[0] == " " else c if c[0] == "\n" else "\n" + c for c in chunks]
        drop = [0 if c[0] == " " else 1 if c[0] == "\n" else 2 for c in chunks]
        found = self.b.encode(asked, num_threads=1)
        return [ids[n:] if ids[:n] == [self.mark, self.feed][:n] else [] for ids, n in zip(found, drop)]

    def _chunks(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of both tokenizers for each chunk, none where their bytes are not the chunk's."""
        ids = list(map(self.ranked.encode_ordinary, chunks)), self._ids_b(chunks)
        raw = [c.encode() for c in chunks]
        good = [True] * len(chunks)
        for own, table in zip(ids, (self.bytes_a, self.bytes_b)):
            spelled = [b"".join(map(table.__getitem__, x)) for x in own] if all(map(table.keys().__contains__, chain.from_iterable(own))) else [
                b"".join(table.get(i, b"") for i in x) for x in own]
            if spelled != raw:
                good = [g and a == b for g, a, b in zip(good, spelled, raw)]
        return [(array("I", a).tobytes(), array("I", b).tobytes()) if g else None for g, a, b in zip(good, *ids)]

    def encode_all(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """Each text's ids; chunks that are not in the cache are encoded together."""
        cut = [[] if not t else [c for c in _CHUNKS.findall(" " + t) if c] if self.chunked else [" " + t] for t in texts]
        new = list(set().union(*cut) - self.cache.keys())
        known = dict(zip(new, self._chunks(new))) if new else {}
        for chunk, ids in known.items():
            self.cache.offer(chunk, ids)
        known.update((c, self.cache[c]) for c in set().union(*cut) - known.keys())
        out: list[tuple[bytes, bytes] | None] = []
        for chunks in cut:
            found = list(map(known.__getitem__, chunks))
            out.append(None if not found or None in found else (b"".join([f[0] for f in found]), b"".join([f[1] for f in found])))
        return out

    def encode(self, text: str | None) -> tuple[bytes, bytes] | None:
        return self.encode_all([text])[0]


@lru_cache(maxsize=2)
def pair_encoder(byte_path: str, piece_path: str) -> PairEncoder:
    return PairEncoder(byte_path, piece_path)


def cut_groups(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> np.ndarray:
    """Groups (first A token, last + 1, first B token, last + 1), in order.

    ``ends_*`` ascend over all texts; ``first_*`` are the first tokens of every text and, at the end, the number of tokens.
    Every text has tokens of both kinds and both spell as many bytes.
    """
    spans = np.column_stack([first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]])
    leaves = []
    while len(spans):
        a0, a1, b0, b1 = spans.T
        alone = (a1 - a0 <= 1) | (b1 - b0 <= 1)
        leaves.append(spans[alone])
        spans = spans[~alone]
        a0, a1 = spans[:, 0], spans[:, 1]
        middle = (a0 + a1 - 2) // 2
        cut_a, cut_b = np.full(len(spans), -1), np.full(len(spans), -1)
        rest, away = np.arange(len(spans)), 0
        while len(rest):
            for side in ((0,) if away == 0 else (away, -away)):
                probe = middle[rest] + side
                inside = (probe >= a0[rest]) & (probe <= a1[rest] - 2)
                ends = ends_a[probe[inside]]
                at = np.searchsorted(ends_b, ends)
                hit = ends_b[at] == ends
                won = rest[inside][hit]
                cut_a[won], cut_b[won] = probe[inside][hit], at[hit]
                rest = rest[cut_a[rest] < 0]
            away += 1
            rest = rest[(middle[rest] - away >= a0[rest]) | (middle[rest] + away <= a1[rest] - 2)]
        cutless = cut_a < 0
        leaves.append(spans[cutless])
        spans, cut_a, cut_b = spans[~cutless], cut_a[~cutless] + 1, cut_b[~cutless] + 1
        a0, a1, b0, b1 = spans.T
        halves = np.empty((2 * len(spans), 4), dtype=np.int64)  # in order, so the next look-ups run forward
        halves[0::2], halves[1::2] = np.column_stack([a0, cut_a, b0, cut_b]), np.column_stack([cut_a, a1, cut_b, b1])
        spans = halves
    out = np.concatenate(leaves) if leaves else np.zeros((0, 4), dtype=np.int64)
    return out[np.argsort(out[:, 0], kind="stable")]


def linked_tokens(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an A and a B token (by place) whose byte ranges overlap: one for each stretch between any two ends."""
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")
    ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


@lru_cache(maxsize=4)
def _digits(size: int) -> np.ndarray:
    """Decimal spellings of all ids below ``size``, each in six or more columns, zero bytes behind."""
    width = max(6, len(str(size)))
    return np.frombuffer(b"".join(str(i).encode().ljust(width, b"\0") for i in range(size)), dtype=np.uint8).reshape(size, width)


def spelled_groups(ids_a: np.ndarray, ids_b: np.ndarray, groups: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups as text, ``a1,a2|b1;...``: all bytes, and for every group its first byte (and, at the end, their number)."""
    wide_a, wide_b = groups[:, 1] - groups[:, 0], groups[:, 3] - groups[:, 2]
    start = np.cumsum(wide_a + wide_b) - wide_a - wide_b
    tokens = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
    mark = np.full(len(tokens), ord(","), dtype=np.uint8)
    place_a = np.arange(len(ids_a)) + np.repeat(start - groups[:, 0], wide_a)
    place_b = np.arange(len(ids_b)) + np.repeat(start + wide_a - groups[:, 2], wide_b)
    tokens[place_a], tokens[place_b] = ids_a, ids_b
    mark[start + wide_a - 1] = ord("|")
    mark[start + wide_a + wide_b - 1] = ord(";")
    grid = np.concatenate([_digits(size)[tokens], mark[:, None]], axis=1)
    kept = grid != 0
    firsts = np.concatenate([[0], np.cumsum(kept.sum(axis=1))])
    return grid[kept], firsts[np.append(start, len(tokens))]


_ROWS = "rid long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, groups string"


def align_block(texts: list[str | None], encoder: PairEncoder, with_groups: bool) -> dict[str, list]:
    """Counts, digest and linked id pairs (sorted, with their number) of every text."""
    encoded = encoder.encode_all(texts)
    there = [i for i, e in enumerate(encoded) if e]
    out: dict[str, list] = {c: [0] * len(texts) for c in ("n_a", "n_b", "n_groups", "n_links")}
    out |= {"groups_sha256": [""] * len(texts), "pairs": [b""] * len(texts), "times": [b""] * len(texts), "groups": [None] * len(texts)}
    if not there:
        return out
    ids_a, ids_b = (np.frombuffer(b"".join(encoded[i][k] for i in there), dtype="<u4").astype(np.int64) for k in (0, 1))
    first_a, first_b = (np.cumsum([0, *(len(encoded[i][k]) // 4 for i in there)]) for k in (0, 1))
    ends_a, ends_b = np.cumsum(encoder.lengths_a[ids_a]), np.cumsum(encoder.lengths_b[ids_b])
    groups = cut_groups(ends_a, ends_b, first_a, first_b)
    spelled, group_first = spelled_groups(ids_a, ids_b, groups, max(encoder.a.vocabulary, encoder.size_b))
    group_of_text = np.searchsorted(groups[:, 0], first_a)
    link_a, link_b = linked_tokens(ends_a, ends_b)
    owner = np.searchsorted(first_a, link_a, side="right") - 1
    key = (owner << 32) | (ids_a[link_a] * encoder.size_b + ids_b[link_b])
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    times = np.diff(np.append(new, len(key))).astype("<u4")
    key = key[new]
    pair_first = np.searchsorted(key, np.arange(len(there) + 1) << 32)
    links = np.bincount(owner, minlength=len(there))
    pairs = (key & 0xFFFFFFFF).astype("<u4")
    for k, i in enumerate(there):
        g0, g1 = group_of_text[k], group_of_text[k + 1]
        raw = spelled[group_first[g0] : group_first[g1] - 1].tobytes()
        out["n_a"][i], out["n_b"][i] = int(first_a[k + 1] - first_a[k]), int(first_b[k + 1] - first_b[k])
        out["n_groups"][i], out["n_links"][i] = int(g1 - g0), int(links[k])
        out["groups_sha256"][i] = hashlib.sha256(raw).hexdigest()
        p0, p1 = pair_first[k], pair_first[k + 1]
        out["pairs"][i], out["times"][i] = pairs[p0:p1].tobytes(), times[p0:p1].tobytes()
        if with_groups:
            out["groups"][i] = raw.decode()
    return out


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """Links of every id pair over all rows (pair, n, best): ``best`` if no pair with its B id has more."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pairs, times, waiting = [], [], 0
        known, total = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)

        def settle() -> None:
            nonlocal pairs, times, waiting, known, total
            keys = np.concatenate([known, *pairs])
            weights = np.concatenate([total, *times])
            order = np.argsort(keys, kind="stable")
            keys, weights = keys[order], weights[order]
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
            known, total = keys[new], np.add.reduceat(weights, new) if len(new) else weights
            pairs, times, waiting = [], [], 0

        for batch in batches:
            for p, t in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                pairs.append(np.frombuffer(p, dtype="<u4"))
                times.append(np.frombuffer(t, dtype="<u4").astype(np.int64))
                waiting += len(pairs[-1])
                if waiting > 2 * GATHERED_PAIRS:
                    settle()
                    if len(known) > GATHERED_PAIRS:
                        yield {"pair": known.astype(np.int64), "n": total}
                        known, total = known[:0], total[:0]
        settle()
        yield {"pair": known.astype(np.int64), "n": total}

    counts = arrow_map(rows.where("n_links > 0").select("pairs", "times"), task, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # At most as many pairs as A has ids share a B id.
    same = Window.partitionBy(F.col("pair") % F.lit(size_b))
    return counts.withColumn("best", F.col("n") == F.max("n").over(same))


def _looked_up(rows: DataFrame, counts: DataFrame, keep: list[str], types: dict[str, str]) -> DataFrame:
    """Sums over each row's links, from the broadcast table of pairs."""
    found = counts.toArrow().sort_by("pair")
    shared = rows.sparkSession.sparkContext.broadcast(tuple(found.column(c).to_numpy() for c in ("pair", "n", "best")))
    carried = [*keep, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carried), "n_best long, count_sum long"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        pair, n, best = shared.value
        for batch in batches:
            sums, bests = [], []
            for p, t in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
                at = np.searchsorted(pair, np.frombuffer(p, dtype="<u4"))
                times = np.frombuffer(t, dtype="<u4").astype(np.int64)
                sums.append(int((times * n[at]).sum()))
                bests.append(int(times[best[at]].sum()))
            yield {c: batch.column(c) for c in carried} | {"n_best": bests, "count_sum": sums}

    return arrow_map(rows.select(*carried, "pairs", "times"), task, schema)


def _joined_up(rows: DataFrame, counts: DataFrame, keep: list[str]) -> DataFrame:
    """The same sums by a join on the pair, common pairs salted."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            pairs = [np.frombuffer(p, dtype="<u4") for p in batch.column("pairs").to_pylist()]
            if pairs:
                times = np.concatenate([np.frombuffer(t, dtype="<u4") for t in batch.column("times").to_pylist()]).astype(np.int64)
                rid = np.repeat(batch.column("rid").to_numpy(), [len(p) for p in pairs])
                yield {"rid": rid, "pair": np.concatenate(pairs).astype(np.int64), "times": times}

    links = arrow_map(rows.where("n_links > 0").select("rid", "pairs", "times"), unfold, "rid long, pair long, times long")
    met = salted_join(links, counts, ["pair"], "inner", ["rid"])
    sums = met.groupBy("rid").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    return rows.join(sums, "rid", "left").select(
        *keep, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups",
        F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"), F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"),
    )


def align_tokens(
    docs: DataFrame, byte_path: str, piece_path: str, keep: list[str] | None = None, with_groups: bool = False,
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """Rows (keep..., n_a, n_b, n_groups, n_links, groups_sha256, groups, n_best, count_sum), one for each row of ``docs``.

    ``groups`` is the text that was hashed (``a1,a2|b1;...``) if asked for, else null. Null and empty texts, and texts that
    the piece model's normalization changes, have no tokens: zeros and empty strings. Repeated rows all count; ``keep``
    names the columns carried over (``doc_id`` by default), a name that equals a result column is an error; keys may be
    null. Counts of id pairs cover all rows. Every row's pairs are written once to shared storage; the pair table is
    counted before it is broadcast and joined beyond ``broadcast_pairs`` rows.
    """
    keep = ["doc_id"] if keep is None else keep
    own = {"rid", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "n_best", "count_sum", "pairs", "times", "__text"}
    if own & set(keep):
        raise ValueError(f"columns would be doubled: {sorted(own & set(keep))}")
    types = dict(docs.dtypes)
    scratch = Scratch(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = pair_encoder(byte_path, piece_path)
        number = TaskContext.get().partitionId() << 33
        for rows in slices(batches, "__text"):
            found = align_block(rows.pop("__text"), encoder, with_groups)
            rid = np.arange(number, number + len(found["n_a"]))
            number += len(rid)
            yield rows | found | {"rid": rid}

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), _ROWS])
    rows = scratch.keep(arrow_map(docs.select(*keep, F.col("text").alias("__text")), work, schema))
    counts = scratch.keep(pair_counts(rows, pair_encoder(byte_path, piece_path).size_b))
    if counts.count() <= broadcast_pairs:
        return _looked_up(rows, counts, keep, dict(rows.dtypes))
    return _joined_up(rows, counts, keep)
