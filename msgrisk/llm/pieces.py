"""Sampled segmentation into vocabulary pieces, and lossless decoding.

A text is cut before every run of spaces, around every line feed, and between a letter or digit and a mark that no
piece joins. A kind of cut that a piece of the vocabulary would cross is not made, so every piece can be drawn. The
pieces that fit into a part of the text form a lattice. Forward filtering sums the weights of all paths to each
place; backward sampling walks from the end, drawing at each place one of the pieces that end there in proportion to
the weight it brings. The draws are counter-based hashes of the seed, the row's key, the part's number and the
step, so a row is always segmented alike, on any machine and in any order.

Characters that no piece covers, and a space mark in the text itself, are spelled in byte pieces, so decoding returns the text.
Forward tables of parts are kept in a bounded cache; draws compare integers, which do not depend on the cache.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.llm.common import arrow_map, mix, slices

_MARK = "▁"
#: A space of a text is the mark of the pieces; a mark in the text is what no piece has.
_SWAP = str.maketrans({" ": _MARK, _MARK: " "})


class Vocabulary:
    """Pieces, their log weights and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_ids = [0] * 256
        plain: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if " " in piece:
                    continue  # spaces of a text are marks, so it never fits
                self.ids[piece] = i
                plain[piece] = model.get_score(i)
                self.bytes_of[i] = piece.replace(_MARK, " ").encode()
        # Scores of merge vocabularies are ranks, falling by one: weights follow the rank as word counts do.
        best = max(plain.values(), default=0.0)
        ranks = all(float(s).is_integer() for s in plain.values())
        self.logs = {p: -sharpness * float(np.log(best - s + 2)) if ranks else sharpness * s for p, s in plain.items()}
        self.prefixes = {p[:i] for p in self.ids for i in range(1, len(p) + 1)}
        # The prefixes as a tree: (node, character) leads to a node, all steps sorted for one search over many.
        number = {p: i + 1 for i, p in enumerate(sorted(self.prefixes))} | {"": 0}
        steps = sorted(((number[p[:-1]] << 21) | ord(p[-1]), i) for p, i in number.items() if p)
        self.step_keys, self.step_nodes = (np.asarray(x, dtype=np.int64) for x in (zip(*steps) if steps else ((-1,), (0,))))
        self.node_piece = np.full(len(number), -1, dtype=np.int64)
        self.node_log = np.zeros(len(number))
        for p, i in self.ids.items():
            self.node_piece[number[p]], self.node_log[number[p]] = i, self.logs[p]
        # Marks that no piece joins to a letter or digit before them: a text is cut before these as well.
        pairs = {x for p in self.ids for x in zip(p, p[1:])}
        joined = {b for a, b in pairs if a.isalnum()}
        marks = "".join(re.escape(c) for c in ".,;:!?|)" if c not in joined)
        lines = not any("\n" in x for x in pairs)
        spaces = not any(a != _MARK and b == _MARK for a, b in pairs)
        edges = " " * spaces + r"\n" * lines
        one = f"[^{edges}]" if edges else "(?s:.)"
        self.parts = re.compile((r"\n|" if lines else "") + (rf" *+{one}*?[^\W_](?=[{marks}])|" if marks else "") + f" *+{one}+| +")
        self.rare = min(self.logs.values(), default=0.0) - 1.0


class Lattices:
    """Forward tables of parts, laid out for draws from many parts at once.

    A node is a place in a part. Its incoming pieces lie together from ``first[node]`` on, each with the share of the
    32-bit range at which it begins; a draw moves on while the next piece begins at or below it.
    """

    def __init__(self, vocabulary: Vocabulary, limit: int = 250_000):
        self.vocabulary, self.limit = vocabulary, limit
        self.known: dict[str, int] = {}
        self.first = np.zeros(1 << 16, dtype=np.int64)
        self.shares = np.zeros(1 << 16, dtype=np.int64)
        self.pieces = np.zeros(1 << 16, dtype=np.int32)
        self.sources = np.zeros(1 << 16, dtype=np.int64)
        self.arcs = self.nodes = 0
        self.kept: tuple[int, int] | None = None

    def begin(self) -> None:
        """Forget what was added beyond the limit for one slice of rows."""
        if self.kept:
            self.arcs, self.nodes = self.kept

    def ends(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Last node and first node of each part's lattice."""
        new = list(set(parts) - self.known.keys())
        extra: dict[str, int] = {}
        batch: list[tuple[int, int, int, int]] = []
        simple = [p for p in new if len(p) <= 60 and _MARK not in p]
        hard = [p for p in new if len(p) > 60 or _MARK in p]
        for at in range(0, len(simple), 20_000):
            group = simple[at : at + 20_000]
            ends, covered = self._add_many(group)
            done = {p: e for p, e, ok in zip(group, ends.tolist(), covered.tolist()) if ok}
            (self.known if self.kept is None else extra).update(done)
            hard += [p for p, ok in zip(group, covered.tolist()) if not ok]
            self._full()
        for part in hard:
            end, nodes = self._add(part, batch)
            (self.known if self.kept is None else extra)[part] = end
            self._append(*(np.asarray(x, dtype=np.int64) for x in zip(*batch)), nodes)
            batch.clear()
            self._full()
        self.known.update(extra)
        both = np.fromiter(map(self.known.__getitem__, parts), dtype=np.int64, count=len(parts))
        for part in extra:
            del self.known[part]
        last = both & 0xFFFFFFFFFF
        return last, last - (both >> 40)

    def _full(self) -> None:
        if self.kept is None and len(self.known) >= self.limit:
            self.kept = (self.arcs, self.nodes)

    def _add_many(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_add`` for many parts at once; a part with a character that no piece covers is left out (not covered)."""
        v = self.vocabulary
        texts = [p.replace(" ", _MARK) for p in parts]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        sizes = np.asarray([len(t) for t in texts], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(parts)), sizes)
        stop = (first + sizes)[owner]
        begin = now = np.arange(len(codes))
        tree = np.zeros(len(codes), dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(begin):
            key = (tree << 21) | codes[now]
            at = np.minimum(np.searchsorted(v.step_keys, key), len(v.step_keys) - 1)
            ok = v.step_keys[at] == key
            begin, now, tree = begin[ok], now[ok] + 1, v.step_nodes[at[ok]]
            piece = v.node_piece[tree] >= 0
            found.append((begin[piece], now[piece], tree[piece]))
            go = now < stop[begin]
            begin, now, tree = begin[go], now[go], tree[go]
        covered = np.ones(len(parts), dtype=bool)
        single = np.zeros(len(codes), dtype=bool)
        single[found[0][0]] = True
        covered[owner[~single]] = False
        start, end, tree = (np.concatenate(x) for x in zip(*found))
        fine = covered[owner[start]]
        start, end, tree = start[fine], end[fine], tree[fine]
        part = owner[start]
        base = self.nodes + np.cumsum(np.where(covered, sizes + 1, 0)) - np.where(covered, sizes + 1, 0)
        order = np.lexsort((start, end - first[part], part))
        start, end, tree, part = start[order], end[order], tree[order], part[order]
        into, out_of = base[part] + end - first[part], base[part] + start - first[part]
        piece, weight = v.node_piece[tree], v.node_log[tree]
        total = np.zeros(int(np.where(covered, sizes + 1, 0).sum()))
        low = self.nodes
        local = end - first[part]
        by_end = np.argsort(local, kind="stable")
        edges = np.searchsorted(local[by_end], np.arange(1, int(local.max(initial=0)) + 2))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            mine = by_end[a:b]
            if not len(mine):
                continue
            weight[mine] += total[out_of[mine] - low]
            node = into[mine]
            heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            top = np.maximum.reduceat(weight[mine], heads)
            spread = np.exp(weight[mine] - np.repeat(top, np.diff(np.append(heads, len(node)))))
            total[node[heads] - low] = top + np.log(np.add.reduceat(spread, heads))
        share = np.exp(weight - total[into - low])
        # Running shares inside each node, one piece after the other, so they are the same in any company.
        heads = np.flatnonzero(np.concatenate([[True], into[1:] != into[:-1]])) if len(into) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(into)) - np.repeat(heads, np.diff(np.append(heads, len(into))))
        before = np.zeros(len(into))
        for r in range(1, int(rank.max(initial=0)) + 1):
            mine = np.flatnonzero(rank == r)
            before[mine] = before[mine - 1] + share[mine - 1]
        self._append(into, np.minimum((before * 4294967296.0).astype(np.int64), 4294967295), piece, out_of, self.nodes + len(total))
        return (sizes << 40) | (base + sizes), covered

    def _append(self, node: np.ndarray, share: np.ndarray, piece: np.ndarray, source: np.ndarray, nodes: int) -> None:
        """Add the pieces of the nodes from the last one so far up to ``nodes``, in the order of their nodes."""
        need = self.arcs + len(node)
        if need > len(self.shares):
            size = max(need, 2 * len(self.shares))
            self.shares, self.pieces, self.sources = (np.concatenate([x[: self.arcs], np.zeros(size - self.arcs, dtype=x.dtype)]) for x in (self.shares, self.pieces, self.sources))
        if nodes + 1 > len(self.first):
            size = max(nodes + 1, 2 * len(self.first))
            self.first = np.concatenate([self.first[: self.nodes + 1], np.zeros(size - self.nodes - 1, dtype=np.int64)])
        at = slice(self.arcs, need)
        self.shares[at], self.pieces[at], self.sources[at] = share, piece, source
        self.first[self.nodes : nodes + 1] = self.arcs + np.searchsorted(node, np.arange(self.nodes, nodes + 1))
        self.arcs, self.nodes = need, nodes

    def _add(self, part: str, batch: list[tuple[int, int, int, int]]) -> tuple[int, int]:
        """The part's last node, with the distance from its first one above 40 bits; and the next free node."""
        v = self.vocabulary
        text = part.translate(_SWAP)
        size = len(text)
        incoming: list[list[tuple[float, int, int]]] = [[] for _ in range(size + 1)]  # (weight, start, piece)
        total = [0.0] * (size + 1)
        logs, ids, prefixes = v.logs, v.ids, v.prefixes
        for start in range(size):
            if start:
                own = incoming[start]
                if not own or own[-1][1] != start - 1:
                    own.append((total[start - 1] + v.rare, start - 1, -1))
                if len(own) == 1:
                    total[start] = own[0][0]
                else:
                    top = max(own)[0]
                    total[start] = top + log(sum([exp(w - top) for w, _, _ in own]))
            here = total[start]
            for end in range(start + 1, size + 1):
                piece = text[start:end]
                weight = logs.get(piece)
                if weight is not None:
                    incoming[end].append((here + weight, start, ids[piece]))
                elif piece not in prefixes:
                    break
        own = incoming[size]
        if not own or own[-1][1] != size - 1:
            own.append((total[size - 1] + v.rare, size - 1, -1))
        top = max(own)[0]
        total[size] = top + log(sum([exp(w - top) for w, _, _ in own]))
        # Nodes: places 0 .. size, and one for each byte inside a character that is spelled out.
        first = node = self.nodes
        number = [first]
        for end in range(1, size + 1):
            arcs = []
            for w, start, piece in incoming[end]:
                source = number[start]
                if piece < 0:
                    raw = part[start].encode("utf-8", "surrogatepass")
                    for value in raw[:-1]:
                        node += 1
                        batch.append((node, 0, v.byte_ids[value], source))
                        source = node
                    piece = v.byte_ids[raw[-1]]
                arcs.append((w, source, piece))
            node += 1
            number.append(node)
            share, whole = 0.0, total[end]
            for w, source, piece in arcs:
                batch.append((node, min(int(share * 4294967296.0), 4294967295), piece, source))
                share += exp(w - whole)
        return (node - first) << 40 | node, node + 1

    def sample(self, parts: list[str], numbers: np.ndarray, row_keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Drawn pieces of all parts in text order, and how many each part has."""
        last, first = self.ends(parts)
        with np.errstate(over="ignore"):
            base = mix(row_keys, seed) + numbers.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        now, who = last.copy(), np.arange(len(parts))
        count = np.zeros(len(parts), dtype=np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        step = 0
        while len(who):
            with np.errstate(over="ignore"):
                draw = (mix(base[who] + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), 11) >> np.uint64(32)).astype(np.int64)
            node = now[who]
            arc, last_arc = self.first[node], self.first[node + 1] - 1
            going = np.flatnonzero(arc < last_arc)
            while len(going):
                going = going[self.shares[arc[going] + 1] <= draw[going]]
                arc[going] += 1
                going = going[arc[going] < last_arc[going]]
            drawn.append((who, self.pieces[arc]))
            count[who] += 1
            now[who] = self.sources[arc]
            who = who[now[who] > first[who]]
            step += 1
        out = np.empty(int(count.sum()), dtype=np.int64)
        end = np.cumsum(count)
        for step, (who, piece) in enumerate(drawn):
            out[end[who] - 1 - step] = piece
        return out, count


@lru_cache(maxsize=2)
def lattices(path: str, sharpness: float) -> Lattices:
    """One cache for each model and worker process."""
    return Lattices(Vocabulary(path, sharpness))


def parts_of(text: str, vocabulary: Vocabulary) -> list[str]:
    """Parts of a text with an added first space; joined they are the space and the text."""
    return vocabulary.parts.findall(" " + text)


def encode_sampled(docs: DataFrame, model: str, seed: int = 1, sharpness: float = 1.0, keep: list[str] | None = None) -> DataFrame:
    """Sampled piece ids of every text: doc_id, the columns named in ``keep``, ids, n_pieces and ids_crc32.

    The row key is doc_id, so rows that share key and text get the same ids; a null key has draws of its own. Each
    segmentation is drawn in proportion to the product of its pieces' weights to the power ``sharpness``. A null text
    has null ids and 0 pieces, an empty one is the piece (or byte) of the added space. ids_crc32 runs over the ids as
    little-endian unsigned 32-bit integers. Other columns are ignored.
    """
    keep = [c for c in keep or [] if c != "doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        table = lattices(model, sharpness)
        for batch in slices(batches, "text", 1_000_000):
            table.begin()
            listed = [parts_of(t, table.vocabulary) if t is not None else [] for t in batch["text"]]
            sizes = np.asarray([len(x) for x in listed], dtype=np.int64)
            parts = [p for x in listed for p in x]
            starts = np.cumsum(sizes) - sizes
            numbers = np.arange(len(parts)) - np.repeat(starts, sizes)
            keys = np.asarray([-(1 << 62) if d is None else d for d in batch["doc_id"]], dtype=np.int64).view(np.uint64)
            ids, count = table.sample(parts, numbers, np.repeat(keys, sizes), seed) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            edge = np.concatenate([[0], np.cumsum(count)])
            bounds = [(int(edge[a]), int(edge[a + n])) for a, n in zip(starts.tolist(), sizes.tolist())]
            yield {c: batch[c] for c in ["doc_id", *keep]} | {
                "ids": [None if t is None else ids[a:b] for t, (a, b) in zip(batch["text"], bounds)],
                "n_pieces": [b - a for a, b in bounds], "ids_crc32": [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in bounds],
            }

    columns = docs.select(F.col("doc_id").cast("long"), *dict.fromkeys([*keep, "text"]))
    types = dict(columns.dtypes)
    schema = "doc_id long" + "".join(f", `{c}` {types[c]}" for c in keep) + ", ids array<int>, n_pieces long, ids_crc32 long"
    return arrow_map(columns, work, schema)


def decode_pieces(encoded: DataFrame, model: str, keep: list[str] | None = None) -> DataFrame:
    """Text of every row's ids; null ids give a null text. ``keep`` names the columns passed on (default: doc_id)."""
    keep = ["doc_id"] if keep is None else keep

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        spell = lattices(model, 1.0).vocabulary.bytes_of.__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = []
                for ids in part.column("ids"):
                    if not ids.is_valid:
                        texts.append(None)
                        continue
                    texts.append(b"".join(map(spell, ids.values.to_numpy().tolist()))[1:].decode("utf-8", "surrogatepass"))
                yield {c: part.column(c) for c in keep} | {"decoded": texts}

    columns = encoded.select(*keep, "ids")
    types = dict(columns.dtypes)
    return arrow_map(columns, work, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", decoded string")
