"""Quality rules: exact base statistics of whole texts and gradient-boosted trees over them.

Statistics are counted on the bytes of many texts at once. The trees are grown on a bounded sample of labelled rows by
histograms of gradients; a feature may be constrained so that the score never rises (or never falls) with it. A grown
ensemble is a set of flat node arrays, and scoring moves all rows and trees one level down at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.llm.common import arrow_map, slices

SYMBOLS = b"#*$%&|<>"
#: Words of a window, fewest words of a kept text, and the percentage of repeated words that fails a text.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: A longer text is cut into words stretch by stretch.
STRETCH = 4 << 20

FEATURES = [
    "log_words", "word_chars", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "digit_share", "upper_share",
    "mark_share", "letter_share", "words_per_line", "top_word_share", "log_longest_word",
]
#: -1: the score never rises with the feature.
FALLING = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "top_word_share": -1}

_SPACES = b" \t\n\x0b\x0c\r"
_KINDS = {
    "space": np.isin(np.arange(256), list(_SPACES)),
    "symbol": np.isin(np.arange(256), list(SYMBOLS)),
    "start": (np.arange(256) & 0xC0) != 0x80,
    "digit": np.isin(np.arange(256), list(b"0123456789")),
    "upper": np.isin(np.arange(256), list(range(65, 91))),
    "mark": np.isin(np.arange(256), list(b"!\"'(),-./:;?@[\\]^_`{}~+=")),
    "letter": np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(192, 256)]),
}


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _stretches(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end before white space."""
    at = 0
    while len(text) - at > STRETCH:
        end = at + STRETCH
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for each different pair; exact, since numbers stay below 2**31."""
    return pd.factorize((left.astype(np.int64) << 31) | right)[0].astype(np.int64)


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Counts of every text, as arrays."""
    count = len(texts)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    begins = ends - np.asarray([len(t) for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def counted(flags: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return running[ends] - running[begins]

    kinds = {name: table[raw] for name, table in _KINDS.items()}
    out = {f"n_{name}": counted(flags) for name, flags in kinds.items() if name not in ("space", "start")}
    out["n_chars"] = counted(kinds["start"])
    solid = kinds["start"] & ~kinds["space"]
    out["word_chars"] = counted(solid)
    out["n_symbols"] = out.pop("n_symbol")
    numbers = _Numbers()
    parts, words, lines, dup, longest = [], np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64), np.zeros(count, np.int64)
    for i, text in enumerate(texts):
        for stretch in _stretches(text):
            listed = stretch.split()
            if listed:
                parts.append(np.fromiter(map(numbers.__getitem__, listed), dtype=np.int64, count=len(listed)))
                words[i] += len(listed)
                longest[i] = max(longest[i], max(map(len, listed)))
        full = [line for line in text.split(b"\n") if line.strip()]
        lines[i], dup[i] = len(full), len(full) - len(set(full))
    out |= {"n_words": words, "n_lines": lines, "n_dup_lines": dup, "longest": longest}
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(count), words)
    out["n_repeat_words"] = np.zeros(count, np.int64)
    out["n_distinct"] = np.zeros(count, np.int64)
    out["n_top"] = np.zeros(count, np.int64)
    if len(ids):
        code, first = pd.factorize((owner << 31) | ids)
        of_doc = (first >> 31).astype(np.int64)
        out["n_distinct"] = np.bincount(of_doc, minlength=count)
        np.maximum.at(out["n_top"], of_doc, np.bincount(code))
    grams, width = ids, 1
    while width < WINDOW and len(grams) > width:
        grams = _pairs(grams[:-width], grams[width:])
        width *= 2
    if width == WINDOW and len(grams):
        whole = np.flatnonzero(owner[: len(grams)] == owner[WINDOW - 1 :])
        code = _pairs(owner[whole], grams[whole])
        again = whole[np.bincount(code)[code] > 1] if len(code) else whole
        change = np.bincount(again, minlength=len(ids) + 1)[: len(ids) + 1] - np.bincount(again + WINDOW, minlength=len(ids) + 1)[: len(ids) + 1]
        out["n_repeat_words"] = np.bincount(owner[np.cumsum(change)[:-1] > 0], minlength=count)
    return out


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """One row of FEATURES for every text; shares of nothing are zero."""
    words, chars = np.maximum(stats["n_words"], 1), np.maximum(stats["n_chars"], 1)
    solid, lines = np.maximum(stats["word_chars"], 1), np.maximum(stats["n_lines"], 1)
    columns = [
        np.log1p(stats["n_words"]), stats["word_chars"] / words, stats["n_symbols"] / chars, stats["n_dup_lines"] / lines,
        stats["n_repeat_words"] / words, stats["n_distinct"] / words, stats["n_digit"] / solid, stats["n_upper"] / solid,
        stats["n_mark"] / solid, stats["n_letter"] / solid, stats["n_words"] / lines, stats["n_top"] / words, np.log1p(stats["longest"]),
    ]
    return np.column_stack(columns).astype(np.float64)


@dataclass
class Trees:
    """All nodes of an ensemble in flat arrays; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    cut: float = 0.5

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of a good text for every row."""
        out = np.empty(len(x))
        for a in range(0, len(x), 4096):
            rows = x[a : a + 4096]
            node = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
            at = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                node = np.where(rows[at, self.feature[node]] > self.threshold[node], self.right[node], self.left[node])
            out[a : a + 4096] = self.base + self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-out))


def grow_trees(
    x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64,
    smoothing: float = 1.0, least: float = 1.0,
) -> Trees:
    """Boosted trees of the logistic loss; ``monotone`` has -1, 0 or 1 for each feature.

    A split on a constrained feature must order its two values, and their mean bounds everything below it on either side,
    so no later split can undo the order.
    """
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        for array, item in ((feature, 0), (threshold, np.inf), (left, k), (right, k), (value, 0.0)):
            array.append(item)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        root = node()
        roots.append(root)
        place = np.full(len(y), root)
        level = {root: (-np.inf, np.inf)}
        for step in range(depth + 1):
            following: dict[int, tuple[float, float]] = {}
            number = np.full(len(feature), -1)
            number[list(level)] = np.arange(len(level))
            own = number[place]
            live = np.flatnonzero(own >= 0)
            tables = []
            for f in range(x.shape[1]):
                key = own[live] * (bins + 1) + binned[live, f]
                size = len(level) * (bins + 1)
                tables.append([np.bincount(key, weights=v[live], minlength=size).reshape(len(level), bins + 1).cumsum(axis=1) for v in (g, h)])
            for i, (k, (low, high)) in enumerate(level.items()):
                total_g, total_h = tables[0][0][i, -1], tables[0][1][i, -1]
                value[k] = rate * float(np.clip(-total_g / (total_h + smoothing), low, high))
                if step == depth:
                    continue
                best = (1e-9, None)
                for f, (sum_g, sum_h) in enumerate(tables):
                    n = len(edges[f])
                    if not n:
                        continue
                    gl, hl = sum_g[i, :n], sum_h[i, :n]
                    gr, hr = total_g - gl, total_h - hl
                    wl, wr = np.clip(-gl / (hl + smoothing), low, high), np.clip(-gr / (hr + smoothing), low, high)

                    def loss(w, a, b):
                        return -(a * w + 0.5 * (b + smoothing) * w * w)

                    stay = loss(np.clip(-total_g / (total_h + smoothing), low, high), total_g, total_h)
                    gain = loss(wl, gl, hl) + loss(wr, gr, hr) - stay
                    gain[(hl < least) | (hr < least) | (monotone[f] * (wr - wl) < 0)] = -np.inf
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], (f, j, wl[j], wr[j]))
                if best[1] is None:
                    continue
                f, j, wl, wr = best[1]
                a, b, middle = node(), node(), (wl + wr) / 2
                feature[k], threshold[k], left[k], right[k] = f, edges[f][j], a, b
                following[a] = (middle if monotone[f] < 0 else low, middle if monotone[f] > 0 else high)
                following[b] = (middle if monotone[f] > 0 else low, middle if monotone[f] < 0 else high)
                mine = np.flatnonzero(place == k)
                place[mine] = np.where(binned[mine, f] > j, b, a)
            if not following:
                break
            level = following
        margin += np.asarray(value)[place]
    return Trees(*(np.asarray(a) for a in (feature, threshold, left, right, value, roots)), depth=depth, base=base)


def _counted(docs: DataFrame, work, schema: str, keep: list[str]) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows in slices(batches, "__text"):
            stats = statistics([t or b"" for t in rows.pop("__text")])
            yield rows | work(stats)

    return arrow_map(docs.select(*keep, F.col("text").cast("binary").alias("__text")), task, schema)


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = 20_000, lost: float = 0.005) -> Trees | None:
    """Trees that tell good texts from bad ones by ``labels(doc_id, quality)``; None without rows of both kinds.

    At most about ``rows`` labelled rows are used, half of each quality, chosen by the hash of their doc_id: the one bound
    here, as a classifier may be fitted on a sample. A quarter of them only sets the verdict's cut: the largest that loses
    at most a share ``lost`` of its good texts. Labels other than 0 and 1, null keys and labels without a document are left
    out; repeated rows count as often as they come.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(sizes) < 2:
        return None
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))
    share = F.when(F.col("quality") == 1, F.lit(rows / 2 / sizes[1])).otherwise(F.lit(rows / 2 / sizes[0]))
    # At most about `rows` narrow rows: their number is the parameter, whatever the size of the tables.
    sample = known.where(place < share * (1 << 30)).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("cut")), F.lit(4)))
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    counted = _counted(chosen, lambda s: {"x": list(features(s))}, "doc_id long, quality int, part int, x array<double>", ["doc_id", "quality", "part"])
    found = counted.orderBy("doc_id", "quality", "x").toPandas()
    if found["quality"].nunique() < 2:
        return None
    x, y = np.stack(found["x"].to_numpy()), found["quality"].to_numpy(dtype=np.float64)
    held = (found["part"] == 0).to_numpy()
    monotone = np.asarray([FALLING.get(f, 0) for f in FEATURES])
    if len(np.unique(y[~held])) < 2 or not (held & (y == 1)).any():
        held = np.zeros(len(y), dtype=bool)
    trees = grow_trees(x[~held], y[~held], monotone)
    good = trees.scores(x[(held if held.any() else ~held) & (y == 1)])
    trees.cut = float(min(0.5, np.quantile(good, lost, method="lower")))
    return trees


def score_quality(docs: DataFrame, model: Trees | None, keep: list[str] | None = None) -> DataFrame:
    """Rows (keep..., n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept), one for each row.

    ``keep`` names the columns carried over (``doc_id`` by default); a name that equals a result column is an error. A null
    or empty text has zero counts and fails the base rules, as has every text of under 20 words. Without a model the base
    rules decide and the score is null. Texts are read whole; rows may repeat, keys may be null; an empty table gives no rows.
    """
    keep = ["doc_id"] if keep is None else keep
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    own = [*counts, "base_failed", "score", "kept"]
    if set(keep) & set(own):
        raise ValueError(f"columns would be doubled: {sorted(set(keep) & set(own))}")
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{c} long" for c in counts), "base_failed boolean, score double, kept boolean"])

    def work(stats: dict[str, np.ndarray]) -> dict:
        failed = (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > MOST_REPEATED * stats["n_words"])
        score = model.scores(features(stats)) if model else None
        kept = ~failed & (score >= model.cut) if model else ~failed
        return {c: stats[c] for c in counts} | {"base_failed": failed, "score": score if model else [None] * len(failed), "kept": kept}

    return _counted(docs, work, schema, keep)
