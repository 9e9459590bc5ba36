"""Language of every word span: script ranges narrow the candidates, Viterbi labels the words of a text.

Learning counts character n-grams (two and three letters, with word edges) for each language over a bounded, hash-chosen
sample of labelled rows. A word's score in a language is the sum of the smoothed log-probabilities of its n-grams,
the two orders weighed equally; languages that were not seen in the word's script are no candidates. Viterbi over the words pays a
penalty for every change of language, so short foreign-looking words stay in their span and longer passages in
another language become spans of their own. The language of a document is the one with most letters.

Long texts are decoded in chunks at the same time: each chunk is solved for every state before it (max-plus
matrices), the chunks are chained, and all are traced back together. This equals one pass over the whole text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.llm.common import arrow_map, slices

# First code points of Unicode ranges and the script of each, up to the next entry.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"),
    (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = [a for a, _ in SCRIPTS]
_WORDS = re.compile(r"[^\W\d_]+")
#: Words of a text that one chunk of the decoder holds.
CHUNK = 256


def script_of(word: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


#: Orders of the n-grams.
ORDERS = (2, 3)


def grams(word: str) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for n in ORDERS for i in range(len(padded) - n + 1)]


def letters_in(word: str) -> int:
    return len(word) if word.isalpha() else sum(c.isalpha() for c in word)


class LanguageModel:
    """Scores of words in each language; a row of ``table`` holds an n-gram's log-probabilities, the last rows those
    of unseen n-grams of each order."""

    def __init__(self, languages: list[str], number: dict[str, int], table: np.ndarray, scripts: dict[str, list[int]]):
        self.languages, self.number, self.table, self.scripts = languages, number, table, scripts
        self.allowed = {s: np.isin(np.arange(len(languages)), allowed) for s, allowed in scripts.items() if allowed}

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its scores, 0 for the best language, and its letters; a word without letters or of a script
        that was not learned tells nothing (all 0)."""
        letters = np.asarray([letters_in(w) for w in words], dtype=np.int64)
        size = len(self.languages)
        if not words or not size:
            return np.zeros((len(words), size), dtype=np.float32), letters
        get, unseen = self.number.get, len(self.number) - min(ORDERS)
        rows: list[int] = []
        counts = []
        for word in words:
            own = [get(g, unseen + len(g)) for g in grams(word)]
            rows += own
            counts.append(len(own))
        starts = np.cumsum(counts) - counts
        total = np.add.reduceat(self.table[np.asarray(rows)], starts, axis=0) / np.float32(len(ORDERS))
        nobody = np.zeros(size, dtype=bool)
        open_to = np.asarray([self.allowed.get(script_of(w), nobody) for w in words])
        total[~open_to] = -np.inf
        some = open_to.any(1) & (letters > 0)
        total[~some] = 0
        return np.maximum(total - total.max(1, keepdims=True), np.float32(-30)), letters


def held_out(doc_id: str = "doc_id"):
    """Rows that learning never sees: crc32 of the key's text leaves 2 when divided by 4 (a null key: false)."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn_languages(docs: DataFrame, rows_per_language: int = 500, grams_per_language: int = 60_000) -> LanguageModel:
    """Fit on at most about ``rows_per_language`` labelled rows of each language, chosen by a hash of the key.

    The model keeps the ``grams_per_language`` commonest n-grams of a language, so its size is bounded. Only text and
    lang of rows that are not held out are used; rows with a null lang, text or key tell nothing.
    """
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
    )
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = counts.select("lang", (F.lit(float(rows_per_language)) / F.col("n")).alias("_share"))
    place = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.join(F.broadcast(share), "lang").where(place < F.col("_share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for part in slices(batches, "text"):
            found: Counter = Counter()
            words: dict[str, Counter] = {}
            for lang, text in zip(part["lang"], part["text"]):
                words.setdefault(lang, Counter()).update(_WORDS.findall(text.lower()))
            for lang, own in words.items():
                for word, n in own.items():
                    if letters_in(word):
                        found[lang, "", script_of(word)] += n
                        for g in grams(word):
                            found[lang, g, ""] += n
            if found:
                keys, values = zip(*found.items())
                yield {"lang": [k[0] for k in keys], "gram": [k[1] for k in keys], "script": [k[2] for k in keys], "n": list(values)}

    counted = arrow_map(chosen, count, "lang string, gram string, script string, n long").groupBy("lang", "gram", "script").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    ranked = counted.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram", "script")))
    found = ranked.where((F.col("_r") <= grams_per_language) | (F.col("gram") == "")).select("lang", "gram", "script", "n").toPandas()

    languages = sorted(found["lang"].unique().tolist())
    column = {x: i for i, x in enumerate(languages)}
    size = len(languages)
    number: dict[str, int] = {}
    for gram in found["gram"]:
        if gram:
            number.setdefault(gram, len(number))
    counts_of = np.zeros((len(number) + len(ORDERS), size))
    seen: dict[str, np.ndarray] = {}
    for lang, gram, script, n in found.itertuples(index=False):
        if gram:
            counts_of[number[gram], column[lang]] += n
        else:
            seen.setdefault(script, np.zeros(size))[column[lang]] += n
    order = np.asarray([len(g) for g in number] + list(ORDERS), dtype=np.int64)
    smooth = 0.5
    table = np.zeros_like(counts_of)
    for k in ORDERS:
        own = order == k
        table[own] = np.log((counts_of[own] + smooth) / (counts_of[own].sum(0) + smooth * own.sum()))
    letters = sum(seen.values()) if seen else np.zeros(size)
    scripts = {s: np.flatnonzero(row >= 0.01 * letters).tolist() for s, row in seen.items()}
    return LanguageModel(languages, number, table.astype(np.float32), scripts)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best language number of every word of texts that lie one behind the other (words of each: ``lengths``)."""
    states = scores.shape[1]
    chunks = -(-lengths // CHUNK)
    total = int(chunks.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    first = np.cumsum(chunks) - chunks  # of each text
    owner = np.repeat(np.arange(len(lengths)), chunks)
    inside = np.arange(total) - first[owner]
    begin = (np.cumsum(lengths) - lengths)[owner] + inside * CHUNK
    filled = np.minimum(lengths[owner] - inside * CHUNK, CHUNK)
    steps = int(filled.max())
    at = begin[:, None] + np.arange(steps)[None, :]
    ok = np.arange(steps)[None, :] < filled[:, None]
    padded = np.where(ok[:, :, None], scores[np.where(ok, at, 0)], np.float32(0))
    value = np.where(np.eye(states, dtype=bool), np.float32(0), np.float32(-1e9))[None].repeat(total, 0)
    source = np.empty((steps, total, states), dtype=np.int16)
    turned = np.empty((steps, total, states, states), dtype=bool)
    for t in range(steps):
        source[t] = value.argmax(2)
        jump = value.max(2, keepdims=True) - np.float32(penalty)
        np.less(value, jump, out=turned[t])
        value = np.maximum(value, jump) + padded[:, t, None, :]
    # Chain the chunks of each text, then trace back from its best last state.
    before = np.zeros((len(lengths), states), dtype=np.float64)
    choice = np.zeros((total, states), dtype=np.int64)
    for c in range(int(chunks.max())):
        live = np.flatnonzero(chunks > c)
        k = first[live] + c
        through = before[live][:, :, None] + value[k]
        choice[k] = through.argmax(1)
        before[live] = through.max(1)
    last = np.zeros(total, dtype=np.int64)
    enter = np.zeros(total, dtype=np.int64)
    state = before.argmax(1)
    for c in range(int(chunks.max()) - 1, -1, -1):
        live = np.flatnonzero(chunks > c)
        k = first[live] + c
        last[k] = state[live]
        enter[k] = choice[k, state[live]]
        state[live] = enter[k]
    path = np.empty((total, steps), dtype=np.int16)
    rows, now = np.arange(total), last.copy()
    for t in range(steps - 1, -1, -1):
        path[:, t] = now
        now = np.where(turned[t][rows, enter, now], source[t][rows, enter], now)
    return path[ok].astype(np.int64)


def identify_languages(docs: DataFrame, model: LanguageModel, penalty: float = 6.0, keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """Language of every text: ``lang_pred`` and ``score``, the share of its letters that lie in spans of it.

    ``und`` with score 0 stands for a null text, one without a letter, or an empty model. ``keep`` names the columns
    of ``docs`` that are passed on (default: doc_id); with ``spans`` the labelled word spans follow, as (first word,
    words, language). Equal shares go to the language that sorts first; repeated rows are judged once each.
    """
    spark = docs.sparkSession
    keep = ["doc_id"] if keep is None else keep
    shared = spark.sparkContext.broadcast(model)
    size = max(1, len(model.languages))
    chars = max(5_000, 2_000_000 * 16 // max(16, size * size))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found = shared.value
        names = np.asarray([*found.languages, "und"], dtype=object)
        known: dict[str, int] = {}
        scores, letters = found.score([])
        for part in slices(batches, "text", chars):
            words = [_WORDS.findall(t.lower()) if t else [] for t in part["text"]]
            if len(known) > 300_000:  # a cache only: what a word scores never depends on it
                known.clear()
                scores, letters = found.score([])
            new = list(set().union(*words) - known.keys())
            more_scores, more_letters = found.score(new)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            scores, letters = np.concatenate([scores, more_scores]), np.concatenate([letters, more_letters])
            lengths = np.asarray([len(w) for w in words], dtype=np.int64)
            n = int(lengths.sum())
            ids = np.fromiter(chain.from_iterable(map(known.__getitem__, w) for w in words), dtype=np.int64, count=n)
            docs_of = np.repeat(np.arange(len(words)), lengths)
            weight = np.zeros((len(words), size))
            path = np.zeros(n, dtype=np.int64)
            if n and found.languages:
                path = viterbi(scores[ids], lengths, penalty)
                weight = np.bincount(docs_of * size + path, weights=letters[ids], minlength=len(words) * size).reshape(-1, size)
            total = weight.sum(1)
            best = np.where(total > 0, weight.argmax(1), len(names) - 1)
            score = np.where(total > 0, weight.max(1) / np.maximum(total, 1), 0.0)
            out = {c: part[c] for c in keep} | {"lang_pred": names[best].tolist(), "score": score}
            if spans:
                out["spans"] = []
                ends = np.cumsum(lengths)
                for a, b in zip(ends - lengths, ends):
                    cut = [0, *(np.flatnonzero(np.diff(path[a:b])) + 1).tolist(), int(b - a)] if b > a and found.languages else []
                    out["spans"].append([{"first": x, "words": y - x, "lang": names[path[a + x]]} for x, y in zip(cut[:-1], cut[1:])])
            yield out

    kept = docs.select(*dict.fromkeys([*keep, "text"]))
    types = dict(kept.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["lang_pred string", "score double"])
    if spans:
        schema += ", spans array<struct<first: long, words: long, lang: string>>"
    return arrow_map(kept, work, schema)
