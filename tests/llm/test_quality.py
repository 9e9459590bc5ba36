"""Quality rules: counts against a plain count, trees against their definition, held-out accuracy."""

import re

import numpy as np
import pytest

from msgrisk.llm import quality
from msgrisk.llm.quality import FALLING, FEATURES, features, grow_trees, score_quality, statistics, train_quality

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, score string, n_words int"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    dup = sum(line in lines[:i] for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def texts():
    rng = np.random.default_rng(1)
    out = [None, "", " \n\t", "one", "a b c d e f g h", "\x85  x 日本語 é", "x y " * 40, "a\n\n a\na\nb\r\nb\r\n", "#*$%&|<> ##", "same words here " * 3]
    for _ in range(120):
        n = int(rng.integers(0, 60))
        words = [f"w{k}" for k in rng.integers(0, 3, size=n)]
        out.append("".join(w + (" ", "\n", "\t", " \x0b")[int(rng.integers(0, 4))] for w in words))
    return out


def test_counts_equal_brute_force(monkeypatch):
    rows = texts()
    for stretch in (1 << 20, 5):
        monkeypatch.setattr(quality, "STRETCH", stretch)
        found = statistics([(t or "").encode() for t in rows])
        own = list(zip(*(found[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
        assert own == [brute(t) for t in rows]
    for t in rows[:9]:  # alone, too: windows and numbers of neighbours have no say
        alone = statistics([(t or "").encode()])
        assert (alone["n_words"][0], alone["word_chars"][0]) == brute(t)[:2] and alone["n_repeat_words"][0] == brute(t)[4]


def test_trees_learn_and_keep_the_order():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] < 0.6) ^ (rng.random(3000) < 0.05)).astype(float)
    y[(x[:, 0] > 0.9) & (x[:, 1] > 0.5)] = 1.0  # against the constraint
    free = grow_trees(x, y, np.zeros(3, dtype=int))
    bound = grow_trees(x, y, np.array([-1, 0, 0]))
    assert ((free.scores(x) > 0.5) == y).mean() > 0.93 and ((bound.scores(x) > 0.5) == y).mean() > 0.85
    grid = np.linspace(0, 1, 200)
    for other in rng.random((20, 2)):
        line = np.column_stack([grid, np.full(200, other[0]), np.full(200, other[1])])
        assert (np.diff(bound.scores(line)) <= 1e-12).all()
    assert any((np.diff(free.scores(np.column_stack([grid, np.full(200, 0.8), np.full(200, 0.5)]))) > 0.01))

    def walk(row):
        total = bound.base
        for node in bound.roots:
            while bound.left[node] != node:
                node = bound.right[node] if row[bound.feature[node]] > bound.threshold[node] else bound.left[node]
            total += bound.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(bound.scores(x[:50]), [walk(r) for r in x[:50]])


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_quality(spark, tables):
    docs, labels = tables
    model = train_quality(docs, labels.where("doc_id % 3 <> 0"))
    scored = score_quality(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    good = scored[scored.quality == 1]
    assert (good.kept | good.base_failed).mean() >= 0.97
    bad = scored[scored.quality == 0]
    assert (~bad.kept).mean() >= 0.8
    assert ((scored.score >= 0.5) == (scored.quality == 1)).mean() >= 0.95
    x = features(statistics([b"words of a text " * 10 + b"and others"]))
    for name in FALLING:
        rows = np.repeat(x, 50, axis=0)
        rows[:, FEATURES.index(name)] = np.linspace(0, 1, 50)
        assert (np.diff(model.scores(rows)) <= 1e-12).all()


def test_rows_and_rules(spark, tables):
    rows = texts() + ["repeated row " * 20] * 2 + ["long words " * 50_000]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "s", 1) for i, t in enumerate(rows)], SCHEMA).repartition(4)
    model = train_quality(*tables)
    out = score_quality(docs, model).toPandas()
    assert len(out) == len(rows) and out.doc_id.isna().sum() == 1
    for r in out[out.doc_id.notna()].itertuples():
        words, chars, symbols, dup, repeat = brute(rows[int(r.doc_id)]) if r.doc_id < len(rows) - 1 else (100_000, 450_000, 0, 0, 100_000)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (words, chars, symbols, dup, repeat)
        assert r.base_failed == (words < 20 or 100 * repeat > 30 * words) and not (r.base_failed and r.kept) and 0 <= r.score <= 1
    plain = score_quality(docs, None).toPandas()
    assert plain.score.isna().all() and (plain.kept == ~plain.base_failed).all()
    assert score_quality(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        score_quality(docs, model, keep=["doc_id", "score"])
    assert train_quality(tables[0], tables[1].where("quality = 1")) is None and train_quality(tables[0], tables[1].limit(0)) is None
