"""Operators over the whole corpus: n-gram Jaccard join, repeated passages, vector searches, pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from msgrisk.llm import suffixes
from msgrisk.llm.jaccard import compare_block, ngram_components, overlap_bound, classes
from msgrisk.llm.suffixes import merge_shards, remove_repeats, repeated, rotations, united, united_spans
from msgrisk.llm.vectors import exact_top_k, nearest_neighbours

FOLDER = "/root/testdata/sf0.001"


def word_sets(texts):
    out = []
    for text in texts:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        out.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return out


def corpus(seed, families=6, size=12, words=60):
    """Near copies of a few texts, common passages, exact copies, short and empty texts."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(draw.choices(vocabulary, k=25))
    texts = [None, "", " \t\n ", "one two", "One TWO", "one  two\n", "ONE two three four five", "é É"]
    for _ in range(families):
        base = draw.choices(vocabulary, k=words)
        for _ in range(size):
            own = list(base)
            for _ in range(draw.randint(0, 4)):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            texts.append(" ".join(own))
    texts += [texts[20]] * 5
    texts += [" ".join(draw.choices(vocabulary, k=draw.randint(5, 80))) + " " + passage for _ in range(40)]
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("short, hot", [(16, 0.005), (2, 0.0)])
def test_ngram_components(spark, monkeypatch, short, hot):
    import msgrisk.llm.jaccard as module

    if short == 2:  # long lists, hot tokens and several blocks of a cluster on small data
        monkeypatch.setattr(module, "max", lambda *a: 3 if a == (256, 0) else max(*a), raising=False)
        monkeypatch.setattr(module, "BLOCK_TOKENS", 2000)
    texts = corpus(short)
    ids = [None if i == 3 else i // 2 if i < 8 else i for i in range(len(texts))]
    rows = [(d, t, "x", 1) for d, t in zip(ids, texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, sid string, n int").repartition(5)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_components(table, short_list=short, hot_share=hot).collect()), key=str)
    sets = word_sets(texts)
    label = list(range(len(sets)))
    links = [0] * len(sets)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                links[i] += 1
                links[j] += 1
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    least = {}
    for d, l in zip(ids, label):
        if d is not None:
            least[l] = min(least.get(l, d), d)
    assert got == sorted(((d, len(s), least.get(l), k) for d, s, l, k in zip(ids, sets, label, links)), key=str)
    assert ngram_components(table.limit(0)).count() == 0


def test_list_over_several_batches(spark):
    """Twelve words in every text and two of its own: one index list holds thousands of entries."""
    texts = [" ".join([f"c{k}" for k in range(12)] + [f"a{i}", f"b{i}"]) for i in range(3000)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = ngram_components(table, percent=60).groupBy("component_id", "n_links").count().collect()
    # 8 of 10 runs are shared: 8 of 12 in all, over 60 % for any two texts.
    assert [(r[0], r[1], r[2]) for r in found] == [(0, 2999, 3000)]
    with pytest.raises(ValueError):
        ngram_components(table, percent=50)


def test_whole_sets_are_not_written(spark, monkeypatch):
    """No table or its columns hold all the tokens of the sets; rows stay exact, those of equal texts too."""
    import os

    import msgrisk.llm.jaccard as module
    from msgrisk.llm.common import filesystem

    sizes = []

    class Weighed(module.Scratch):
        def keep(self, df):
            table = super().keep(df)
            path = filesystem(self.folders[id(table)])[1]
            sizes.append(sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path)))
            return table

    monkeypatch.setattr(module, "Scratch", Weighed)
    draw = random.Random(9)
    texts = [" ".join(f"w{draw.randrange(1 << 40)}" for _ in range(2000)) for _ in range(60)]
    texts += [texts[0], texts[1], texts[2] + " more", "x " + texts[3]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_components(table).collect()}
    copies = {60: 0, 61: 1, 62: 2, 63: 3}
    assert got == {i: (1996 + (i in (62, 63)), copies.get(i, i), int(i in copies or i < 4)) for i in range(64)}
    assert max(sizes) < 8 * 1996 * 60 / 2


def test_runs_shared_by_chance_tie_nothing(spark, monkeypatch):
    """Large texts that share a run of words or two: no class counts are met for their pairs, no cluster is chained."""
    import msgrisk.llm.jaccard as module

    met, tied = [], []

    class Counted(module.Scratch):
        def keep(self, df):
            table = super().keep(df)
            met.extend([table.count()] if table.columns == ["sid", "c"] else [])
            return table

    monkeypatch.setattr(module, "Scratch", Counted)
    monkeypatch.setattr(module, "connected_groups", lambda edges, real=module.connected_groups: (tied.append(edges.count()), real(edges))[1])
    monkeypatch.setattr(module, "_frequent", lambda *a: (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))
    draw = random.Random(11)
    runs = []
    while len(runs) < 21:  # in the order of hashes they come first, so each prefix has those of its text
        run = " ".join(f"r{draw.randrange(1 << 40)}" for _ in range(5))
        runs += [run] if module.shingles(run, 5)[0] < 1 << 60 else []
    text = lambda k: " ".join(f"w{draw.randrange(1 << 40)}" for _ in range(k))
    # One run lies in all forty texts, a long list; each of the others in two of them.
    texts = [" ".join([text(400), runs[0], text(100), runs[1 + i // 2], text(100)]) for i in range(40)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {(r["doc_id"], r["component_id"], r["n_links"]) for r in ngram_components(table).collect()} == {(i, i, 0) for i in range(40)}
    assert met == [0] and tied[0] == 0
    # Near copies that share long lists only, or those and a run, are found all the same.
    base = text(300).split()
    near = [" ".join(base[: 10 * i] + ["x"] + base[10 * i :]) for i in range(20)]
    table = spark.createDataFrame(list(enumerate(near + texts)), "doc_id long, text string").repartition(4)
    found = {(r["doc_id"], r["component_id"], r["n_links"]) for r in ngram_components(table).collect()}
    assert found == {(i, 0, 19) if i < 20 else (i, i, 0) for i in range(60)}


def test_blocks_and_bounds():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, size=rng.integers(1, 40)).astype(np.uint64) << np.uint64(57)) for _ in range(30)]
    for left, right in ((sets, None), (sets[:10], sets[10:])):
        got = compare_block(left, right, 50)
        for i, a in enumerate(left):
            for j, b in enumerate(left if right is None else right):
                common = len(np.intersect1d(a, b))
                assert got[i, j] == (100 * common >= 50 * (len(a) + len(b) - common) and not (right is None and i == j))
                assert overlap_bound(classes(a), classes(b)) >= common


def remaining(rows, window):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - window + 1):
            s = data[i : i + window]
            first[s] = min(first.get(s, 1 << 62), 1 << 61 if doc is None else doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - window + 1):
            if first[data[i : i + window]] < (1 << 61 if doc is None else doc):
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_merged_transforms():
    draw = random.Random(5)
    for alphabet in (b"ab", b"abc\x00", bytes(range(256))):
        block = bytes(draw.choices(alphabet, k=90))
        strings = [bytes(draw.choices(alphabet, k=draw.randint(50, 80))) + block[draw.randint(0, 30) :] for _ in range(9)] + [b"a" * 70]
        for window in (50, 33):
            string, place, group = merge_shards([strings[:4], strings[4:5], strings[5:]], window)
            assert len(string) == sum(len(s) + 1 for s in strings)
            rows = [(strings[s][p : p + window], g) for s, p, g in zip(string, place, group) if p + window <= len(strings[s])]
            assert len({s for s, _ in rows}) == len({g for _, g in rows}) == len(set(rows))
        keys = np.asarray([draw.randint(1, 6) for _ in strings])
        got = set(zip(*(x.tolist() for x in repeated(strings, keys, 50, shard_bytes=200))))
        wanted = {
            (i, p) for i, s in enumerate(strings) for p in range(len(s) - 49)
            if any(keys[j] < keys[i] and s[p : p + 50] in t for j, t in enumerate(strings))
        }
        assert got == wanted


def test_grams_leave_no_shuffle_behind(spark, monkeypatch):
    """The shuffle of all grams is gone before the texts meet their shared segments."""
    import os

    root = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()
    held = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(root) for f in names if f.startswith("shuffle_") and f.endswith(".data"))
    sizes = []
    release, intervals = suffixes.release, suffixes._intervals
    monkeypatch.setattr(suffixes, "release", lambda *a, **k: [sizes.append(held()), release(*a, **k)])
    monkeypatch.setattr(suffixes, "_intervals", lambda *a: [sizes.append(held()), intervals(*a)][1])
    draw = random.Random(10)
    rows = [(i, "".join(draw.choices("abcdefghijklmnop", k=20_000))) for i in range(40)]
    assert remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).count() == 40
    assert sizes[1] < sizes[0] - 40 * 20_000 / 4


def test_rotations_and_spans():
    draw = random.Random(7)
    strings = [[draw.randint(1, 3) for _ in range(draw.randint(0, 40))] + [0] for _ in range(20)] + [[1] * 30 + [0]] * 2
    lengths = np.asarray([len(s) for s in strings])
    order, previous = rotations(np.concatenate(strings), lengths, 50)
    turned = [((s[i:] + s[:i]) * 51)[:50] for s in strings for i in range(len(s))]
    assert sorted(order.tolist()) == list(range(len(turned)))
    assert [turned[i] for i in order] == sorted(turned)
    assert all(turned[p][1:] == t[:-1] for t, p in zip(turned, previous))
    for k in (0, 1, 2, 30):
        spans = [(a, a + draw.randint(1, 60)) for a in (draw.randint(0, 500) for _ in range(k))]
        assert united_spans([a << 32 | b for a, b in spans]) == united(spans)


@pytest.mark.parametrize("hot", [None, 2])
def test_remove_repeats(spark, hot):
    draw = random.Random(6)
    text = lambda k: "".join(draw.choices("abcdé \n", k=k))
    passages = [text(k) for k in (49, 50, 51, 120, 400)]
    rows = [(i, text(draw.randint(0, 90)) + draw.choice(passages) + text(draw.randint(0, 60)) + draw.choice(passages)) for i in range(60)]
    copy = text(300)
    rows += [(70, copy), (71, copy), (71, copy), (71, copy + "x"), (None, copy), (None, copy), (72, None), (73, ""), (74, "short"), (75, "a" * 300), (76, "a" * 120), (77, text(5000) * 30), (78, rows[5][1])]
    table = spark.createDataFrame([(d, t, "r", 1) for d, t in rows], "doc_id long, text string, rid string, n_bytes int").repartition(5)
    got = remove_repeats(table, hot=hot, keep=["rid"] if hot is None else None).collect() if hot else remove_repeats(table).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == remaining(rows, 50)
    assert remove_repeats(table.limit(0)).count() == 0


def test_remove_repeats_across_flushes(spark, monkeypatch):
    """Long documents torn by a flush, before documents with smaller numbers that hold their passages."""
    arrow_map = suffixes.arrow_map

    def small(df, work, schema):
        def torn(batches):
            whole, suffixes.STRETCH = suffixes.STRETCH, 2000
            try:
                yield from work(batches)
            finally:
                suffixes.STRETCH = whole

        return arrow_map(df, torn, schema)

    monkeypatch.setattr(suffixes, "arrow_map", small)
    monkeypatch.setattr(suffixes, "FLUSH", 100)
    draw = random.Random(8)
    text = lambda k: "".join(draw.choices("abcdefghijklmnop", k=k))
    rows = []
    for i in range(15):
        passage = text(300)
        rows += [(100 - i, passage + text(draw.randint(1500, 3500)) + passage + text(draw.randint(0, 60))), (50 - i, text(20) + passage + text(draw.randint(0, 60)))]
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = remove_repeats(table).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == remaining(rows, 50)


BAD = [None, [], [None, 1.0, 2.0, 3.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0]]


def vectors(spark, n=230):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)], "x", 1) for i in range(n)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5], "x", 1) for i in range(45)]  # equal vectors
    rows += [(2000 + i, v, "x", 1) for i, v in enumerate(BAD)] + [(None, [1.0, 1.0, 1.0, 1.0], "x", 1), (20, rows[20][1], "x", 1), (3000, [1.0, 2.0], "x", 1), (3020, [0.0, 0.0], "x", 1), (4000, [0.0] * 4, "x", 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int").repartition(4)


def sound(rows, zero):
    return {i: np.asarray(v, dtype=float) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))}


def test_exact_top_k(spark):
    rows, table = vectors(spark)
    got = {}
    for r in exact_top_k(table, table.where("vec_id % 20 = 0"), k=7, rows=40, asked=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    own = {i: np.floor(64 * v).astype(int) for i, v in sound(rows, True).items()}
    for q in [i for i in own if i % 20 == 0]:
        scores = sorted((-int(own[q] @ v), i) for i, v in own.items() if i != q and len(v) == len(own[q]))[:7]
        assert sorted(got.get(q, [])) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert set(got) <= set(own) and exact_top_k(table.limit(0), table, k=3).count() == 0
    big = spark.createDataFrame([(0, [1e12, 3.0]), (1, [1e12, -5.5]), (2, [-1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r["vec_id"]) for r in sorted(exact_top_k(big, big.where("vec_id = 0"), k=5).collect())] == [(1, 1), (2, 2)]


def test_nearest_neighbours(spark):
    rows, table = vectors(spark)
    found = nearest_neighbours(table, table.where("vec_id % 20 = 0"), k=7, unit_rows=50).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    own = sound(rows, False)
    hits = total = 0
    for q in [i for i in own if i % 20 == 0 and len(own[i]) == 4]:
        exact = {i: float(own[q] @ v) for i, v in own.items() if i != q and len(v) == 4}
        listed = got[q]
        assert len(listed) == 7 and all(abs(exact[i] - s) < 1e-12 for i, s in listed)
        assert listed == sorted(listed, key=lambda x: (-x[1], x[0]))
        best = sorted(exact, key=lambda i: (-exact[i], i))[:7]
        hits, total = hits + len(set(best) & {i for i, _ in listed}), total + 7
    assert hits / total >= 0.9 and set(got) <= set(own) and q not in [i for i, _ in got[q]]
    few = table.where("vec_id IN (0, 20, 1, 2)")
    assert nearest_neighbours(few, few.where("vec_id % 20 = 0"), k=7).count() == 6  # all others, if fewer
    assert nearest_neighbours(table.limit(0), table, k=3).count() == 0


def test_recall_on_given_table(spark):
    from msgrisk.llm.queries import QUERIES

    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet").toPandas()
    x = np.stack(table["embedding"]).astype(float)
    ids = table["vec_id"].to_numpy()
    got = QUERIES["op2_nearest_neighbours"](spark, FOLDER).toPandas()
    recall = []
    for q in ids[ids % 20 == 0]:
        scores = x @ x[ids == q][0]
        scores[ids == q] = -9
        best = ids[np.lexsort((ids, -scores))[:20]]
        recall.append(len(set(best) & set(got.loc[got["query_id"] == q, "vec_id"])) / 20)
    assert np.mean(recall) >= 0.9


def test_pipeline(spark):
    draw = random.Random(8)
    base = corpus(8, families=3, size=5)
    rows = [(i, t, "en" if t and i % 3 else None, "s", 1) for i, t in enumerate(base)] + [(500, "123 456", "en", "s", 1), (None, "text without a key " * 3, "en", "s", 1)] + [(7, base[7], None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_copies", "repeated_passages", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    named = stages["language_id"](spark, docs, FOLDER).cache()
    assert named.columns == docs.columns and named.where("doc_id = 500 OR text IS NULL").count() == 0
    assert named.count() == sum(1 for _, t, *_ in rows if t and re.search("[^\\W\\d_]", t))
    single = stages["near_copies"](spark, named, FOLDER).cache()
    groups = ngram_components(named).select("component_id").distinct().count()
    assert single.columns == docs.columns and single.count() == groups
    cut = stages["repeated_passages"](spark, single, FOLDER).cache()
    assert cut.columns == docs.columns
    seen = {}
    for r in cut.collect():
        for i in range(len(r["text"]) - 49):
            assert seen.setdefault(r["text"][i : i + 50], r["doc_id"]) == r["doc_id"]
    packed = stages["packing"](spark, cut, FOLDER)
    assert packed.select("doc_id").distinct().count() == cut.count()
    assert stages["packing"](spark, docs.limit(0), FOLDER).count() == 0
    assert draw and corpus_pipeline.ORACLE_SQL is None
