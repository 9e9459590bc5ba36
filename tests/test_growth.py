"""Steps that must not run once more for each use, and whose share of one task must stay bounded."""

import re
from email import headerregistry

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from msgrisk.catalog import corpus as corpus_queries
from msgrisk.functions import hosts, mime
from msgrisk.operators import corpus, links, mail, pages, posture, rules, terms
from msgrisk.plans import training
from msgrisk.session import materialize

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def wide_batches(spark):
    spark.conf.set(BATCH, "10000")
    yield spark
    spark.conf.unset(BATCH)


# --- terms ---------------------------------------------------------------------------


def words(column="text"):
    return F.split(column, " ")


def counted(rows):
    return sorted((tuple(r) for r in rows.collect()), key=str)


@pytest.mark.parametrize("keys", [[1, 2, 3], [1, 1, 2], [None, None, 1]])
def test_counts_of_repeated_and_null_keys(spark, keys):
    docs = spark.createDataFrame(list(zip(keys, ["a b a", "b a", "c"])), "id long, text string")
    plain = docs.select("id", F.explode(words()).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    assert counted(terms.term_counts(docs, "id", words())) == counted(plain)


def test_terms_are_counted_where_their_text_lies(spark):
    docs = spark.createDataFrame([(i, f"w{i} a b") for i in range(20)], "id long, text string")
    found = plan(terms.term_counts(docs, "id", words()))
    # The only exchange is that of the texts, below the generator.
    assert found.count("Exchange") == 1 and found.index("Generate") < found.index("Exchange")


def test_common_and_rare_terms_have_the_same_weights(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i % 2} d{i}") for i in range(12)], "id long, text string")
    counts = terms.term_counts(docs, "id", words())
    vocab = terms.vocabulary(counts, 12, 2, 1.0)
    want = counted(terms.tfidf(counts, vocab, "id").select("id", "term", F.round("weight", 9)))
    monkeypatch.setattr(terms, "COMMON_TERMS", 2)
    monkeypatch.setattr(terms, "small_or_none", lambda df: None)
    assert counted(terms.tfidf(counts, vocab, "id").select("id", "term", F.round("weight", 9))) == want and len(want) == 36


def test_unknown_terms_and_known_weights_are_not_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(i if i % 7 else None, f"a b{i % 3} c{i % 2} " + " ".join(f"u{i}x{j}" for j in range(50))) for i in range(28)], "id long, text string")
    counts = terms.term_counts(docs, "id", words())
    vocab = terms.vocabulary(counts, 25, 2, 1.0)
    want = counted(terms.tfidf(counts, vocab, "id").select("id", "term", F.round("weight", 9)))
    monkeypatch.setattr(terms, "COMMON_TERMS", 2)
    monkeypatch.setattr(terms, "small_or_none", lambda df: None)
    assert counted(terms._likely(counts, vocab).select("term").distinct()) == [(t,) for t in ("a", "b0", "b1", "b2", "c0", "c1")]
    out = terms.tfidf(counts, vocab, "id")
    assert counted(out.select("id", "term", F.round("weight", 9))) == want and {r[0] for r in want} > {None, 1}
    assert "collect_list" not in plan(out)  # rows of weights stay; only sums of squares went by document
    monkeypatch.setattr(terms, "NORM_ROWS", 0)
    assert counted(terms.tfidf(counts, vocab, "id").select("id", "term", F.round("weight", 9))) == want


@pytest.mark.parametrize("first", [2, 5])
def test_contributors_are_chosen_before_the_shuffle(spark, monkeypatch, first):
    rows = [(k, t, c) for k in (None, 1, 2) for t, c in (("verify account", 0.9), ("verify", 0.8), ("account", 0.7), ("count", 0.6), ("urgent", 0.5), ("a", 0.5), ("zz", 0.4))]
    rows += [(3, "one", 0.2), (3, "two", 0.2)]
    scored = spark.createDataFrame(rows, "id int, term string, contribution double").repartition(3)
    want = {k: ["verify account", "urgent", "zz"] for k in (None, 1, 2)} | {3: ["one", "two"]}
    monkeypatch.setattr(terms, "FIRST_TERMS", first, raising=False)
    read = []
    monkeypatch.setattr(terms, "materialize", lambda df, write=terms.materialize: (read.append(plan(df)), write(df))[1])
    assert {r.id: [t.term for t in r.top] for r in terms.top_contributors(scored, "id", 3).collect()} == want
    assert len(read) == 1 and "WindowGroupLimit" in read[0]


def test_profiles_are_spelled_out_once_for_all_folds(spark, monkeypatch):
    texts = ["urgent verify account", "project plan notes", "verify urgent prize", "notes for plan"]
    docs = spark.createDataFrame([(i, f"g{i % 12}", i % 2, f"{texts[i % 4]} {i % 5}") for i in range(48)], "id long, grp string, label int, text string")
    written = []
    monkeypatch.setattr(training, "materialize", lambda df, schema=None, write=training.materialize: (written.append(df.columns), write(df, schema))[1])
    score = lambda: {r.id: round(r.score, 9) for r in training.out_of_fold_scores(docs, "id", "grp", min_df={"word": 2, "char": 3}).collect()}
    once = score()
    assert [c for c in written if any(n.startswith("features") for n in c)] == [["id", "grp", "label", "fold", "nnz0", "features0", "nnz1", "features1", "nnz2", "features2"]]
    monkeypatch.setattr(training, "BROADCAST_TERMS", 0)
    assert len(once) == 48 and score() == pytest.approx(once, abs=1e-6)


# --- families ------------------------------------------------------------------------


def test_ordinals_read_each_text_once(spark, tmp_path):
    rows = [(1, "same text"), (2, "same text"), (3, "other")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_queries.duplicate_ordinal(spark, str(tmp_path))
    assert "sha2" not in optimized(out)
    assert sorted((r.row_ord, r.ordinal, r.first_ord) for r in out.collect()) == [(1, 1, 1), (2, 2, 1), (3, 1, 3)]


def test_campaign_groups_read_each_text_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(corpus, "connected_groups", lambda edges, real=corpus.connected_groups: (seen.append(optimized(edges)), real(edges))[1])
    rows = [(1, "same", "a", 1), (2, "same", "b", 1), (3, "other", "c", 0)]
    out = corpus.merge_campaign_groups(spark.createDataFrame(rows, "row_ord long, text string, group_id string, label int"))
    assert sorted(map(tuple, out.collect())) == [("a", "a"), ("b", "a"), ("c", "c")]
    assert "sha2" not in seen[0]


# --- links ---------------------------------------------------------------------------


def test_suffixes_take_their_host_once(spark):
    df = spark.createDataFrame([("A.b.Example.com.",), ("",), (None,)], "host string")
    out = df.select(hosts.label_suffixes(F.regexp_replace("host", "zz", "")).alias("s"))
    assert len(re.findall(r"regexp_replace\([^(]*, zz", optimized(out))) == 1
    assert [r.s for r in out.collect()][0] == ["a.b.example.com", "b.example.com", "example.com", "com"]


def test_destinations_are_parsed_once(spark):
    rows = [(1, 0, "www.paypal.com", "hxxp://paypa1-7.example.com/login"), (2, 0, "", "javascript:x")]
    out = links.link_findings(spark.createDataFrame(rows, "id long, link_ord int, visible string, destination string"), ["id"], ["gmail.com"])
    assert "try_url_decode" not in optimized(out)
    assert sorted((r.id, r.finding) for r in out.collect()) == [
        (1, "brand-lookalike"), (1, "display-mismatch"), (1, "obfuscated-scheme"), (2, "unsafe-scheme")]


# --- batches and pieces --------------------------------------------------------------


def test_pages_come_in_small_batches(wide_batches):
    pages.page_facts(wide_batches.createDataFrame([(1, "<p>a")], "id int, html string"), ["id"])
    assert int(wide_batches.conf.get(BATCH)) <= 256


def test_smaller_batches_stay(wide_batches):
    wide_batches.conf.set(BATCH, "7")
    pages.page_facts(wide_batches.createDataFrame([(1, "<p>a")], "id int, html string"), ["id"])
    assert wide_batches.conf.get(BATCH) == "7"


def test_messages_come_in_small_batches(wide_batches):
    raw = wide_batches.createDataFrame([("one", bytearray(b"Subject: s\r\n\r\nbody"))], "path string, content binary")
    assert mail.ingest_eml(raw)["messages"].count() == 1
    assert int(wide_batches.conf.get(BATCH)) <= 256


def test_snapshots_are_sorted_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(posture, "SNAPSHOT_ROWS", 2)
    rows = [(f"d{i % 20}", "MX", [str(i)], "ok", i) for i in range(40)]
    records = spark.createDataFrame(rows, "domain string, kind string, values array<string>, status string, observed_at long").coalesce(1)
    out = posture.latest_snapshot(records)
    assert out.rdd.getNumPartitions() == 21
    assert sorted((r.domain, r["values"][0]) for r in out.collect()) == sorted((f"d{i % 20}", str(i)) for i in range(20, 40))


# --- rows of one file, dealt out -----------------------------------------------------


def test_messages_are_decoded_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(mail, "PIECE_MESSAGES", 2, raising=False)
    write, tasks = mail.materialize, []
    monkeypatch.setattr(mail, "materialize", lambda df: tasks.append(df.rdd.getNumPartitions()) or write(df))
    raw = [(None if i % 4 else "same", bytearray(f"Subject: {i % 5}\r\n\r\nbody".encode())) for i in range(40)]
    messages = mail.ingest_eml(spark.createDataFrame(raw, "path string, content binary").coalesce(1))["messages"]
    assert tasks == [21]
    assert sorted(r.subject for r in messages.collect()) == sorted(str(i % 5) for i in range(40))


def test_header_values_are_parsed_once(monkeypatch):
    made = []
    find = headerregistry.HeaderRegistry.__getitem__
    monkeypatch.setattr(headerregistry.HeaderRegistry, "__getitem__", lambda self, name: made.append(name.lower()) or find(self, name))
    raw = b'Subject: s\r\nContent-Type: text/plain; charset=utf-8; x="once"\r\nContent-Transfer-Encoding: 8bit\r\n\r\nbody\r\n'
    row, = mime.read_message(raw)
    assert row["parts"][0]["content"] == "body\r\n" and row["headers"][0]["value"] == "s"
    assert made.count("content-type") == 1 and made.count("content-transfer-encoding") == 1


def test_features_are_dealt_out_for_training(spark, monkeypatch):
    monkeypatch.setattr(training, "PIECE_ROWS", 100, raising=False)
    fit, tasks = training.DecisionTreeClassifier.fit, []
    monkeypatch.setattr(training.DecisionTreeClassifier, "fit", lambda self, rows: tasks.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    rows = spark.range(450).selectExpr("double(id % 7) AS a", "double(id % 3) AS b", "int(id % 7 > 3) AS result").coalesce(1)
    fitted = training.train_tabular(rows, ["a", "b"], "result", names=("decision_tree",))
    assert tasks == [5]
    assert [tuple(r) for r in training.feature_importances(fitted["decision_tree"], ["a", "b"]).collect()] == [("a", 1.0), ("b", 0.0)]


def test_large_tables_grow_their_forest_on_counted_cells(spark, monkeypatch):
    fit, read = training.RandomForestClassifier.fit, []
    monkeypatch.setattr(training.RandomForestClassifier, "fit", lambda self, rows: read.append(rows.count()) or fit(self, rows))
    noisy = "int((id * 37 % 10) + double(pmod(xxhash64(id), 8)) > 7 + (id % 3) / 2) AS result"
    rows = spark.range(20_000).selectExpr("int(id * 37 % 10) AS a", "double(id % 3) AS b", "double(id % 7) AS c", noisy)
    plain = training.train_tabular(rows, ["a", "b", "c"], "result", names=("random_forest",))["random_forest"]
    monkeypatch.setattr(training, "CELL_ROWS", 10_000, raising=False)
    counted = training.train_tabular(rows, ["a", "b", "c"], "result", names=("random_forest",))["random_forest"]
    # 210 cells of bins with up to two labels, whatever the number of rows; then one tree at a time of a hundred.
    assert read[0] == 20_000 and len(read) == 101 and max(read[1:]) <= 420
    forest = counted.stages[-1]
    assert len(forest.trees) == forest.getNumTrees == 100 and all(" <= " in t.toDebugString for t in forest.trees)
    assert forest.featureImportances.toArray() == pytest.approx(plain.stages[-1].featureImportances.toArray(), abs=0.03)
    score = lambda m: m.transform(rows).groupBy("a", "b", "c").agg(F.first(F.element_at(vector_to_array("probability"), 2)).alias("p"))
    apart = score(plain).join(score(counted).withColumnRenamed("p", "q"), ["a", "b", "c"]).agg(F.count(F.lit(1)), F.max(F.abs(F.col("p") - F.col("q")))).first()
    assert apart[0] == 210 and apart[1] < 0.1


def test_weights_of_cells_are_sums_of_those_of_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(training, "materialize", lambda df, schema=None: seen.append(write(df, schema)) or seen[-1])
    write = materialize
    monkeypatch.setattr(training, "CELL_ROWS", 10_000)
    rows = spark.range(20_000).selectExpr("double(id % 4) AS a", "double(id % 5 = 0) AS b", "int(id % 4 > 1) AS result")
    training.train_tabular(rows, ["a", "b"], "result", names=("random_forest",))
    for r in seen[-1].collect():  # Poisson, of the mean and variance that the cell has rows
        drawn = [r[f"_w{t}"] for t in range(100)]
        assert abs(sum(drawn) / 100 - r["n"]) < 0.5 * r["n"] ** 0.5 and 0.4 < sum((x - r["n"]) ** 2 for x in drawn) / 100 / r["n"] < 2


def test_bins_follow_quantiles():
    assert training.bin_edges([1.0, 2.0, 2.0, 4.0]) == [1.5, 3.0] and training.bin_edges([3.0] * 9) == []
    edges = training.bin_edges([float(i) for i in range(3200)])
    assert len(edges) == 31 and all(abs(b - a - 100) <= 1 for a, b in zip(edges, edges[1:]))


def test_reserved_families_are_computed_once(spark):
    rows = lambda texts: spark.createDataFrame(list(enumerate(texts)), "row_ord long, text string")
    out = corpus.exclude_reserved_families(rows(["one", "ONE ", "two", None, "three"]), rows(["Two", None, "four"]))
    assert "sha2" not in optimized(out)
    assert sorted(r.text or "" for r in out.collect()) == ["", "one", "three"]


def test_long_phrases_are_captured_in_one_pass(spark):
    texts = ["b a b. a  b\U0001d4b3 a b", "a", "x_a b-c", "a b-c d", "", None, "B-C éa b"]
    messages = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    phrases = ["a b", "a b-c", "b-c", "b", "b a b. a", "a  b\U0001d4b3"]
    listed = spark.createDataFrame([(i, "c", "low", p) for i, p in enumerate(phrases)], rules.RULES_SCHEMA)
    joined = rules._joined(messages, listed, "id", "text")
    found = optimized(joined)
    assert "array_join" not in found and found.count("regexp_extract_all") == 4  # one a length
    assert counted(joined) == counted(rules.keyword_rules(messages, listed, "id"))
