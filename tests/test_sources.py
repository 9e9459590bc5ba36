import hashlib
import json

import pytest
from pyspark.sql import functions as F

from msgrisk.operators import corpus
from msgrisk.sources import corpora, evaluation


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_typed(spark, tmp_path):
    f = write(tmp_path / "t.csv", ',Email Text,Email Type\n0,"buy, ""now""\nplease",Phishing Email\n1,  ,Safe Email\n2,hello,Other\n3,hi there,Safe Email\n')
    assert sorted((r.text, r.label) for r in corpora.scan_typed_csv(spark, f, "t").collect()) == [('buy, "now"\nplease', 1), ("hi there", 0)]


def test_subject_body(spark, tmp_path):
    f = write(tmp_path / "s.csv", "subject,body,label\nS,a body of enough length here,1\nDon't,delete folder internal data please ok,0\n,short,0\n,another body that is long enough,0\n")
    got = sorted((r.text, r.label) for r in corpora.scan_subject_body_csv(spark, f, "s").collect())
    assert got == [("S\n\na body of enough length here", 1), ("another body that is long enough", 0)]


def test_json_payload(spark, tmp_path):
    ok = json.dumps({"subject": "Hello", "body": "a body of enough length"}).replace('"', '""')
    f = write(tmp_path / "j.csv", f'id,url_raw,email_content,phish_label\n1,http://A.example,"{ok}",1\n2,,"{ok}",0\n3,,"{{bad",1\n')
    got = {r.label: r.group_id for r in corpora.scan_json_payload_csv(spark, f, "j").collect()}
    assert got == {1: "j:url:" + hashlib.sha256(b"http://a.example").hexdigest()[:20], 0: "j:id:2"}


def test_three_class(spark, tmp_path):
    f = write(tmp_path / "c.csv", "Subject,Body,Type,Original_ID\nA,a body of enough length here,Phishing,7\nB,another body of length here,Spam,8\nC,third body of enough length,Valid,9\n")
    assert sorted((r.label, r.group_id) for r in corpora.scan_three_class_csv(spark, f, "c").collect()) == [(0, "c:9"), (1, "c:7")]


def test_dated_partitions(spark, tmp_path):
    rows = "﻿hash;subject;body;date;Label\nh1;s;early message of enough length;2023-05-01;1\nh2;s;undated message of enough length;;0\nh3;s;validation message long enough;2024-03-01;1\nh4;s;validation message long enough;2025-02-01;1\n;s;no hash message of enough length;2023-01-01;0\nh6;s;bad label message of length;2023-01-01;x\n"
    df = corpora.scan_dated_corpus(spark, write(tmp_path / "d.csv", rows), "d")
    parts = df.withColumn("partition", corpus.temporal_partition(F.col("observed_at"), "2024-01-01", "2025-01-01")).withColumnRenamed("group_id", "family")
    got = sorted((r.partition, r.copies, r.excluded) for r in corpus.temporal_family_isolation(parts).collect())
    assert got == [("holdout", 1, 1), ("train", 1, 0), ("train", 1, 0)]


def test_missing_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="missing columns"):
        corpora.scan_dated_corpus(spark, write(tmp_path / "d.csv", "hash;subject\na;b\n"), "d")


def test_digests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.csv", "data")
    good = hashlib.sha256(b"data").hexdigest()
    expected = spark.createDataFrame([("a.csv", good), ("b.csv", good)], "name string, sha256 string")
    assert {r.name: r.status for r in corpora.verify_source_digests(spark, str(tmp_path / "in"), expected).collect()} == {"a.csv": "ok", "b.csv": "absent"}


def test_feature_table(spark, tmp_path):
    f = write(tmp_path / "f.csv", " A ,b,Result\n1,x,-1\n-1,0,\n0,1,1\n")
    assert sorted(map(tuple, corpora.scan_feature_table(spark, f, ["a", "b"]).collect())) == [(0, 1, 1), (1, 0, -1)]


def test_eval_rows(spark, tmp_path):
    rows = [{"provider": "gmail", "label": "phishing", "received_at": "2024-02-30", "subject": "s"}, {"provider": "x", "label": "legitimate", "received_at": "2024-02-01", "eml_path": "rel", "body": "b"},
            {"provider": "outlook", "label": "legitimate", "received_at": "2024-02-01", "language": "en", "body": "b"}]
    f = write(tmp_path / "e.jsonl", "\n".join(map(json.dumps, rows)) + "\n{bad\n")
    df = evaluation.read_eval_jsonl(spark, f)
    got = sorted(tuple(r.violations) for r in df.collect())
    assert () in got and ("invalid_date",) in got and ("invalid_provider", "mixed_input", "relative_path") in got and len(got) == 4
    with pytest.raises(ValueError, match="3 invalid rows"):
        evaluation.fail_closed(df)


def test_manifest(spark, tmp_path):
    source = {"id": "s1", "url": "https://a.example/x", "revision": "abc", "license": "l", "label_basis": "b"}
    m = write(tmp_path / "m.json", json.dumps({"schema_version": 1, "records": "r", "sources": [source, {**source, "id": "s2", "revision": "Main"}]}))
    sources = evaluation.manifest_sources(spark, m)
    assert {r.id: r.violations for r in sources.collect()} == {"s1": [], "s2": ["moving_revision"]}
    f = write(tmp_path / "r.jsonl", "\n".join(map(json.dumps, [
        {"id": "a", "source_id": "s1", "label": "phishing", "body": "x"}, {"id": "a", "source_id": "zz", "label": "phishing", "body": "x", "content_sha256": "0"}])))
    got = sorted(tuple(r.violations) for r in evaluation.manifest_records(evaluation.read_jsonl(spark, f), sources).collect())
    assert got == [("duplicate_id",), ("duplicate_id", "unknown_source", "content_digest")]


def test_registry(spark):
    lines = spark.createDataFrame([(" A.example. # note",), ("# only",), ("b.example",), ("a.example",)], "value string")
    reg = evaluation.build_domain_registry(lines)
    assert sorted(r.domain for r in reg.collect()) == ["a.example", "b.example"]
    r = evaluation.validate_registry(reg, "2024.13.01", 3, spark.createDataFrame([("b.example",)], "domain string")).first()
    assert (r.not_normalized, r.duplicates, r.count_mismatch, r.invalid_version, r.shared_with_other) == (0, 0, 1, 1, 1)


def test_archive(spark):
    record = {"id": "i1", "title": "t", "risk": "low", "status": "closed", "verdict": None, "version": 1, "created_at": "a", "updated_at": "b", "created_by": "c",
              "input_sha256": "a" * 64, "events": [{"actor": "x", "action": "created", "note": "", "happened_at": "h", "changes": "{}"}], "analysis": {"risk_level": "low"}}
    summary = {k: record[k] for k in ("title", "risk", "status", "verdict", "version")}
    rows = [("r:i1", record), ("s:i1", summary), ("k1", {"id": "i1", "digest": "a" * 64}), ("r:i2", {**record, "id": "i2", "version": 3}), ("s:i2", {**summary, "risk": "high"})]
    df = spark.createDataFrame([(f, json.dumps(v)) for f, v in rows], "field string, value string")
    got = {r.id: r.violations for r in evaluation.archive_integrity(df).collect()}
    assert got == {"i1": [], "i2": ["request_missing", "version_mismatch", "summary_mismatch"]}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "holdout"), ("b", "development")], "id string, cohort_role string")
    evaluation.write_cohort(df, str(tmp_path / "cohort"))
    assert spark.read.json(str(tmp_path / "cohort")).count() == 2
    evaluation.write_registry(spark.createDataFrame([("b.x",), ("a.x",)], "domain string"), str(tmp_path / "reg"), "2024.01.01", "made here")
    assert spark.read.json(str(tmp_path / "reg")).where("version = '2024.01.01'").count() == 2


def test_equal_rows_keep_their_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"","Email Text","Email Type"\n' + "".join(f'{i},"same text here","Safe Email"\n' for i in range(3)) + '9,"other text","Safe Email"\n')
    rows = corpora.scan_typed_csv(spark, str(tmp_path / "a.csv"), "s")
    assert rows.select("row_ord").distinct().count() == 4
    assert [r.text for r in rows.orderBy("row_ord").collect()] == ["same text here"] * 3 + ["other text"]
    assert sorted((r.text, r.copies) for r in corpus.dedup_families(rows).collect()) == [("other text", 1), ("same text here", 3)]
