import pytest

from msgrisk.operators import evaluate, fuse, mail, posture, rules, sender

NESTED = b"""From: A <a@x.example>\r\nTo: b@y.example\r\nSubject: outer\r\nSubject: again\r\nMIME-Version: 1.0
Content-Type: multipart/mixed; boundary="m"

--m
Content-Type: multipart/alternative; boundary="n"

--n
Content-Type: text/plain

plain view
--n
Content-Type: text/html

<p>html view</p>
--n--
--m
Content-Type: message/rfc822

From: c@z.example
Subject: inner
Content-Type: text/plain; charset=no-such-charset

inner text
--m
Content-Type: application/vnd.ms-word.document.macroenabled.12
Content-Disposition: attachment; filename="a.bin"

x
--m--
""".replace(b"\r\n", b"\n")


@pytest.fixture(scope="module")
def tables(spark):
    return mail.ingest_eml(spark.createDataFrame([("one", bytearray(NESTED))], "path string, content binary"))


def test_entities(tables):
    rows = {tuple(r.msg_path): r for r in tables["messages"].collect()}
    assert rows[()].subject == "outer\nagain" and rows[(0,)].subject == "inner"
    assert "decoding_fallback" in rows[(0,)].warnings
    parts = sorted((tuple(p.msg_path), p.content_type, p.content.strip()) for p in tables["parts"].collect())
    assert parts == [((), "text/html", "<p>html view</p>"), ((), "text/plain", "plain view"), ((0,), "text/plain", "inner text")]


def test_alternative_views(tables):
    views = sorted((r.view, r.body.strip()) for r in mail.mime_views(tables["parts"].where("size(msg_path) = 0"), ["root_id"]).collect())
    assert views == [(1, "plain view"), (2, "<p>html view</p>")]


def test_attachments_and_duplicates(tables):
    risk = mail.attachment_risk(tables["attachments"], ["root_id"]).first()
    assert (risk.points, risk.floor) == (4, "high")
    assert [(r.name, r.n) for r in mail.duplicate_headers(tables["headers"], ["root_id", "msg_path"]).collect()] == [("subject", 2)]


@pytest.mark.parametrize("value,expected", [
    ("mx.a; spf=pass (x; dmarc=fail); dkim=fail", ("mx.a", "pass", "fail", None, True)),
    ('mx.a 1; spf=pass reason="; dmarc=fail"', ("mx.a", "pass", None, None, True)),
    ("mx.a (open; spf=pass", ("", None, None, None, False)),
    ("mx.a; dmarc = PASS header.from=a; spf=softfail", ("mx.a", "softfail", None, "pass", True)),
    ("mx.a (n (deep) ok); spf / 1 = fail", ("mx.a", "fail", None, None, True)),
])
def test_auth_results(spark, value, expected):
    a = spark.createDataFrame([(value,)], "value string").select(mail.parse_auth_results().alias("a")).first().a
    ident, spf, dkim, dmarc, complete = expected
    assert (a.results.spf, a.results.dkim, a.results.dmarc, a.complete) == (spf, dkim, dmarc, complete)
    assert not complete or a.authserv_id == ident


@pytest.mark.parametrize("p,score,floor,level,basis", [
    (None, 0, "safe", "safe", "other"), (0.95, 0, "safe", "high", "model_only"), (0.95, 4, "safe", "high", "model_led"),
    (0.95, 9, "safe", "critical", "corroborated"), (0.1, 2, "medium", "medium", "other"), (None, 13, "safe", "critical", "other"),
    (None, 1, "safe", "low", "other"), (0.85, 0, "high", "critical", "corroborated"),
])
def test_fusion(spark, p, score, floor, level, basis):
    df = spark.createDataFrame([(p, score, floor)], "probability double, total_score int, risk_floor string")
    r = fuse.fuse_risk(df, "probability", 0.5).first()
    assert (r.risk_level, r.fusion_basis) == (level, basis)


def test_abstention(spark):
    rows = [("safe", ["han_text"], False, False), ("safe", ["remote_images"], False, False), ("low", ["x"], True, False), ("low", ["x"], False, False), ("safe", [], False, False)]
    df = spark.createDataFrame([(*r, 5.0) for r in rows],
                               "risk_level string, warnings array<string>, rendering_uncertain boolean, remote_image_dominant boolean, combined_score double")
    got = [(r.risk_level, r.combined_score) for r in fuse.abstain(df).collect()]
    assert got == [("unknown", None), ("safe", 5.0), ("unknown", None), ("low", 5.0), ("safe", 5.0)]


@pytest.mark.parametrize("txt,want", [
    (["v=spf1 ip4:1.2.3.0/24 -all"], ("strict", "ok")), (["v=spf1 a", "v=spf1 -all"], (None, "error")), (["v=spf1 a:"], (None, "error")),
    (["other"], (None, "not_found")), (["v=spf1 redirect=x.example"], ("unknown", "ok")), (["V=SPF1 ALL"], ("open", "ok")), ([], (None, "not_found")),
])
def test_spf(spark, txt, want):
    r = spark.createDataFrame([(txt,)], "t array<string>").select(posture.spf_policy("t").alias("s")).first().s
    assert (r.policy, r.status) == want


def test_mail_service(spark):
    rows = [(["0 ."], "ok", None, None), (["0 .", "5 a.b"], "ok", None, None), (["5 a.b"], "ok", None, None), ([], "not_found", "not_found", "not_found"),
            ([], "not_found", "ok", None), ([], "timeout", None, None), ([], "not_found", "timeout", "not_found"), ([], "nxdomain", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, mx array<string>, ms string, a string, aaaa string")
    got = [r[0] for r in df.orderBy("i").select(posture.mail_service("mx", "ms", "a", "aaaa")).collect()]
    assert got == ["no_mail_service", "unverifiable", "mx_found", "likely_invalid", "mx_found", "unverifiable", "unverifiable", "likely_invalid"]


def test_public_addresses(spark):
    df = spark.createDataFrame([(["8.8.8.8", "10.0.0.1", "8.8.8.8", "2606:4700::1", "2001:db8::1", "fe80::1", "192.168.1.1", "bad"],)], "a array<string>")
    assert df.select(posture.public_address_filter("a")).first()[0] == ["8.8.8.8", "2606:4700::1"]


def _boxes(spark, rows):
    headers = [("r", n, i, [(d, a)]) for i, (n, d, a) in enumerate(rows)]
    return mail.mailboxes(spark.createDataFrame(headers, "root_id string, name string, ord int, mailboxes array<struct<display: string, address: string>>"), ["root_id"])


def test_foreign_domains(spark):
    same = _boxes(spark, [("from", "", "a@bücher.example"), ("reply-to", "", "a@xn--bcher-kva.example")])
    assert {r.domain for r in same.collect()} == {"xn--bcher-kva.example"}
    assert mail.routing_mismatch(same, ["root_id"]).count() == 0
    assert mail.routing_mismatch(_boxes(spark, [("from", "", "a@bücher.example"), ("reply-to", "", "a@other.example")]), ["root_id"]).count() == 1
    for display, address in (("", "x@xn--pypal-4ve.com"), ("ＰａｙＰａｌ Service", "x@shop.example"), ("PayPal", "x@shop.example")):
        assert mail.brand_display_identity(_boxes(spark, [("from", display, address)]), ["root_id"]).count() == 1
    assert mail.brand_display_identity(_boxes(spark, [("from", "Bücher", "x@bücher.example")]), ["root_id"]).count() == 0
    found = sender.from_addresses(_boxes(spark, [("from", "", "a@bücher.example"), ("from", "", "A@xn--bcher-kva.example")]), ["root_id"], "ord").collect()
    assert [r.address for r in found] == ["a@xn--bcher-kva.example"]


@pytest.mark.parametrize("value,expected", [
    ("dmarc=pass", (None, None, None)),
    ("mx.a; spf=pass (((((((((deep))))))))) ; dkim=fail", ("pass", "fail", None)),
    ("mx\\.a; spf=pass", ("pass", None, None)),
    ("mx.a; spf=fail; spf=pass", ("pass", None, None)),
    ("mx.a; spf=pass; dkim=fail (open", (None, "fail", None)),
])
def test_auth_clauses(spark, value, expected):
    a = spark.createDataFrame([(value,)], "value string").select(mail.parse_auth_results().alias("a")).first().a
    assert (a.results.spf, a.results.dkim, a.results.dmarc) == expected


def test_later_trusted_claims(spark):
    rows = [("r", "authentication-results", i, v) for i, v in enumerate(["mx.a; dmarc=fail", "mx.a; dmarc=pass", "other; spf=pass"])]
    headers = spark.createDataFrame(rows, "root_id string, name string, ord int, value string")
    r = mail.auth_verdict(headers, ["root_id"], ["mx.a"]).first()
    assert (r.verdict, r.untrusted_claims) == ("failed", 2)


def test_nested_rollup(spark):
    schema = "root_id int, msg_path array<int>, total_score int, risk_floor string, risk_level string, inline_images int, remote_images int, unresolved_images int, warnings array<string>"
    deep = [[0] * k for k in range(12)]
    rows = [(1, p, 20 if len(p) == 11 else 0, "safe", "safe", 1, 3, 0, ["remote_images", "odd"] if len(p) == 11 else []) for p in deep]
    rows += [(2, [], 0, "safe", "safe", 0, 0, 0, []), (2, [0], 9, "safe", "safe", 0, 0, 0, []), (3, [], 1, "safe", "low", 0, 0, 0, []), (3, [0], 0, "safe", "unknown", 0, 0, 2, [])]
    got = {r.root_id: r for r in fuse.nested_rollup(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].risk_level, got[1].total_score, got[1].inline_images, got[1].remote_images) == ("critical", 20, 12, 36)
    assert got[1].warnings == ["attached:" * 11 + "odd"]
    assert (got[2].risk_floor, got[2].risk_level) == ("high", "high")
    assert (got[3].risk_floor, got[3].risk_level, got[3].unresolved_images) == ("safe", "low", 2)


def test_gate_fails_closed(spark):
    empty = spark.createDataFrame([], "metric string, status string")
    assert evaluate.regression_gate(empty, {}, {}).first().passed is False
    fine = spark.createDataFrame([("recall", "ok")], "metric string, status string")
    assert evaluate.regression_gate(fine, {}, {}).first().passed is True
    assert evaluate.regression_gate(fine, {}, None).first().passed is False


def test_rules_agree_in_both_forms(spark, monkeypatch):
    texts = ["x_foo bar y", "foo bar", "a!b? c", "win cash now", "winner cash", "ends with bar_", "foo  bar"]
    messages = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    phrases = ["_foo bar", "foo bar", "!b?", "cash", "win", "bar_", "now", "a", "c", "y"]
    table = spark.createDataFrame([(i, "k", "low", p) for i, p in enumerate(phrases)], "ord bigint, category string, level string, phrase string")
    one = sorted((r.id, tuple(r.matched), r["count"]) for r in rules.keyword_rules(messages, table, "id").collect())
    monkeypatch.setattr(rules, "UNROLLED_RULES", 2)
    assert one == sorted((r.id, tuple(r.matched), r["count"]) for r in rules.keyword_rules(messages, table, "id").collect())
    assert (0, ("_foo bar", "y"), 2) in one


def test_recipients_of_every_message(spark):
    boxes = _boxes(spark, [("from", "", "a@x.example"), ("to", "", "a@x.example")])
    messages = spark.createDataFrame([("r",), ("bare",)], "root_id string")
    got = {r.root_id: (r.no_visible_recipient, r.self_addressed) for r in mail.recipients(boxes, ["root_id"], messages).collect()}
    assert got == {"r": (False, True), "bare": (True, False)}
