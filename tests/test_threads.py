"""Raw mail to verdicts, renderings of nested alternatives, nesting without a limit."""

from pyspark.sql import functions as F

from msgrisk.catalog import sender as senders
from msgrisk.operators import mail
from msgrisk.plans import mail as plan

NEST = """From: A <box@shop.example.net>\r\nSubject: m{0}\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="b{0}"\r\n\r\n--b{0}\r
Content-Type: text/plain\r\n\r\ntext {0}\r\n{1}--b{0}--\r\n"""

ALTERNATIVES = b"""From: a@x.example\r\nSubject: s\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="m"\r\n\r\n--m\r
Content-Type: multipart/alternative; boundary="a"\r\n\r\n--a\r\nContent-Type: text/plain\r\n\r\none\r\n--a\r
Content-Type: multipart/alternative; boundary="c"\r\n\r\n--c\r\nContent-Type: text/plain\r\n\r\ntwo\r\n--c\r\nContent-Type: text/html\r\n\r\n<p>three</p>\r\n--c--\r
--a--\r\n--m\r\nContent-Type: multipart/alternative; boundary="d"\r\n\r\n--d\r\nContent-Type: text/plain\r\n\r\nfour\r\n--d\r
Content-Type: text/html\r\n\r\n<style>p { display: none }</style><p>five</p>\r\n--d--\r\n--m--\r\n"""


def nested(depth, text=""):
    raw = ""
    for i in range(depth, -1, -1):
        raw = NEST.format(i, f"--b{i}\r\nContent-Type: message/rfc822\r\n\r\n{raw}\r\n" if raw else text)
    return raw.encode()


def run(spark, rows, **options):
    raw = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows], "path string, content binary")
    rules = spark.createDataFrame([(1, "money", "high", "text 7")], "ord long, category string, level string, phrase string")
    return {(r.root_id, len(r.msg_path)): r for r in plan.analyze_eml(raw, rules, **options).collect()}


def test_any_depth_of_attached_messages(spark):
    risky = '--b12\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename="run.exe"\r\n\r\nMZ\r\n'
    found = run(spark, [("deep", nested(12, risky)), ("none", None), ("empty", b"")])
    assert len(found) == 13 + 1
    assert found["deep", 12].risk_level == "high" and found["deep", 12].attached_messages == 0
    # A folded verdict floors all messages around it, its warning comes up with one prefix a level.
    for depth in range(12):
        row = found["deep", depth]
        assert row.risk_level == "high" and row.risk_floor == "high" and row.attached_messages == 12 - depth
        assert row.warnings == ["attached:" * (12 - depth) + "attachment_not_inspected"]
    assert found["deep", 7].kinds == ["phrases:money"] and found["deep", 7].total_score == 4
    assert found["empty", 0].risk_level == "safe" and found["empty", 0].analysis_complete


def test_many_parts_and_attached_messages(spark):
    """Over 200 parts and over 20 attached messages are all read."""
    inner = "".join(f"--b0\r\nContent-Type: message/rfc822\r\n\r\nSubject: c{i}\r\n\r\nchild\r\n" for i in range(30))
    texts = "".join(f"--b0\r\nContent-Type: text/plain\r\n\r\npart {i}\r\n" for i in range(300))
    raw = spark.createDataFrame([("wide", bytearray(NEST.format(0, texts + inner).encode()))], "path string, content binary")
    e = mail.ingest_eml(raw)
    assert e["messages"].count() == 31 and e["parts"].where("size(msg_path) = 0").count() == 301
    assert e["messages"].where("size(warnings) > 0").count() == 0


def test_sender_and_view_branches(spark):
    tables = plan.SenderTables(*senders.registries(spark), senders.NAMES)

    def score(views):
        return views.select(*plan.KEY, "view", F.when(F.col("body").contains("two"), 0.9).when(F.col("body") != "", 0.2).alias("probability"),
                            F.when(F.col("body") == "", "insufficient_context").otherwise("available").alias("ml_status"))

    found = run(spark, [("alt", ALTERNATIVES), ("bare", b"From: x@y.example\r\n\r\n")], senders=tables, score=score, threshold=0.5)
    alt = found["alt", 0]
    assert alt.probability == 0.9 and alt.risk_level == "high" and alt.sender == "a@x.example"
    assert "mime_alternatives_unscored" in alt.warnings and "stylesheet_visibility" in alt.warnings  # the hidden branch is not scored
    bare = found["bare", 0]
    assert bare.probability is None and bare.warnings == ["insufficient_context"]


def views_of(spark, raw, limit=1024):
    parts = mail.ingest_eml(spark.createDataFrame([("one", bytearray(raw))], "path string, content binary"))["parts"]
    readable = parts.withColumn("content", F.trim(F.regexp_replace("content", r"(?s)<style.*</style>|<[^>]*>|\s+", " ")))
    marked = readable.withColumn("uncertain", F.col("content") == "five")
    return [(r.view, r.body.split(), r.uncertain, r.truncated) for r in mail.mime_views(marked, ["root_id"], limit).orderBy("view").collect()]


def test_views_of_nested_alternatives(spark):
    views = views_of(spark, ALTERNATIVES)
    bodies = [" ".join(b) for _, b, _, _ in views]
    # First branches, shallow paths, then all other choices; the inner choice is idle while its branch is not taken.
    assert sorted(bodies) == ["one five", "one four", "three five", "three four", "two five", "two four"]
    assert bodies[0] == "one four" and bodies.index("one five") < bodies.index("three five")
    assert all(u == ("five" in b) for _, b, u, _ in views) and not any(t for *_, t in views)
    few = views_of(spark, ALTERNATIVES, limit=3)
    assert len(few) <= 3 and all(t for *_, t in few) and few[0][1] == ["one", "four"]
