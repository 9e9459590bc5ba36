import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from msgrisk.functions import hashing, hosts, stats, unicode
from msgrisk.functions import text as tx
from msgrisk.operators import rules


def values(spark, items, build, schema="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {schema}")
    return [r[0] for r in df.orderBy("i").select("i", build(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_family(spark):
    got = values(spark, ["  Hi 12 a1 été9 BOB.x@Mail.example.org see https://a.b/c?d 7 8 ", "x  y\n\nz"], tx.text_family)
    assert got == ["hi <number> a1 été9 <email> see <url> <number> <number>", "x y z"]


def test_template_needs_length(spark):
    long = "word number 123 and more words to reach the limit of eighty characters in this line here ok"
    a, b, c = values(spark, [long, long.replace("123", "77"), "short 1"], tx.template_fingerprint)
    assert a == b and a is not None and c is None


def test_entropy(spark):
    def ref(s):
        return -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s)) if s else 0.0

    words = ["", "aaaa", "abcd", "hello.world"]
    assert values(spark, words, tx.shannon_entropy) == pytest.approx([ref(w) for w in words])


def test_phrases(spark):
    got = values(spark, ["act now!", "react now", "pay $5 earn $ now", "reach now"], lambda c: tx.keyword_match(F.lower(c), "act now"))
    assert got == [True, False, False, False]
    assert values(spark, ["we earn $9"], lambda c: tx.keyword_match(F.lower(c), "earn $")) == [True]


def test_amounts(spark):
    got = values(spark, ["USD 5,000,000.00 and $12", "€1.234.567", "$1,23,456", "$ 00012345", "gbp 12345.67"], tx.large_amounts)
    assert got == [["USD 5,000,000.00"], ["€1.234.567"], [], ["$ 00012345"], ["gbp 12345.67"]]


def test_obfuscation(spark):
    got = values(spark, ["P@yP@l and g00gle", "paypal google", "call 0800 b4nk"], tx.obfuscated_terms)
    assert [sorted(g) for g in got] == [["Google", "PayPal"], [], ["bank"]]


def test_pressured_request(spark):
    urgent, threat = ["act now"], ["account suspended"]
    texts = [
        "Account suspended. Act now and enter your password here.",
        "Account suspended. Act now. We will never ask you to enter your password.",
        "Please enter your password.",
        "Account suspended, act now. Never share your password. Please provide the password.",
    ]
    got = values(spark, texts, lambda c: tx.pressured_credential_request(c, urgent, threat))
    assert got == [True, False, False, True]


def test_han_and_segments(spark):
    assert values(spark, ["漢" * 12, "漢" * 11, "кириллица"], tx.substantial_han) == [True, False, False]
    got = values(spark, ["abc привет привет мир def", "漢字かなカナ漢字かなカナ漢字 x"], lambda c: unicode.non_latin_segments(c, F.lit(12)))
    assert got == [["привет привет мир"], ["漢字かなカナ漢字かなカナ漢字"]]


def test_redact(spark):
    got = values(spark, ["mail bob@x.org https://u:p@h.example:8080/a/b?q=1#f end"], tx.redact)
    assert got == ["mail [mailbox]@x.org https://h.example:8080/a/b end"]


def test_hmac_and_aliases(spark):
    got = values(spark, ["a.b+x@gmail.com", "A.B@googlemail.com", "a+b@corp.example", "two@@x"], hashing.canonical_sender)
    assert got == ["ab@gmail.com", "ab@googlemail.com", "a+b@corp.example", "two@@x"]
    key = b"k" * 80
    assert values(spark, ["ab"], lambda c: hashing.hmac_sha256(key, c)) == [hmac.new(key, b"ab", hashlib.sha256).hexdigest()]


@pytest.mark.parametrize("s,n,low,high", [(2, 2, 0.3424, 1.0), (2, 4, 0.1500, 0.8500), (0, 3, 0.0, 0.5615), (1, 2, 0.0945, 0.9055)])
def test_wilson(spark, s, n, low, high):
    r = spark.range(1).select(stats.wilson_low(F.lit(s), F.lit(n)), stats.wilson_high(F.lit(s), F.lit(n))).first()
    assert (round(r[0], 4), round(r[1], 4)) == (low, high)


def test_wilson_without_rows(spark):
    assert spark.range(1).select(stats.wilson_low(F.lit(0), F.lit(0))).first()[0] is None


@pytest.mark.parametrize("url,base,want,host,valid", [
    ("hxxps://a.example/x", None, "https://a.example/x", "a.example", True),
    ("http:\\\\evil.example\\p?a\\b", None, "http://evil.example/p?a\\b", "evil.example", True),
    ("//cdn.example/x", None, "https://cdn.example/x", "cdn.example", True),
    ("../b/./c?q", "http://h.example/x/y/z", "http://h.example/x/b/c?q", "h.example", True),
    ("?q=1", "http://h.example/x/y", "http://h.example/x/y?q=1", "h.example", True),
    ("#top", "http://h.example/x?y", "http://h.example/x?y#top", "h.example", True),
    ("http://u:p@1.2.3.4:80/", None, "http://u:p@1.2.3.4:80/", "1.2.3.4", True),
    ("http://", None, "http://", "", False),
    ("http://h.example:99999/", None, "http://h.example:99999/", "h.example", False),
    ("mailto:a@b.c", None, "mailto:a@b.c", "", True),
    ("http://[::1]:8080/x", None, "http://[::1]:8080/x", "::1", True),
    ("http://my_host.example/x", None, "http://my_host.example/x", "my_host.example", True),
    ("http://ex%61mple.org/", None, "http://ex%61mple.org/", "example.org", True),
])
def test_destination(spark, url, base, want, host, valid):
    p = spark.range(1).select(hosts.parse_destination(F.lit(url), None if base is None else F.lit(base)).alias("p")).first().p
    assert (p.url, p.host, p.valid) == (want, host, valid)


def test_ip_hosts(spark):
    good = ["1.2.3.4", "3232235777", "0x7f.1", "0177.0.0.1", "::1", "2001:db8::1", "127.1"]
    bad = ["1.2.3", "256.1.1.1", "example.org", "4294967296", "08.1.1.1", "1.2.3.4.5", ""]
    assert values(spark, good, hosts.is_ip_host) == [True] * 7
    assert values(spark, bad, hosts.is_ip_host) == [True] + [False] * 6  # 1.2.3 is an abbreviated address


def test_lookalikes(spark):
    got = values(spark, ["paypa1", "pineapple", "pay-pal", "apple-id", "grapes"], lambda c: hosts.brand_lookalike(c, "apple") | hosts.brand_lookalike(c, "paypal"))
    assert got == [True, False, True, True, False]


def test_rule_forms_agree(spark):
    texts = ["Act now, verify your account today", "time-sensitive matter: act now", "react now", "verify your account. verify  your account"]
    m = spark.createDataFrame([(i, tx_) for i, tx_ in enumerate(texts)], "id int, text string")
    phrases = ["act now", "verify your account", "time-sensitive", "account"]
    r = spark.createDataFrame([(i, "c", "high", p) for i, p in enumerate(phrases)], rules.RULES_SCHEMA)
    one = sorted(map(tuple, rules.keyword_rules(m, r, "id").collect()))
    two = sorted(map(tuple, rules._joined(m, r, "id", "text").collect()))
    assert one == two and len(one) == 3
