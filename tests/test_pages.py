import pytest

from msgrisk.operators import links, pages

CASES = {
    "hidden_attribute": ("<p>a<span hidden>b</span>c</p>", "ac", 1),
    "display_none": ('<div style="display:none">secret</div>ok', "ok", 6),
    "important_wins": ('<div style="display:none!important;display:block">x</div>y', "y", 1),
    "quoted_semicolon": ("<p style=\"content:';display:none';color:red\">seen</p>", "seen", 0),
    "visible_child": ('<div style="visibility:hidden">a<b style="visibility:visible">b</b></div>', "b", 1),
    "zero_opacity": ('<p style="opacity:0"><b style="opacity:1">x</b></p>z', "z", 1),
    "inert": ("<head><title>t</title><style>p{}</style></head><body>b<script>s</script><template>q</template>", "b", 0),
    "unclosed_head": ("<head><meta x><p>body text", "body text", 0),
    "literal_textarea": ("<textarea><b>raw</b></textarea>", "<b>raw</b>", 0),
    "alt_without_source": ('<img alt="shown text">', "shown text", 0),
    "implied_list_end": ('<ul><li style="display:none">a<li>b</ul>', "b", 1),
    "entities": ("a &amp; b&nbsp;c", "a & b c", 0),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_visible_text(spark, name):
    html, text, hidden = CASES[name]
    row = pages.page_facts(spark.createDataFrame([(1, html)], "id int, html string"), ["id"]).first()
    assert (row.text, row.hidden_chars) == (text, hidden)


def facts(spark, html):
    return pages.page_facts(spark.createDataFrame([(1, html, "http://site.example/dir/page")], "id int, html string, url string"), ["id", "url"])


def test_links(spark):
    html = ('<base href="http://base.example/d/"><a href="x">Label <b>bold</b></a><a href="HXXP://e.example">e</a>'
            '<form action="/go"><input formaction="f"></form><p>see https://bare.example/a. and [md](http://md.example/z)</p><a>none</a>')
    got = {(r.visible, r.destination) for r in pages.html_links(facts(spark, html), ["id"], "url").collect()}
    assert ("Label bold", "http://base.example/d/x") in got and ("e", "HXXP://e.example") in got
    assert ("", "http://base.example/go") in got and ("", "http://base.example/d/f") in got
    assert ("", "https://bare.example/a") in got and ("md", "http://md.example/z") in got


def test_page_address_is_the_fallback_base(spark):
    got = [r.destination for r in pages.html_links(facts(spark, '<a href="../y?q">z</a>'), ["id"], "url").collect()]
    assert got == ["http://site.example/y?q"]


def test_images(spark):
    html = ('<img src="https://r.example/a.png"><img src="local.png"><img srcset="data:image/png;base64,AA 1x, //s.example/b 2x">'
            '<table background="//t.example/c"><div style="background:url(data:image/gif;base64,BB)"><style>p{background:url(http://u.example/d)}</style>')
    r = pages.html_image_refs(facts(spark, html), ["id"]).first()
    assert (r.data_images, r.remote_images, r.unresolved_images) == (2, 4, 1)


def test_forms_and_sheets(spark):
    f = facts(spark, '<form id=a></form><input type=password form=a><style>.x{display : none}</style><style>.y{color:red}</style>').first()
    assert f.password_form and f.style_hides
    assert not facts(spark, "<input type=password>").first().password_form
    assert not facts(spark, "<style>.y{color:red}</style>").first().style_hides


def test_padding_signal(spark):
    html = f'<div style="display:none">{"x" * 600}</div><a href="http://a.example"><img src="http://b.example/i.png"></a>'
    assert facts(spark, html).select(pages.hidden_padding_signal()).first()[0]
    assert not facts(spark, html + "visible " * 20).select(pages.hidden_padding_signal()).first()[0]


def test_conditional_markup(spark):
    f = facts(spark, '<!--[if mso]><a href="http://m.example">m</a><![endif]--><!--[if !mso]>n<![endif]-->').first()
    assert f.mso_conditional and [x.href for x in f.links] == ["http://m.example"] and f.text == "m"


def test_link_findings(spark):
    rows = [
        (1, 0, "paypal.com", "http://xn--pypal-4ve.com/x"), (1, 1, "", "http://xn--pypal-4ve.com/y"),
        (2, 0, "", "https://www.paypal.com/login"), (3, 0, "", "http://password-harvest.example/"), (4, 0, "", "http://h.example:99999/"),
        (5, 0, "www.apple.com", "https://support.apple.com/x"), (6, 0, "", "data:text/html,x"),
    ]
    df = spark.createDataFrame(rows, "id int, link_ord int, visible string, destination string")
    got = {}
    for r in links.link_findings(df, ["id"], ["gmail.com"]).collect():
        got.setdefault(r.id, set()).add(r.finding)
    assert got == {
        1: {"idn-confusable", "display-mismatch"}, 3: {"credential-collection-host"}, 4: {"malformed-target"}, 6: {"unsafe-scheme"}}


def test_public_suffixes(spark):
    rules = spark.createDataFrame([("com", "normal"), ("uk", "normal"), ("co.uk", "normal"), ("ck", "wildcard"), ("www.ck", "exception")], "suffix string, kind string")
    cases = {"a.b.example.co.uk": "example.co.uk", "x.shop.foo.ck": "shop.foo.ck", "www.ck": "www.ck", "a.www.ck": "www.ck", "co.uk": "co.uk", "h.unknown.tld": "unknown.tld"}
    df = spark.createDataFrame([(h,) for h in cases], "host string")
    assert {r.host: r.registrable for r in links.registrable_domain(df, "host", rules, ["host"]).collect()} == cases
