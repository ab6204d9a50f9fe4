import random
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from noticeflow import settings as S
from noticeflow.functions import markup, registration
from noticeflow.functions.nesting import walk
from noticeflow.plans import registry


def clean(spark, pages, look=markup.PLAIN):
    df = spark.createDataFrame(list(enumerate(pages)), "k int, page string")
    return [r.sanitised for r in markup.sanitised(df, "page", look=look).orderBy("k").collect()]


PLAIN_CASES = {
    "<p>Hi <b>x</p><script>alert('</p>')</script>y": "<p>Hi <b>x</b></p>y",
    "<style>p{}</style><title>t</title><iframe src=x>f</iframe><noscript>n</noscript>k": "k",
    "<form><p>in a form</p></form>after<input><svg/>x<svg><path/></svg>y<object>never closed": "afterxy",
    "<div><object>gone</div><p>kept</p>": "<p>kept</p>",
    "<head><meta charset=x><title>t</title><body>seen": "seen",
    "<center>text <font color=red>stays</font></center>": "text stays",
    "<!-- c --><!DOCTYPE html><?php x ?>a<!-- never closed": "a",
    "a < b & c &amp; d &eacute; > e": "a &lt; b &amp; c &amp; d &eacute; &gt; e",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "<ul><li>a</li><li>b<ul><li>c</li></ul></li><li>d</li></ul>",
    "<table><tr><td>1<td>2<tr><td>3</table>": "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>",
    "<b><i>x</b>y</i></u>z": "<b><i>x</i></b>yz",
    "<p>a<div>b</div>c</p>": "<p>a</p><div>b</div>c",
    "<table><tr><td><b>x</td></b><td>y</table>": "<table><tr><td><b>x</b></td><td>y</td></tr></table>",
    "<p>&nbsp;<br> </p><div><p> </p><div><br/></div></div><p><br>x</p>": "<p><br>x</p>",
    "<p><img src=x></p>t<p><hr></p>": "t<hr>",
    '<p onclick="x()" CLASS=c ID=i STYLE="COLOR:Red;position:fixed;background:url(x);font-weight:bold;width:expression(1)">x</p>': '<p style="color:Red;font-weight:bold">x</p>',
    '<p title="a > b" align=center dir=\'rtl\' lang="de" align=left>x</p>': '<p align="center" dir="rtl" lang="de">x</p>',
    '<a href="go.example.org/x" onclick=y title=\'"q"\'>ok</a>': '<a href="https://go.example.org/x" target="_blank" rel="noopener noreferrer" title="&quot;q&quot;">ok</a>',
    '<a href="javascript:alert(1)"><b>kept</a> tail': "<span><b>kept</b></span> tail",
    '<a href="java&#115;cript:x">a</a><a href=" JaVaScRiPt:x">b</a><a href="#top">c</a><a>d</a><a href="data:x">e</a><a href="file://x">f</a>': "".join(f"<span>{c}</span>" for c in "abcdef"),
    '<a href="https://a.example/?a=1&amp;b=2">x</a>': '<a href="https://a.example/?a=1&amp;b=2" target="_blank" rel="noopener noreferrer">x</a>',
    '<td colspan=2 valign="top" bgcolor=red>x</td>': '<td colspan="2" valign="top">x</td>',
    "<": "&lt;", "<p": "&lt;p", "</": "&lt;/", "": "", None: "",
}


def test_what_stays_and_what_goes(spark):
    assert dict(zip(PLAIN_CASES, clean(spark, list(PLAIN_CASES)), strict=True)) == PLAIN_CASES


def test_looks(spark):
    p, li = 'margin:0 0 9px 0', 'margin:0 0 3px 0'
    ink, left = "color:#1a1a1a", "text-align:left"
    cases = {
        "<p>x</p>": f'<p style="{p};{ink};{left}">x</p>',
        '<p style="margin-left:0in;text-align:justify;color:rgb(9,1,0);background-color:red">x</p>': f'<p style="margin-left:0in;{ink};{left}">x</p>',
        "<h2>t</h2>": '<h2 style="margin:12px 0 6px 0;color:#57150B;text-align:left">t</h2>',
        "<ul><li>a</li></ul>": f'<ul style="{p};padding-left:22px"><li style="{li};{ink};{left}">a</li></ul>',
        '<div align=right><span style="color:red;text-align:right">s</span></div>': f'<div style="{ink};{left}"><span>s</span></div>',
        '<div style="text-align:center"><p>short</p></div>': f'<div style="{ink};text-align:center"><p style="{p};{ink};text-align:center">short</p></div>',
        f'<div style="text-align:center"><p>{"long " * 50}</p></div>': f'<div style="{ink};{left}"><p style="{p};{ink};{left}">{"long " * 50}</p></div>',
        '<table><tr><td align="right" style="text-align:right;color:blue">1</td></tr></table>': f'<table style="{p}"><tr><td align="right" style="text-align:right;{ink}">1</td></tr></table>',
        '<figcaption style="text-align:center">c</figcaption>': f'<figcaption style="text-align:center;{ink}">c</figcaption>',
    }
    assert dict(zip(cases, clean(spark, list(cases), markup.Look()), strict=True)) == cases


def test_a_centred_block_counts_its_text_with_single_spaces(spark):
    for words, align in ((" ".join(["abcd"] * 40), "center"), ("  ".join(["abcd"] * 40) + " e", "left")):
        got = clean(spark, [f"<p align=center>\n {words}\n</p>"], markup.Look())[0]
        assert f"text-align:{align}" in got  # 199 and 201 characters


class Seen(HTMLParser):
    """What a browser would make of a page's tags: every element is closed inside the one that holds it."""

    def __init__(self):
        super().__init__()
        self.open, self.bad = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in S.ALLOWED_TAGS or any(k not in {"style", "align", "dir", "lang", "href", "target", "rel", "title", "colspan", "rowspan", "valign", "width", "border", "cellpadding", "cellspacing"} for k, _ in attrs):
            self.bad.append((tag, attrs))
        if tag not in S.VOID_TAGS:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if not self.open or self.open.pop() != tag:
            self.bad.append(tag)


PIECES = (
    "<p>", "</p>", "<p style='text-align:center'>", "<div>", "</div>", "<div align=right>", "<b>", "</b>", "<i>", "</i>", "<a href='x.example/y'>", "<a href='javascript:x'>", "</a>", "<ul>", "</ul>", "<li>", "</li>",
    "<table>", "</table>", "<tr>", "<td align=right>", "</td>", "</tr>", "<br>", "<hr>", "<img src=x>", "<script>", "</script>", "<form>", "</form>", "<svg/>", "<svg>", "</svg>", "<input>", "<font>", "</font>", "<h2>", "</h2>",
    "<blockquote style='margin-left:3px;color:red;padding-left:4px'>", "</blockquote>", "text ", " more  text", "\n", "&nbsp;", "&amp;", "&lt;b&gt;", "<", ">", '"', "<!--", "-->", "<head>", "<body>", "<dl>", "<dt>", "<dd>", "w" * 90 + " ",
)


@pytest.fixture(scope="module")
def soup():
    r = random.Random(11)
    return ["".join(r.choices(PIECES, k=r.randrange(1, 40))) for _ in range(400)]


def test_any_soup_becomes_safe_and_balanced_and_stays_as_it_is(spark, soup):
    for look in (markup.Look(), markup.PLAIN):
        once = clean(spark, soup, look)
        for before, page in zip(soup, once, strict=True):
            seen = Seen()
            seen.feed(page)
            seen.close()
            assert not seen.bad and not seen.open, (before, page)
        assert clean(spark, once, look) == once


def test_faults_see_what_is_wrong(spark):
    bad = ["<p>x</p>", "<script>x</script>", '<p onclick="x">', '<a href="data:x">y</a>', "<p><b>x</p>"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(bad)], "k int, page string")
    got = [tuple(r.f) for r in df.select("k", markup.faults(F.col("page")).alias("f")).orderBy("k").collect()]
    assert got == [(0, 0, 0, 0), (2, 0, 0, 0), (0, 1, 0, 1), (0, 0, 1, 0), (0, 0, 0, 1)]


def test_long_and_deep_pages_take_time_in_proportion():
    deep = ["+div"] * 20_000 + ["."] * 20_000
    assert len(walk(deep, [1] * len(deep), [0] * len(deep), [False] * len(deep))) == 60_000
    empty = ["+div"] * 20_000
    assert walk(empty, [0] * len(empty), [0] * len(empty), [False] * len(empty)) == []


def links(spark, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "k int, page string")
    found = registration.first_of_each(registration.registration_links(df, "page").drop("page"), "k")
    return sorted((r.k, r.position, r.href, r.reason) for r in found.collect())


def test_registration_links(spark):
    a = lambda href, text: f'<a class=c href="{href}">{text}</a>'
    pages = [
        a("https://x.example/", "<b>Register</b> now") + a("https://x.example/rsvp", "more") + a("https://x.example/other", "more"),
        "<p>You may sign up with " + a("https://x.example/f", "this page") + ".</p><p>Unlike " + a("https://x.example/g", "that") + "</p>",
        "<li>(Register for the link)</li><li>" + a("https://x.example/feedback", "feedback") + "</li>",
        "Register " + "x" * 190 + " " + a("https://x.example/near", "a") + "Register " + "x" * 201 + a("https://x.example/far", "b"),
        "<p>Enroll by " + a("mailto:a@x.example", "mail") + " or " + a("http://x.example/?a=1&amp;b=2", "page") + a("http://x.example/?a=1&amp;b=2", "again, tickets"),
        "<p>rsvp<br>" + a("https://x.example/n", "line") + a("https://x.example/é", "ENRÖLL"), None, "", "no link", '<a href="https://x.example/open">tickets<a href="https://x.example/o2">x',
    ]
    assert links(spark, *pages) == [
        (0, 1, "https://x.example/", "anchor"), (0, 2, "https://x.example/rsvp", "address"), (0, 3, "https://x.example/other", "context"), (1, 1, "https://x.example/f", "context"),
        (3, 1, "https://x.example/near", "context"), (4, 2, "http://x.example/?a=1&b=2", "context"), (5, 2, "https://x.example/é", "anchor"), (9, 1, "https://x.example/open", "anchor"),
    ]


def test_first_heading(spark):
    pages = ["<p>x</p><h3 class=c>A &amp; <b>B</b>\n c</h3><h1>later</h1>", "<h1>123</h1>", "<h2>" + "x" * 121 + "</h2>", None, "<h1>never closed"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "k int, page string")
    assert [r.h for r in df.select("k", registration.first_heading(F.col("page")).alias("h")).orderBy("k").collect()] == ["A & B c", None, None, None, None]


def test_first_headings_of_odd_pages_are_those_of_the_sql(spark, tmp_path):
    pages = [
        '<h1>token = &quot;7702&quot;</h1>', "<h2>it&#39;s &nbsp;a &amp;lt; b &lt;i&gt; &amp;amp;</h2>", "<H3\tclass='x'>a\x0bb \xa0 c\r\n</h3>", "<h1é>no</h1><h2>yes</h2>", "<h4><b></b>é</h5>x</h4>", "<h1> &gt; 12 </h1>",
        "<h1>" + "&quot;" * 20 + "x</h1>", "<h1>" + "&amp;" * 119 + "x</h1>", None, "",
    ]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = {r.page_id: r.heading for r in registry.queries()["first_headings"](spark, str(tmp_path)).collect()}
    assert got == dict(con.sql(registry.oracle_sql()["first_headings"]).fetchall())
    assert got[0] == "token = &quot;7702&quot;" and got[6] is None and len(got[7]) == 120
    # by itself the operator decodes quotes, too
    assert spark.createDataFrame([(pages[0],)], "page string").select(registration.first_heading(F.col("page"))).first()[0] == 'token = "7702"'
