import random
import time
from itertools import combinations

from noticeflow.llm import html_extract as hx

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- c --><div class='ad'>Buy</div>
<article><h1>Head&shy;line &amp; more</h1><p><b>Bold<br>line<p>Second&nbsp;  par <i>x</i>.</p><aside>side</aside><form><p>Mail</p></form><ul><li>one<li>two</ul>
<div id="comments"><p>First!</p></div></article><footer>&copy; x</footer></body></html>"""


def test_article_without_chrome():
    assert [t for t, inside in hx.blocks(PAGE) if inside] == ["Head­line & more", "Bold line", "Second par x.", "one", "two"]
    assert [t for t, _ in hx.blocks(PAGE)] == ["Head­line & more", "Bold line", "Second par x.", "one", "two"]


def test_broken_pages_do_not_crash():
    for p in ("", "<", "<p", "<article><p>a<p>b", "</p></div>x", "<script>never closed", "<a href='x>y", "a < b <b>c</b>", "<table><tr><td>1<td>2<tr><td>3</table>", "<nav>menu<article>x"):
        hx.blocks(p)
    assert [t for t, _ in hx.blocks("<article><p>a<p>b")] == ["a", "b"]
    assert [t for t, _ in hx.blocks("a &lt; b <b>c</b>")] == ["a < b c"]


def test_shared_lines_are_a_longest_common_subsequence():
    r = random.Random(1)
    for _ in range(150):
        a, b = ([r.choice("abc") for _ in range(r.randrange(9))] for _ in range(2))
        got = hx.shared_lines(a, b)
        best = next(k for k in range(min(len(a), len(b)), -1, -1) if {tuple(a[i] for i in c) for c in combinations(range(len(a)), k)} & {tuple(b[i] for i in c) for c in combinations(range(len(b)), k)})
        it = iter(b)
        assert len(got) == best and all(a[i] in it for i in sorted(got))


def test_differencing_decides_unmarked_pages(spark, tmp_path):
    site = "<div>Site name</div><div>Home | News</div>{}<div>All rights reserved</div>"
    rows = [(i, f"http://h.example/a/{i}", site.format(f"<p>Story {i}</p><p>Text of {i}</p>")) for i in range(1, 6)]
    rows += [(10, "http://other.example/x", "<div>alone</div>"), (11, None, None), (12, "::", ""), (13, "http://h.example/b", PAGE), (13, "http://h.example/b", PAGE)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = sorted((tuple(x) for x in hx.op3_html_extract(spark, str(tmp_path)).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by = {x[0]: x for x in got}
    assert len(got) == len(rows)
    assert all(by[i][2] == f"Story {i}\n\nText of {i}" and by[i][3] == len(by[i][2]) for i in range(1, 6))
    assert by[10][2] == "alone" and by[11][2:] == ("", 0) and by[12][2] == "" and by[13][2].startswith("Head")
    assert hx.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def texts(spark, rows, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        return {x.page_id: x.text for x in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_border_and_no_copy_keeps_site_lines(spark, monkeypatch):
    site = "<div>Site name</div><div>Home | News</div>{}<div>All rights reserved</div>"
    story = lambda i: f"<p>Story {i} of a day</p><p>Text of {i}</p>"
    rows = [(i, f"http://h{i % 2}.example/a/{i}", site.format(story(i))) for i in range(1, 9)]
    rows += [(20 + i, "http://h1.example/a/3", site.format(story(3))) for i in range(4)]  # exact copies
    rows += [(30 + i, f"http://h0.example/a/4/{i}", f"<div>Print {i}</div>" + site.format(story(4))) for i in range(5)]  # near copies
    plain = lambda i: f"Story {i} of a day\n\nText of {i}"
    for block, reach, parts in ((2000, 50, 1), (2000, 50, 40), (2, 1, 7)):
        monkeypatch.setattr(hx, "BLOCK_ROWS", block)
        monkeypatch.setattr(hx, "REACH", reach)
        got = texts(spark, rows, parts)
        assert [got[i] for i in range(1, 9)] == [plain(i) for i in range(1, 9)]
        assert {got[20 + i] for i in range(4)} == {plain(3)}
        assert [got[30 + i] for i in range(5)] == [f"Print {i}\n\n{plain(4)}" for i in range(5)]


def test_site_lines_inside_main_go_and_prose_stays(spark):
    page = "<main><div><div>Home</div><div>News</div></div><h2>Report</h2><p>Common opening.</p><p>Story {0} of a day</p><div>Only on {0}</div><div>Site of the day</div></main>"
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(5)] + [(9, "http://alone.example/", page.format(9)), (10, "http://two.example/a", page.format(10)), (11, "http://two.example/b", page.format(11))]
    got = texts(spark, rows, 4)
    assert all(got[i] == f"Report\n\nCommon opening.\n\nStory {i} of a day\n\nOnly on {i}" for i in range(5))
    assert all(got[i].startswith("Home") and got[i].endswith("Site of the day") for i in (9, 10, 11))  # fewer than two others to tell by


def nearest(host, i):
    """The partners of a host's i-th content in path order, none a near copy: after and before, or two of one side."""
    near = lambda j: sum(len(x) for x in host[i][2] & host[j][2]) * 10 >= 9 * max(sum(map(len, host[i][2])), sum(map(len, host[j][2])))
    after, before = [j for j in range(i + 1, len(host)) if not near(j)], [j for j in range(i - 1, -1, -1) if not near(j)]
    found = [x[0] for x in (after, before) if x]
    if len(found) == 1:
        found += (after or before)[1:2]
    return found


def test_pairing_and_alignment_equal_brute_force_on_any_partitions(spark, monkeypatch):
    r = random.Random(5)
    site = [f"site line {i}" for i in range(12)]
    rows, contents = [], {}
    for k in range(60):
        own = [f"story {k} part {j} with some words of its own" for j in range(r.randrange(1, 4))]
        top, foot = [x for x in site[:6] if r.random() < 0.7], [x for x in site[6:] if r.random() < 0.7]
        lines, host, path = top + own + foot, f"h{k % 3}.example", f"/{r.choice('abc')}/{r.randrange(40):02d}"
        rows.append((k, f"https://{host}{path}?q={k}", "".join(f"<div>{x}</div>" for x in lines)))
        contents.setdefault(host, []).append((path, k, set(lines), lines))
    want = {}
    for host in contents.values():
        host.sort(key=lambda x: x[:2])
        for i, (path, k, _, lines) in enumerate(host):
            found = nearest(host, i)
            same = lambda j: next((n for n, (x, y) in enumerate(zip(path, host[j][0], strict=False)) if x != y), min(len(path), len(host[j][0])))  # noqa: B023, E731
            gone = host[max(found, key=same)][2] if found else set()
            want[k] = "\n\n".join(x for x in lines if x not in gone)
    for block, parts in ((2000, 1), (2000, 4), (3, 211)):
        monkeypatch.setattr(hx, "BLOCK_ROWS", block)
        assert texts(spark, rows, parts) == want


def test_names_of_boxes_and_prose_that_only_looks_like_them(spark):
    page = "<article><p>Teaser {0}</p><div class='related-work'><p>Earlier work {0}</p></div><div id='modal-logic'><p>Logic {0}</p></div><div class='commentList'><p>Reader {0}</p></div></article><div><p>Story {0} outside</p></div><div class='ad-slot-2'>Buy {0}</div>"
    got = texts(spark, [(i, f"http://h.example/{i}", page.format(i)) for i in range(3)], 2)
    assert all(got[i] == f"Teaser {i}\n\nEarlier work {i}\n\nLogic {i}\n\nStory {i} outside" for i in range(3))


def test_clashing_columns_and_ties(spark):
    df = spark.createDataFrame([(1, "http://h/a", "<p>x</p>", "a", "b", "c", "d")] * 2, "page_id long, url string, html string, host string, path string, digest string, lines string")
    assert [tuple(x) for x in hx.extract(df).collect()] == [(1, "http://h/a", "x", 1)] * 2


def test_drawings_formulas_and_objects():
    seen = lambda page: [t for t, _ in hx.blocks(page)]
    assert seen('<article><p>first</p><svg class="i"/><p>second paragraph</p></article>') == ["first", "second paragraph"]
    assert seen("<article><p>a</p><svg><path d='x'/><text>drawn</text></svg><p>b</p><svg><g>never closed</article><p>c</p>") == ["a", "b", "c"]
    assert seen("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><math/><p>b</p><object data=x>stands in</object><p>c</p>") == ["so x=2 holds", "b", "stands in", "c"]


def test_a_word_of_prose_as_a_name_deletes_no_prose():
    seen = lambda page: [t for t, _ in hx.blocks(page)]
    assert seen('<main><section id="discussion"><h2>Discussion</h2><p>We find...</p></section><p id="discussion">p</p><p class="notice">n</p></main>') == ["Discussion", "We find...", "p", "n"]
    assert seen('<article><p>a</p><div class="notice">Closed today</div><div id="comments"><p>First!</p></div><div class="reply-list">r</div></article><div id="discussion">d</div>') == ["a"]


def test_both_alignments_are_longest_and_repeated_lines_take_time_in_proportion():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(14))] for _ in range(2))
        one, two = sorted(hx._aligned_pairs(a, b)), sorted(hx._aligned_bits(a, b))
        assert len(one) == len(two)
        for found in (one, two):
            it = iter(b)
            assert all(a[i] in it for i in found)
    a, b = ["x", "y"] * 10_000, ["y", "x", "z"] * 7_000
    at = time.monotonic()
    assert len(hx.shared_lines(a, b)) == 14_000
    assert len(hx._lines("<x a " * 100_000)) == 1
    assert time.monotonic() - at < 20


def test_what_each_part_deletes_on_the_given_pages(spark):
    """On these pages markup finds all that goes; see the README."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    by_markup = {x.page_id: "\n\n".join(t for t, _ in hx.blocks(x.html)) for x in pages.collect()}
    assert {x.page_id: x.text for x in hx.extract(pages).collect()} == by_markup
