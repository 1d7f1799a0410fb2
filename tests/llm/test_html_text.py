import random
import re
import time
from html.parser import HTMLParser

import pytest

from vecgrove.llm.html_text import extract, html_to_text

CASES = {
    "<p>a  b\n c</p>": "a b c",
    "<p>one<p>two": "one\n\ntwo",
    "<div>a</div><div>b</div>": "a\nb",
    "a<br>b": "a\nb",
    "<h1>T</h1>text": "T\n\ntext",
    "<ul><li>a<li>b<ul><li>c</ul></ul>x": "- a\n- b\n  - c\n\nx",
    "<ol start=3><li>a</li><li>b</li></ol>": "3. a\n4. b",
    "<table><tr><th>name<th>n<tr><td>a<td>10<tr><td>longer<td>2</table>": "name    n\na       10\nlonger  2",
    "<table><tr><td colspan=2>wide cell<td>x<tr><td>a<td>b<td>c</table>": "wide cell  x\na  b  c",
    "<table><td>no row</table>": "no row",
    "<table><tr><td><p>a<p>b<td><table><tr><td>in<td>ner</table></table>": "a  in  ner\n\nb",
    "<pre>\n a\n  b</pre>": " a\n  b",
    "<head><title>t</title><style>p{}</style></head><script>var a='</p><p>x'</script>b": "b",
    "a<span hidden>b</span><b style='display: none'>c</b><i style='visibility:hidden'>d<u style='visibility:visible'>e</u></i>": "ae",
    "&lt;b&gt; &amp; &eacute;&nbsp;x": "<b> & é\xa0x",
    "1 < 2 <3": "1 < 2 <3",
    "<!-- a > b --><a href='x>y' title=\"</a>\">link</a><![CDATA[c]]>": "linkc",
    "x<b>y</b> z<i> w</i>": "xy z w",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "<noscript>n</noscript><template>t</template><textarea>a &lt; b</textarea>v": "a < bv",
    "</div></p>a": "a",
    "<p>a<div>b</p>c": "a\n\nb\n\nc",
    "a<unfinished": "a",
    "<select><option>a<option>b</select>c": "a\nb\nc",
    "": "",
    # spans over rows and columns
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<table><tr><td>aa<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f<td>g<tr><td>h<td>i<td>j</table>": "aa  b  c\nd      e\nf      g\nh   i  j",
    "<table><tr><td rowspan=2 colspan=2>ab<td>c<tr><td>d<tr><td>1<td>2<td>3</table>": "ab    c\n      d\n1  2  3",
    "<table><tr><td colspan=1000>all<tr><td>a<td>b</table>": "all\na  b",
    "<table><tr><td rowspan=0>a<td rowspan=x>b<td colspan=99999999>c<tr><td>d</table>": "a  b  c\nd",
    # blocks and lists within cells
    "<table><tr><td><p>para<p>one<td><ul><li>x<li>y</ul></table>": "para  - x\n      - y\none",
    "<table><tr><td><p>para<p>two</table>": "para\n\ntwo",
    "<table><tr><td><pre>a  b\n c</pre><td>d</table>": "a  b  d\n c",
    "<table><tr><td>a<tr><td><tr><td>b</table>": "a\nb",
    # wide cells are aligned too
    f"<table><tr><td>{'w' * 60}<td>x<tr><td>a<td>y</table>": f"{'w' * 60}  x\na{' ' * 61}y",
    "<math><mi>x</mi><annotation>tex</annotation></math><svg><desc>d</desc><text>t</text></svg>": "xt",
    "<a title = 'x > y' b=\"'>\" c>in</a>": "in",
}


@pytest.mark.parametrize("html", CASES)
def test_cases(html):
    assert html_to_text(html) == CASES[html]


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.off, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("head", "script", "style", "title")

    def handle_endtag(self, tag):
        self.off -= tag in ("head", "script", "style", "title")

    def handle_data(self, data):
        if not self.off:
            self.out.append(data)


def test_all_visible_text_of_the_pages(spark, sf):
    """No word is lost or made up, in order, list markers aside."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    out = extract(pages).collect()
    assert len(out) == len(html)
    for r in out:
        p = Plain()
        p.feed(html[r["id"]])
        want = re.sub(r"\s", "", "".join(p.out))
        got = re.sub(r"\s", "", re.sub(r"(?m)^ *(?:- |[0-9]+\. )", "", r["text"]))
        assert got == re.sub(r"(?m)^ *(?:- |[0-9]+\. )", "", want), r["id"]
        assert r["n_chars"] == len(r["text"])


def test_long_and_broken_pages_take_linear_time():
    began = time.time()
    for html in ("<div>" * 50_000 + "x", "<p>" * 50_000, "<a b='" * 20_000, "<" * 100_000, "<li>" * 50_000, "<table><tr><td>" * 5_000 + "x", "<b " * 50_000, "&" * 100_000, "</p>" * 50_000, "<!--" * 50_000):
        html_to_text(html)
    for n in (50_000, 100_000):
        html_to_text(f"<p {' '.join(f'a{i}="v > {i}"' for i in range(n))}>x" + "<b class='c' id=\"d\">y</b>" * n)
        html_to_text("<table>" + "<tr><td colspan=1000>a<td>b" * (n // 4) + "</table>")
        html_to_text("<table><tr>" + "<td rowspan=60000>a" * (n // 20) + "<tr><td>b" * (n // 20) + "</table>")
        html_to_text("<table>" + "<tr><td>a<td>b" * (n // 10) + f"<tr><td>{'w' * n}<td>c</table>")
    assert time.time() - began < 60
    rng = random.Random(1)
    for _ in range(300):
        html_to_text("".join(rng.choice(["<p>", "</p>", "<td>", "<tr>", "<table>", "</table>", "<li>", "<ul>", "</ul>", "<pre>", "</pre>", "x ", "<br>", "<b", "'", '"', ">", "<dd>", "</td>"]) for _ in range(60)))


def test_padding_stays_in_proportion():
    """One very wide cell does not widen the other rows without bound."""
    rows = "".join(f"<tr><td>{'w' * 500_000 if i == 7 else 'abcdefgh'}<td>{i}" for i in range(3000))
    assert len(html_to_text(f"<table>{rows}</table>")) < 30 * len(rows)


def test_five_megabytes_of_attributes():
    times = []
    for n in (60_000, 120_000):
        html = "<p>" + "".join(f"<a href=\"/x?a={i}&b='>'\" title='t > {i}'>w</a>" for i in range(n))
        began = time.time()
        assert html_to_text(html) == "w" * n
        times.append(time.time() - began)
    assert times[1] < 5 * times[0] + 1


def test_edges(spark):
    pages = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "<p>a", "z"), (3, "<p>a", "z"), (None, "<p>b", "z")], "page_id bigint, html string, text string")
    out = sorted(((r["id"], r["text"], r["n_lines"]) for r in extract(pages).collect()), key=repr)
    assert out == sorted([(1, "", 0), (2, "", 0), (3, "a", 1), (3, "a", 1), (None, "b", 1)], key=repr)
    assert extract(pages.limit(0)).count() == 0


def test_upper_case_ends_and_displayed_elements():
    assert html_to_text("<p>\u0130<SCRIPT>x</SCRIPT><Style>y</STYLE><TITLE>z</TITLE>seen") == "\u0130seen"
    page = "<p>a</p><svg><text>e</text></svg><math><mi>f</mi></math>"
    text = html_to_text(page)
    assert all(x in text for x in ("a", "e", "f"))
