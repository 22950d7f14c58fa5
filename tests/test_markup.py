"""P5's tokenizer against the standard library's HTML parser, and against hand-made cases."""

import random
from html import unescape
from html.parser import HTMLParser

import pytest

from addrgraph.functions.markup import link_values, unquoted
from addrgraph.operators.extract import extract_anchor_links


def values(spark, pages):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(pages)], "i int, html string")
    from pyspark.sql import functions as F

    rows = df.select("i", F.transform(link_values("html"), unquoted).alias("v")).collect()
    return [r.v for r in sorted(rows)]


CASES = [
    ('<a data-href="/x" href="/y">', ["/y"]),
    ('<a title="href=/z" href="/w">', ["/w"]),
    ("<!-- <a href='/c'> --><a href=/d>", ["/d"]),
    ("<script>x = '<a href=/s>'; if (a > b) {}</script><a href=/t>", ["/t"]),
    ('<a class="a > b" href="/g">', ["/g"]),
    ("<A HREF = '/up' ><AREA\nhref=/area/>", ["/up", "/area/"]),
    ('<a href="/1" href="/2">', ["/1"]),
    ("<a href><a href=><a href=''><a>", [""]),
    ("<abbr href=/x><link href=/y><ahref=/z><a-b href=/q>", []),
    ("<a/href=/slash><a\thref=/tab\x0chref=/no>", ["/slash", "/tab"]),
    ('<a title=it\'s href=/apos><a title="x"href=/near>', ["/apos", "/near"]),
    ('<a href="/never closed>', []),
    ("<a href=/open", []),
    ("<!-- never closed <a href=/x>", []),
    ("<!--><a href=/x><!---><a href=/y><!-- --!><a href=/z>", ["/x", "/y", "/z"]),
    ("<script/><a href=/x>", []),
    ("<SCRIPT>a</scripty><a href=/x></ScRiPt ><a href=/y>", ["/y"]),
    ("<textarea><a href=/x></textarea><title><a href=/t></title><style><a href=/s></style>", []),
    ("<!doctype html <a href=/x><?php <a href=/x>?><a href=/y>", ["/y"]),
    ("1 < 2 <a href=/x> </ a><a href=/y></><a href=/z>", ["/x", "/y", "/z"]),
    ("</a href=/end><a =href=/q><a hrefs=/r href=/h>", ["/h"]),
    ('<img alt="<a href=/img>"><p title=\'<a href="/p">\'>', []),
    (None, []), ("", []), ("href", []),
]


def test_cases(spark):
    want = [[v for v in w] for _, w in CASES]
    assert values(spark, [h for h, _ in CASES]) == want


class Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "area"):
            own = [v for k, v in attrs if k == "href"]
            if own and own[0]:
                self.found.append(own[0])


def page(r):
    name = lambda: r.choice(["href", "HREF", "data-href", "title", "class", "xhref", "hrefx", "alt"])
    inner = lambda: r.choice(["/a", "x y", "href=/v", "a > b", "<a href=/q>", "<!-- c", "--", "&amp;", "k=1", "/p?q=2&r=3"])

    def attribute():
        kind = r.randrange(4)
        if kind == 0:
            return name()
        if kind == 1:
            return f'{name()}{r.choice(["=", " = "])}"{inner()}"'
        if kind == 2:
            return f"{name()}='{inner()}'"
        return f"{name()}={r.choice(['/u', 'u.html', '/n?x=1', 'v-w'])}"

    def piece():
        kind = r.randrange(10)
        if kind == 0:
            return f"<!-- {inner()} -->"
        if kind == 1:
            e = r.choice(["script", "style"])
            return f"<{e} {attribute()}>{inner()} <a href=/in> </{e}>"
        if kind == 2:
            return inner().replace("<", "&lt;")
        e = r.choice(["a", "A", "area", "p", "abbr", "link", "img"])
        return f"<{e} {' '.join(attribute() for _ in range(r.randrange(4)))}>"

    return "".join(piece() for _ in range(r.randrange(1, 14)))


def test_random_markup_equals_a_parser(spark):
    r = random.Random(11)
    pages = [page(r) for _ in range(1500)]
    want = []
    for p in pages:
        parser = Links()
        parser.feed(p)
        parser.close()
        want.append(parser.found)
    # the parser decodes references in values; the column holds them as written
    got = [[unescape(v) for v in own] for own in values(spark, pages)]
    assert got == want
    assert sum(map(len, want)) > 500


@pytest.mark.parametrize("html", [
    "<a " + "x='y' " * 200_000 + "href=/end>", "<!--" + "-" * 500_000 + "--><a href=/end>",
    "<script>" + "</scrip " * 100_000 + "</script><a href=/end>", "<" * 300_000 + "<a href=/end>"])
def test_long_tokens(spark, html):
    assert values(spark, [html]) == [["/end"]]


def test_unique_per_page_with_blocked_extensions(spark):
    html = ('<a href="/t#a">1</a><a href="/i.PNG">2</a><!--<a href="/c">--><area href="/T">'
            '<a data-href="/d" href="b/../u?x=1&amp;y=2">3</a><a href="mailto:x@y.z">')
    df = spark.createDataFrame([(1, "https://h.example.com/d/p", html)], "page_id long, url string, html string")
    rows = sorted((r.pos, r.dst_url) for r in extract_anchor_links(df).collect())
    assert rows == [(0, "https://h.example.com/t"), (3, "https://h.example.com/d/u?x=1&y=2")]
