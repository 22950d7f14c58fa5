"""Address pattern, checks and decoding: SURVEY 2.13 vectors and randomised
comparison with Python's ``re`` (which supports the same look-around)."""

import random
import re

import pytest
from pyspark.sql import functions as F

from addrgraph.functions import text as T

PY_EMAIL = re.compile(r"(?<![A-Z0-9._%+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}(?![A-Z0-9._%+-])", re.I | re.A)

VECTORS = [
    ("mail a@b.com. end", []),
    ("a@b.com, c@d.co.uk;", ["a@b.com", "c@d.co.uk"]),
    ("x@y.com_z", []),
    ("a@b@c.com", ["b@c.com"]),
    ("a@b.com@c.com", ["a@b.com"]),
    ("&lt;q@w.net&gt;", ["q@w.net"]),
    (".a@b.com", [".a@b.com"]),
    ("a.@b.com", ["a.@b.com"]),
    ("a@.b.com", ["a@.b.com"]),
    ("a..b@c.com", ["a..b@c.com"]),
]


def _one(spark, col, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_pattern_vectors(spark):
    got = _one(spark, T.email_matches(F.col("t"), decode=False), [v for v, _ in VECTORS])
    assert [list(g) for g in got] == [e for _, e in VECTORS]


def test_decode_vectors(spark):
    vals = ["joe&#64;x&#46;org", "j&#x40;x.org", "&amp;#64;", "&#0;&#xD800;&#1114112;", "a&#65;&#x42;c", "&#64"]
    got = _one(spark, T.decode_html(F.col("t")), vals)
    assert got == ["joe@x.org", "j@x.org", "&#64;", "&#0;&#xD800;&#1114112;", "aABc", "&#64"]
    raw = _one(spark, T.email_matches(F.col("t"), decode=False), vals[:2])
    assert [list(r) for r in raw] == [[], []]
    dec = _one(spark, T.page_emails(F.col("t"), decode=True), vals[:2])
    assert [list(r) for r in dec] == [["joe@x.org"], ["j@x.org"]]


def test_checks(spark):
    vals = [".a@b.com", "a.@b.com", "a@.b.com", "a..b@c.com", "a@b.com", "a@b", "@b.com", "a@b.com.", "x" * 250 + "@b.com"]
    basic = _one(spark, T.valid_email(F.col("t"), "basic"), vals)
    strict = _one(spark, T.valid_email(F.col("t"), "strict"), vals)
    assert basic == [True, True, False, False, True, False, False, False, False]
    assert strict == [False, True, False, False, True, False, False, False, False]


def test_normalize_email(spark):
    vals = ["User1@Example.com>,", " u@.example.com ", "x@y@example.com", "a..b@example.com", "no-at.example.com"]
    assert _one(spark, T.normalize_email(F.col("t")), vals) == ["user1@example.com", None, None, None, None]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_against_python_re(spark, seed):
    rnd = random.Random(seed)
    alphabet = "ab@.-_ ,;<com&xZ9%+"
    vals = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    got = _one(spark, T.email_matches(F.col("t"), decode=False), vals)
    for v, g in zip(vals, got):
        assert list(g) == PY_EMAIL.findall(v), v


def test_page_emails_distinct_lower(spark):
    got = _one(spark, T.page_emails(F.col("t")), ["A@B.com a@b.COM c@d.org"])
    assert list(got[0]) == ["a@b.com", "c@d.org"]


def test_one_pass_decoding_and_names(spark):
    vals = ["&#38;lt;", "&amp;#64;", "/c&eacute;", "&bogus; & &", "&amp;amp;", "&apos;&quot;&nbsp;x", "&lt&gt;", "&#x26;#64;"]
    got = _one(spark, T.decode_html(F.col("t")), vals)
    assert got == ["&lt;", "&#64;", "/c\u00e9", "&bogus; & &", "&amp;", "'\"\u00a0x", "&lt>", "&#64;"]


def test_white_space_of_any_kind_is_trimmed(spark):
    vals = ["\ta@b.com\n", "\u00a0a@b.com\u2003", "\r\n", " a@b.com\x0b"]
    assert _one(spark, T.normalize_email(F.col("t")), vals) == ["a@b.com", "a@b.com", None, "a@b.com"]
