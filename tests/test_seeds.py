import pytest

from addrgraph.sources.seeds import SeedFormatError, load_seeds, load_seeds_lenient


def _lines(spark, vals):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "line_no int, line string")


def test_strict_refuses_with_first_three(spark):
    df = _lines(spark, ["https://a.com", "https:// x", "h t", "http://", "https://b.com:99999", "ok.com"])
    with pytest.raises(SeedFormatError) as e:
        load_seeds(df)
    assert str(e.value) == "Invalid URL format: https:// x, h t, http:// ..."


def test_strict_dedupe_ignoring_case(spark):
    df = _lines(spark, ["HTTPS://A.com/x", "https://a.com/x", "a.com/x", "", "http://a.com:80/x", "https://a.com/X#f"])
    got = sorted(tuple(r) for r in load_seeds(df).collect())
    assert got == [(0, "HTTPS://A.com/x"), (4, "http://a.com:80/x"), (5, "https://a.com/X#f")]


def test_lenient(spark):
    df = _lines(spark, ["https://a.com/x#f", "https://a.com/x", "HTTPS://A.com", "", "https://"])
    got = sorted(tuple(r) for r in load_seeds_lenient(df).collect())
    assert got == [(0, "https://a.com/x"), (2, "https://HTTPS://A.com")]


def test_lines_of_white_space_are_blank(spark):
    df = _lines(spark, ["\t", "https://a.com/\r", "\u00a0"])
    assert [tuple(r) for r in load_seeds(df).collect()] == [(1, "https://a.com/")]
