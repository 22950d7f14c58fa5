import pytest

from addrgraph.operators.enrich import load_suffix_rules, registrable_domains, selected_sources, target_domain


def test_public_suffix_longest_match(spark):
    hosts = spark.createDataFrame([("a.b.example.co.uk",), ("www.Example.com",), ("co.uk",), ("h.local",),
                                   ("10.0.0.1",)], "host string")
    sfx = spark.createDataFrame([("uk",), ("co.uk",), ("com",)], "suffix string")
    got = dict(map(tuple, registrable_domains(hosts, sfx).collect()))
    assert got == {"a.b.example.co.uk": "example.co.uk", "www.example.com": "example.com", "co.uk": "co.uk",
                   "h.local": "h.local", "10.0.0.1": "10.0.0.1"}


def test_target_domain_first_seed_with_host(spark):
    seeds = spark.createDataFrame([(3, "https://x.example.co.uk/a"), (1, "https:///nohost"), (2, "https://w.Shop.co.uk")],
                                  "seed_rank int, url string")
    sfx = spark.createDataFrame([("co.uk",)], "suffix string")
    assert target_domain(seeds, suffixes=sfx).first()[0] == "shop.co.uk"
    assert target_domain(seeds).first()[0] == "co.uk"
    empty = spark.createDataFrame([], "seed_rank int, url string")
    assert target_domain(empty).first()[0] == ""


def test_selected_sources():
    assert selected_sources(None)[0] == "crtsh" and len(selected_sources([])) == 6
    assert selected_sources([" THC ", "nosuch", "thc", "crtsh"]) == ["thc", "crtsh"]
    assert selected_sources(["nosuch"]) == []


RULES = ["// list", "com", "*.ck", "!www.ck", "jp", "ac.jp", "kyoto.jp", "ide.kyoto.jp", "*.kobe.jp", "!city.kobe.jp",
         "us", "ak.us", "k12.ak.us", "co.uk // note", "  ", "*.compute.example.com"]
# Name and its registrable domain; names without one follow the two-label rule.
VECTORS = [("example.com", "example.com"), ("b.Example.com", "example.com"), ("test.ck", "test.ck"), ("b.test.ck", "b.test.ck"),
           ("a.b.test.ck", "b.test.ck"), ("www.ck", "www.ck"), ("www.www.ck", "www.ck"), ("jp", "jp"), ("test.jp", "test.jp"),
           ("www.test.ac.jp", "test.ac.jp"), ("kyoto.jp", "kyoto.jp"), ("b.ide.kyoto.jp", "b.ide.kyoto.jp"),
           ("a.b.ide.kyoto.jp", "b.ide.kyoto.jp"), ("b.c.kobe.jp", "b.c.kobe.jp"), ("a.b.c.kobe.jp", "b.c.kobe.jp"),
           ("city.kobe.jp", "city.kobe.jp"), ("www.city.kobe.jp", "city.kobe.jp"), ("www.test.k12.ak.us", "test.k12.ak.us"),
           ("k12.ak.us", "ak.us"), ("a.b.co.uk", "b.co.uk"), ("v.z.compute.example.com", "v.z.compute.example.com"),
           ("u.v.z.compute.example.com", "v.z.compute.example.com"), ("compute.example.com", "example.com"),
           ("a.b.unlisted", "b.unlisted"), ("ck", "ck"), ("192.168.0.1", "192.168.0.1"), ("[2001:db8::1]", "[2001:db8::1]")]


def test_wildcard_and_exception_rules(spark):
    rules = load_suffix_rules(spark.createDataFrame([(x,) for x in RULES], "line string"))
    assert rules.count() == len(RULES) - 2
    hosts = spark.createDataFrame([(h,) for h, _ in VECTORS] + [(None,), ("www.ck",)], "host string")
    got = dict(map(tuple, registrable_domains(hosts, rules).collect()))
    assert got == {h.lower(): d for h, d in VECTORS}


@pytest.mark.parametrize("rules", [[], ["*"], ["!a.b"]])
def test_few_rules(spark, rules):
    sfx = spark.createDataFrame([(r,) for r in rules], "suffix string")
    hosts = spark.createDataFrame([("x.a.b",), ("a.b",), ("b",)], "host string")
    want = {"x.a.b": "a.b", "a.b": "a.b", "b": "b"}
    assert dict(map(tuple, registrable_domains(hosts, sfx).collect())) == want
