"""Enrichment: addresses and hosts from discovery tables merged into a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrgraph.functions.common import let, strip_ws
from addrgraph.functions.text import normalize_email
from addrgraph.functions.urls import host_of, in_domain, normalize_host, normalize_url, registrable_domain

# ---------------------------------------------------------------------------
# The discovery sources known by name, in default order.
DEFAULT_SOURCES = ["crtsh", "rapiddns", "waybackarchive", "commoncrawl", "thc", "duckduckgo"]
# Source URL given to addresses that came from discovery (our literal):
ENRICHMENT_SOURCE_URL = "discovery://enrichment"
# ---------------------------------------------------------------------------


def selected_sources(requested: list[str] | None) -> list[str]:
    """F7 / J5 on the request list: lower-cased, trimmed, unknown names dropped;
    nothing requested -> the defaults; nothing valid -> empty."""
    req = [s.strip().lower() for s in (requested or []) if s and s.strip()]
    if not req:
        return list(DEFAULT_SOURCES)
    out: list[str] = []
    for s in req:
        if s in DEFAULT_SOURCES and s not in out:
            out.append(s)
    return out


def filter_sources(discovery: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """F7.  Discovery records of the selected sources only."""
    return discovery.filter(F.col("source").isin(selected_sources(requested)))


def filter_hosts_in_domain(hosts: DataFrame, target_domain: str, host_col: str = "host") -> DataFrame:
    """F6.  Hosts equal to the target domain or below it (all when empty)."""
    return hosts.filter(in_domain(F.col(host_col), F.lit((target_domain or "").strip().lower())))


def accepted_records(discovery: DataFrame, target_domain: str,
                     requested: list[str] | None = None) -> DataFrame:
    """Normalised discovery values that pass their rule: ``rec_id, source, kind, value``.

    Addresses go through P3, hosts through P10 and F6.  Records of unknown or
    unselected sources, and everything when the target domain is empty, drop.
    """
    d = (target_domain or "").strip().lower()
    if not d:
        return discovery.limit(0).select("rec_id", "source", "kind", "value")
    recs = filter_sources(discovery, requested)
    val = (F.when(F.col("kind") == "email", normalize_email(F.col("value")))
           .when(F.col("kind") == "host",
                 let(normalize_host(F.col("value")), lambda h: F.when(in_domain(h, F.lit(d)), h))))
    return recs.select("rec_id", "source", "kind", val.alias("value")).filter(F.col("value").isNotNull())


def enrichment_counts(spark: SparkSession, discovery: DataFrame, target_domain: str,
                      requested: list[str] | None = None) -> DataFrame:
    """A3.  Per selected source: accepted address and host values (not distinct).

    The source list is a literal table of at most six rows; sources without
    records report zeros.
    """
    names = selected_sources(requested) if (target_domain or "").strip() else []
    src = spark.createDataFrame([(i, s) for i, s in enumerate(names)], "source_order int, source string")
    acc = accepted_records(discovery, target_domain, requested)
    counts = acc.groupBy("source").agg(F.count_if(F.col("kind") == "email").alias("emails"),
                                      F.count_if(F.col("kind") == "host").alias("hosts"))
    return (src.join(counts, "source", "left")
            .select("source_order", "source", F.coalesce("emails", F.lit(0)).alias("emails"),
                    F.coalesce("hosts", F.lit(0)).alias("hosts")))


def enrichment_sets(discovery: DataFrame, target_domain: str, requested: list[str] | None = None) -> DataFrame:
    """A4.  Distinct accepted values over all sources: ``kind, value``."""
    return accepted_records(discovery, target_domain, requested).select("kind", "value").distinct()


def sorted_enrichment_emails(discovery: DataFrame, target_domain: str,
                             requested: list[str] | None = None) -> DataFrame:
    """L5.  Distinct accepted addresses, ascending."""
    s = enrichment_sets(discovery, target_domain, requested)
    return s.filter(F.col("kind") == "email").select(F.col("value").alias("email")).orderBy("email")


def hosts_to_seeds(hosts: DataFrame, host_col: str = "host") -> DataFrame:
    """P11.  ``https://`` + host, in host order."""
    return hosts.select(F.col(host_col).alias("host"),
                        F.concat(F.lit("https://"), F.col(host_col)).alias("url")).orderBy("host")


def cap_enrichment_seeds(discovery: DataFrame, target_domain: str, cap: int = 250,
                         requested: list[str] | None = None) -> DataFrame:
    """L4 (+P11).  The first ``cap`` accepted hosts in sorted order, as seed URLs,
    with their 1-based ``host_rank``.  The cap is the feature (a top-k)."""
    hosts = (enrichment_sets(discovery, target_domain, requested)
             .filter(F.col("kind") == "host").select(F.col("value").alias("host")))
    top = hosts.orderBy("host").limit(max(1, int(cap)))
    from pyspark.sql import Window

    # At most ``cap`` rows here, so one ordered window is bounded.
    return top.select("host", F.concat(F.lit("https://"), F.col("host")).alias("url"),
                      F.row_number().over(Window.orderBy("host")).alias("host_rank"))


def add_enrichment_seeds(seeds: DataFrame, host_seeds: DataFrame) -> DataFrame:
    """U1.  Seeds then host seeds, re-normalised (P8) and deduped by exact text,
    first wins.  Output ``seed_rank, url``; host seeds rank after every seed."""
    # One scalar: the last seed rank, so host seeds sort after every seed.
    offset = seeds.select(F.max("seed_rank")).first()[0]
    offset = -1 if offset is None else int(offset)
    u = (seeds.select("seed_rank", "url")
         .unionByName(host_seeds.select((F.col("host_rank") + F.lit(offset)).cast(seeds.schema["seed_rank"].dataType)
                                        .alias("seed_rank"), "url")))
    u = u.select("seed_rank", normalize_url(F.col("url")).alias("url")).filter(F.col("url").isNotNull())
    return u.groupBy("url").agg(F.min("seed_rank").alias("seed_rank")).select("seed_rank", "url")


def add_enrichment_hits(hits: DataFrame, emails: DataFrame) -> DataFrame:
    """U2.  Discovery addresses in front of page hits: ``page_id`` -1, no time,
    source URL ``discovery://enrichment``; they win "first source"."""
    cols = hits.columns
    e = emails.select(F.lit(-1).cast("long").alias("page_id"), F.lit(ENRICHMENT_SOURCE_URL).alias("source_url"),
                      F.col("email"))
    if "seen_at" in cols:
        e = e.withColumn("seen_at", F.lit(None).cast(hits.schema["seen_at"].dataType))
    return e.select(*cols).unionByName(hits.select(*cols))


def load_suffix_rules(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Rules (column ``suffix``) from the lines of a public-suffix list: the text up to the first
    white space; blank lines and ``//`` comments are skipped."""
    rule = F.split(strip_ws(F.col(line_col)), r"\s", 2)[0]
    return lines.select(F.lower(rule).alias("suffix")).filter((F.length("suffix") > 0) & ~F.col("suffix").startswith("//"))


def suffix_rules(suffixes: DataFrame) -> DataFrame:
    """Rules as a table ``key, exception``: ``!`` marks an exception; a key may begin with the label ``*``."""
    rule = F.lower(strip_ws("suffix"))
    exception = rule.startswith("!")
    key = F.regexp_replace(rule, r"^!?\.?", "")
    return (suffixes.select(key.alias("key"), exception.alias("exception")).filter(F.length("key") > 0)
            .groupBy("key").agg(F.max("exception").alias("exception")))


def registrable_domains(hosts: DataFrame, suffixes: DataFrame, host_col: str = "host") -> DataFrame:
    """P9 with public-suffix rules: ``host, domain`` for each distinct host.

    ``suffixes`` has a rule per row (column ``suffix``): a literal suffix; one whose first
    label is ``*``, which stands for any one label; or an exception ``!suffix``, which takes
    a name out of a wildcard's reach.  The rules are a trie over reversed labels, kept as a
    table of its paths: every tail of a host, and every tail with its first label replaced
    by ``*``, meets the rules in one join by text.  A matching exception decides (its suffix
    is the rule without its first label), else the match of most labels.  The domain is the
    suffix and one label more.  Hosts with no match, or that are a suffix themselves, follow
    the two-label rule; addresses in numbers match nothing.  Hosts are made distinct before
    their tails are exploded.
    """

    h = hosts.select(F.lower(strip_ws(F.col(host_col))).alias("host")).filter(F.col("host").isNotNull()).distinct()
    labels = F.split(F.col("host"), r"\.", -1)
    n = F.size(labels)
    tails = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        i.alias("i"), F.array_join(F.slice(labels, i, n), ".").alias("key")))
    wild = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        i.alias("i"), F.array_join(F.concat(F.array(F.lit("*")), F.slice(labels, i + 1, n)), ".").alias("key")))
    named = h.filter(~F.col("host").rlike(r"(^|\.)[0-9]+$|[\[\]:]"))
    cand = named.select("host", F.inline(F.concat(tails, wild)))
    starts = cand.join(suffix_rules(suffixes), "key").groupBy("host").agg(
        F.min(F.when(F.col("exception"), F.col("i") + 1)).alias("excepted"),
        F.min(F.when(~F.col("exception"), F.col("i"))).alias("listed"))
    best = starts.select("host", F.coalesce("excepted", "listed").alias("i"))
    lab = F.split(F.col("host"), r"\.", -1)
    domain = F.array_join(F.slice(lab, F.greatest(F.col("i") - 1, F.lit(1)), F.size(lab)), ".")
    return h.join(best, "host", "left").select("host", F.when(F.col("i") > 1, domain).otherwise(
        registrable_domain(F.col("host"))).alias("domain"))


def target_domain(seeds: DataFrame, url_col: str = "url", suffixes: DataFrame | None = None) -> DataFrame:
    """P9.  One row ``target_domain``: the registrable domain of the first seed
    (by ``seed_rank``) that has a host; '' when none has.  Without a
    public-suffix table the two-label rule applies (an IPv4 host stays whole)."""
    h = seeds.select("seed_rank", host_of(F.col(url_col)).alias("host")).filter(F.col("host").isNotNull())
    if suffixes is not None:
        h = h.join(registrable_domains(h, suffixes), "host", "left").select(
            "seed_rank", F.coalesce("domain", registrable_domain(F.col("host"))).alias("d"))
    else:
        h = h.select("seed_rank", registrable_domain(F.col("host")).alias("d"))
    return h.agg(F.coalesce(F.min_by("d", F.col("seed_rank")), F.lit("")).alias("target_domain"))
