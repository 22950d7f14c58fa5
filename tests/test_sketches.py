"""Distinct addresses by sketches: united parts equal the whole, errors stay within what is stated."""

from pyspark.sql import functions as F

from addrgraph.operators.report import SKETCH_ERROR, email_sketches, estimated_emails, unite_sketches
from addrgraph.session import write_through


def test_sketches_unite(spark):
    hits = spark.range(60_000).select(F.concat(F.lit("u"), F.col("id") % 23_000).alias("email"), (F.col("id") % 7).alias("day"),
                                      (F.col("id") % 3).alias("host"))
    stored = write_through(email_sketches(hits, ["day", "host"]), "sketches")
    for keys in (["day"], ["host"], []):
        exact = {tuple(r)[:-1]: r.n for r in hits.groupBy(*keys).agg(F.count_distinct("email").alias("n")).collect()}
        parts = {tuple(r)[:-1]: r.unique_emails_estimate for r in estimated_emails(unite_sketches(stored, keys)).collect()}
        whole = {tuple(r)[:-1]: r.unique_emails_estimate for r in estimated_emails(email_sketches(hits, keys)).collect()}
        assert set(parts) == set(exact)
        for k, n in exact.items():
            assert abs(parts[k] - n) <= SKETCH_ERROR * n and abs(whole[k] - n) <= SKETCH_ERROR * n


def test_later_days_are_added(spark):
    """A day that comes later is united with the stored ones, without their addresses."""
    day = lambda d: spark.range(d * 500, d * 500 + 800).select(
        F.concat(F.lit("u"), "id").alias("email"), F.lit(d).alias("day"))
    stored = write_through(email_sketches(day(0), ["day"]), "sketches")
    for d in range(1, 4):
        stored = write_through(stored.unionByName(email_sketches(day(d), ["day"])), "sketches")
    n = estimated_emails(unite_sketches(stored, [])).first()[0]
    assert abs(n - 2300) <= SKETCH_ERROR * 2300 and stored.count() == 4


def test_no_hits(spark):
    assert estimated_emails(email_sketches(spark.createDataFrame([], "email string, day int"), ["day"])).count() == 0
