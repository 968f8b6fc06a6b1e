"""What the bands of the license scan retrieve when every window is hashed, none passed over."""

import os

import pytest
from pyspark.sql import functions as F

from waymark.llm import license_scan, queries
from waymark.llm.common import shingle_hashes, words

SF = "/root/testdata/sf0.001"


def by_bands_alone(docs, licenses):
    """(rows as of scan(), number of windows): all windows of all lengths, met with templates by their bands only."""
    size = license_scan.SHINGLE_WORDS - 1
    known = licenses.select("license", shingle_hashes(words(F.col("text")), size + 1).alias("own"), F.size(words(F.col("text"))).alias("n"))
    hashed = docs.select("doc_id", shingle_hashes(words(F.col("text")), size + 1).alias("all")).where(F.size("all") > 0)
    step = F.greatest(F.lit(1), F.floor(F.col("n") / license_scan.STEPS)).cast("int")
    laid = hashed.crossJoin(F.broadcast(known.select("n").distinct()))  # a test of a few documents
    laid = laid.select("*", F.explode(F.sequence(F.lit(0), F.size("all") - 1, step)).alias("start"))
    slack = F.ceil(F.col("n") / 5).cast("int")
    begin = F.greatest(F.lit(0), F.col("start") - slack)
    wide = F.slice("all", begin + 1, F.col("start") - begin + F.col("n") - size + slack)
    laid = laid.select("doc_id", "n", "start", F.slice("all", F.col("start") + 1, F.col("n") - size).alias("inside"), wide.alias("wide"))
    theirs = known.select("license", F.col("n").alias("t"), "own", F.explode(license_scan.signature(F.col("own"))).alias("b"))
    ours = laid.select("*", F.explode(license_scan.signature(F.col("inside"))).alias("a"))
    met = ours.join(F.broadcast(theirs), (F.col("a.band") == F.col("b.band")) & (F.col("a.least") == F.col("b.least")) & (F.col("n") == F.col("t")))
    share = F.size(F.array_intersect("wide", "own")) / F.size(F.array_distinct("own"))
    found = met.select("doc_id", "license", "start", share.alias("share")).where(F.col("share") >= license_scan.CONTAINMENT).distinct()
    found = found.groupBy("doc_id", "license").agg(F.max("share").alias("share"), F.min("start").alias("first"), F.count("*").alias("n_windows"))
    return sorted(tuple(r) for r in found.collect()), laid.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the smallest tables")
def test_bands_over_every_window_retrieve_what_the_scan_returns(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text")
    longest = max(license_scan.TEMPLATES.values(), key=len).split()
    made = [" ".join(["before", *(w if i % 11 else "other" for i, w in enumerate(longest)), "after"]), " ".join([*longest, *longest]), " ".join(longest[3:]), None, ""]
    docs = docs.unionByName(spark.createDataFrame(list(enumerate(made, 10_000_000)), "doc_id long, text string"))
    licenses = license_scan.templates(spark)
    expected, windows = by_bands_alone(docs, licenses)
    got = sorted(tuple(r) for r in license_scan.scan(docs, licenses).select("doc_id", "license", "containment", "first_word", "n_windows").collect())
    assert expected and got == expected
    assert windows > 100 * sum(r[4] for r in got)  # nearly all windows hold no shingle of a template
