"""The classifier on labels that it was not fitted on, and its shrinkage against plain Python."""

import collections
import math

import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(3)) == 0
    keep = {r.doc_id: r.keep for r in quality.score(docs, labels.filter(~held)).collect()}
    rows = [(r.doc_id, r.quality) for r in labels.filter(held).collect()]
    good, bad = [d for d, y in rows if y], [d for d, y in rows if not y]
    assert len(good) > 60 and len(bad) > 8
    assert sum(keep[d] for d in good) >= 0.99 * len(good)
    assert sum(not keep[d] for d in bad) >= 0.85 * len(bad)


def strength(groups):
    """groups: (n, total, mean of the parent)."""
    between = sum(n * (t / n - q) ** 2 for n, t, q in groups)
    within = sum(q * (1 - q) for _, _, q in groups)
    scale = sum(n * q * (1 - q) for n, _, q in groups)
    rho = max(0.0, between - within) / (scale - within) if scale > within else 0.0
    return quality.MAX_STRENGTH if rho <= 1 / quality.MAX_STRENGTH else min(quality.MAX_STRENGTH, max(1.0, 1 / rho - 1))


def test_shrinkage_equals_brute_force(spark):
    docs, labels = tables(spark)
    rows = quality.score(docs, labels).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
    p = {r.doc_id: 1 / (1 + math.exp(-r.evidence)) for r in rows}
    paths, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        paths[r.source, r.lang].append(p[r.doc_id])
        hosts[r.source].append(p[r.doc_id])
    mean = sum(p.values()) / len(p)
    a = strength([(len(x), sum(x), mean) for x in hosts.values()])
    host = {h: (sum(x) + a * mean) / (len(x) + a) for h, x in hosts.items()}
    b = strength([(len(x), sum(x), host[h]) for (h, _), x in paths.items()])
    path = {k: (sum(x) + b * host[k[0]]) / (len(x) + b) for k, x in paths.items()}
    for r in rows:
        assert r.host_quality == pytest.approx(host[r.source], abs=1e-8) and r.path_quality == pytest.approx(path[r.source, r.lang], abs=1e-8)
        odds = r.evidence + math.log(r.path_quality / (1 - r.path_quality)) - math.log(mean / (1 - mean))
        assert r.quality == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-7) and r.keep == (r.quality >= quality.CUT)


def test_sparse_sites_say_little(spark):
    """One document of a good site among bad ones is nearer to the rest than a whole site of them."""
    rows = [(i, "a good text of words " * 5 + str(i), "good", "x") for i in range(60)] + [(100 + i, "### !!! $$$ " * 9 + str(i), "bad", "x") for i in range(60)]
    rows += [(200, "### !!! $$$ " * 9, "rare", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)] + [(100 + i, 0) for i in range(0, 60, 2)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert got[100].host_quality < got[200].host_quality < got[1].host_quality
    assert all(got[i].keep == (i < 60) for i in got)


def test_without_labels_all_are_kept(spark):
    docs, labels = tables(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(docs, none).count() == docs.count()
    assert quality.keep_good(docs, labels.filter("quality = 1")).count() == docs.count()


def test_sample_is_the_same_for_every_partitioning(spark):
    docs, labels = tables(spark)
    docs = docs.limit(200).withColumn("doc_id", F.col("doc_id") % 50)
    x, y = quality.sample(docs, labels, 40)
    again = quality.sample(docs.repartition(7), labels.repartition(3), 40)
    assert len(x) <= 40 and (x == again[0]).all() and (y == again[1]).all()


def test_texts_are_judged_once(spark):
    docs, labels = tables(spark)
    kept = quality.keep_good(docs, labels)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in quality.score(docs, labels).filter("keep").collect()}
