"""Substring search by trigrams against a scan; exact quantiles by refinement against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import substring, telemetry
from lodestone.plans.registry import QUERIES
from lodestone.sources.shared import new_folder

NEEDLES = ["needle", "NEEDLE", "ab", "", "éü", "éüß", "aaa", "aaaa", "no such text", "end", "日本語", "needle in", "$^."]


def test_search_equals_scan(spark):
    rnd = random.Random(4)
    texts = [None, "", "ab", "a needle in hay", "NEEdle", "aaaa", "ÉÜß here", "日本語テキスト", "x$^.y"] + ["".join(rnd.choice("abcdn e") for _ in range(60)) for _ in range(200)]
    rows = spark.createDataFrame([(k, t, f"name{k % 7}" if k % 5 else None) for k, t in enumerate(texts)], "id long, content string, name string")
    path = new_folder(spark, "test-grams")
    substring.build(rows, path, "id", ["content", "name"], buckets=8)
    for needle in [*NEEDLES, "name3", "ame6"]:
        want = {k for k, t in enumerate(texts) if needle.lower() in (t or "\0").lower() or (k % 5 and needle.lower() in f"name{k % 7}")} if needle else {k for k in range(len(texts)) if texts[k] is not None or k % 5}
        assert {r.id for r in substring.search(spark, path, needle).collect()} == want, needle
    plan = substring.search(spark, path, "needle in")._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan
    none = new_folder(spark, "test-grams")
    substring.build(rows.where("id < 2").withColumn("content", F.lit("xyz")), none, "id", ["content"])
    assert substring.search(spark, none, "abc").count() == 0 and substring.search(spark, none, "XYZ").count() == 2


def test_long_texts_and_shared_keys(spark):
    """The time for the trigrams of a text grows with its length, not with its square; rows of one key count once."""
    import time

    rnd = random.Random(5)
    long = "".join(rnd.choice("abcé日😀 \n") for _ in range(300_000))
    rows = spark.createDataFrame([(1, long), (2, "x😀y\nz"), (3, "abcd"), (3, "bcde"), (3, "abcde")], "id long, content string")
    began = time.time()
    got = {r.id: set(r.g) for r in rows.where("id < 3").select("id", substring.trigrams(F.col("content")).alias("g")).collect()}
    assert time.time() - began < 30
    assert got == {k: {t[i : i + 3] for i in range(len(t) - 2)} for k, t in ((1, long), (2, "x😀y\nz"))}
    path = new_folder(spark, "test-grams")
    substring.build(rows, path, "id", ["content"], buckets=2)
    assert sorted(r.content for r in substring.search(spark, path, "BCD").collect()) == ["abcd", "abcde", "bcde"]
    assert [r.id for r in substring.search(spark, path, "😀y\n").collect()] == [2]


def test_registered_search_equals_scan(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id for r in QUERIES["substring_search"](spark, sf).collect()}
    want = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and "license" in r.text.lower()}
    assert got == want and want


@pytest.mark.parametrize("top", [5, 70, 5000, 1 << 40])
def test_quantiles_equal_sorting(spark, top):
    rnd = random.Random(top)
    values = [rnd.randrange(top) for _ in range(700)] + [3] * 300
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    shares = {"low": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    want = {k: sorted(values)[int(len(values) * q)] for k, q in shares.items()}
    assert telemetry.quantiles(rows, "v", shares) == want and telemetry.quantiles(rows.limit(0), "v", shares) == dict.fromkeys(shares)
    for r in rows.where("v is not null").select("v", telemetry.latency_bucket(F.col("v")).alias("b")).collect():
        low, high = telemetry.bucket_bounds(r.b)
        assert low <= r.v <= high and high - low <= r.v // 32
