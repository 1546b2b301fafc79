"""Batch search and the inverted-file index against a plain scan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ann, nearest
from lodestone.plans.registry import QUERIES
from lodestone.sources.shared import new_folder


def rows(n, dim, seed, keys="long"):
    rnd = random.Random(seed)
    middle = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(7)]
    out = []
    for k in range(n):
        v = [round(x + rnd.gauss(0, 0.4), 2) for x in middle[0 if k % 3 == 0 else k % 7]]  # a third in one place
        v = out[k - 5][1] if k % 11 == 7 and out[k - 5][1] else v  # ties
        v = [0.0] * dim if k % 53 == 3 else None if k % 59 == 5 else v
        out.append((k if keys == "long" else f"k{k:03d}é", v))
    return out


def plain(store, queries, k, least=None):
    out = []
    for q, a in queries:
        if a is None or q is None:
            continue
        scored = []
        for key, b in store:
            if b is not None:
                both = np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))
                s = float(np.dot(a, b) / both) if both else 0.0
                if least is None or s >= least:
                    scored.append((-round(s, 9), key, s))
        out += [(q, key, round(s, 6), i + 1) for i, (_, key, s) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def told(df):
    return sorted((r[0], r[1], round(r[2], 6), r[3]) for r in df.collect())


@pytest.mark.parametrize("keys", ["long", "string"])
@pytest.mark.parametrize("handed", [True, False])
def test_batch_equals_plain_scan(spark, monkeypatch, keys, handed):
    store, asked = rows(400, 6, 1, keys), rows(60, 6, 2, keys) + [(None, [1.0] * 6)]
    if not handed:
        for name, n in (("BROADCAST_NUMBERS", 10), ("STORE_BLOCK", 300), ("QUERY_BLOCK", 60)):
            monkeypatch.setattr(nearest, name, n)
    monkeypatch.setattr(nearest, "TILE", 900)
    kind = "bigint" if keys == "long" else "string"
    s, q = spark.createDataFrame(store, f"id {kind}, embedding array<float>"), spark.createDataFrame(asked, f"q {kind}, embedding array<float>")
    store, asked = ([(k, None if v is None else np.float32(v).astype(float)) for k, v in x] for x in (store, asked))
    for k, least in ((5, None), (3, 0.7), (1000, None), (0, None)):
        assert told(nearest.batch_top_k(s, q, k, "id", "q", min_score=least)) == plain(store, asked, k, least)


def test_other_lengths_are_an_error(spark):
    s = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, embedding array<double>")
    with pytest.raises(Exception, match="dimension mismatch"):
        nearest.batch_top_k(s, s.where("id = 1").withColumnRenamed("id", "q"), 1, "id", "q").collect()
    assert nearest.batch_top_k(s.limit(0), s.where("id = 1").withColumnRenamed("id", "q"), 1, "id", "q").count() == 0
    assert nearest.batch_top_k(s.where("id = 1"), s.limit(0).withColumnRenamed("id", "q"), 1, "id", "q").count() == 0


@pytest.mark.parametrize("handed", [True, False])
def test_index(spark, monkeypatch, handed):
    if not handed:
        for name, n in (("BROADCAST_NUMBERS", 10), ("STORE_BLOCK", 300), ("QUERY_BLOCK", 60)):
            monkeypatch.setattr(nearest, name, n)
    store, asked = rows(1500, 8, 3), rows(80, 8, 4)
    s, q = spark.createDataFrame(store, "id bigint, embedding array<double>"), spark.createDataFrame(asked, "q bigint, embedding array<double>")
    path = new_folder(spark, "test-index")
    ann.build(s, path, "id", lists=20)
    index, centers = ann.load(spark, path)
    assert len(centers) == 20 and np.allclose((centers**2).sum(1), 1)
    held = {r.id: r.list for r in index.select("id", "list").collect()}
    assert index.count() == len(held) == 1500
    for k, v in store:
        assert held[k] == (ann.NO_VECTOR if v is None else ann.NO_LENGTH if not any(v) else int(np.argmax(centers @ np.array(v))))
    exact = plain(store, asked, 10)
    assert told(ann.search(index, centers, q, 10, "id", "q", probes=20)) == exact
    some = ann.search(index, centers, q, 10, "id", "q", probes=6)
    want = spark.createDataFrame(exact, "q bigint, id bigint, score double, rank int")
    r = ann.recall(some, want, "id", "q").first()
    hits = len({x[:2] for x in exact} & {(x.q, x.id) for x in some.collect()})
    assert (r.queries, r.wanted, r.hits) == (len({x[0] for x in exact}), len(exact), hits) and 0.9 <= r.recall == hits / len(exact)
    if handed:
        one = ann.search(index, centers, q.limit(1), 3, "id", "q", probes=2)
        assert "PartitionFilters: [list" in one._jdf.queryExecution().toString()


def test_index_of_odd_tables(spark):
    none = spark.createDataFrame([], "id bigint, embedding array<double>")
    assert ann.centroids(none, "id").shape == (0, 0)
    blank = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "id bigint, embedding array<double>")
    centers = ann.centroids(blank, "id")
    assert {r.id: r.list for r in ann.indexed(blank, centers).collect()} == {1: ann.NO_LENGTH, 2: ann.NO_VECTOR}
    q = spark.createDataFrame([(9, [1.0, 0.0])], "q bigint, embedding array<double>")
    assert told(ann.search(ann.indexed(blank, centers), centers, q, 3, "id", "q")) == [(9, 1, 0.0, 1)]


def test_stored_index_answers_like_the_exact_scan(spark):
    sf = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    exact = nearest.batch_top_k(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, "vec_id", "query_id")
    assert ann.recall(QUERIES["vector_ann_topk"](spark, sf), exact, "vec_id", "query_id").first().recall >= 0.9
