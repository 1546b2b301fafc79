"""Importance resampling against a plain reading of its definition, with odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from lodestone.llm import resampling
from lodestone.llm.queries import ORACLE_SQL, QUERIES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain(docs, target, percent, least, buckets, most, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
        return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(words) - k + 1)]

    got = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in got for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for i, n_words, f in got:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    drawn = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(drawn[: len(drawn) * percent // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=repr)


@pytest.mark.parametrize(("most", "least"), [(1, 3), (3, 5)])
def test_equals_plain_form(spark, monkeypatch, most, least):
    texts = [None, "", " .,;", "One two THREE four-five_six", "É é ß ÿ 日本 x1", "a " * 5000 + "b", "same same words here now", "same same words here now", "z" * 4000, "one two three four five six " * 3, "x\x00y\x7fz {brace} [b] ok ok ok"]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, "one two three four"), (None, "one two three four"), (5, "a b c d e f g"), (5, "a b c d e f g")]
    target = ["one two three", None, "words here now now"]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, part int")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(frame, aim, 60, least, 97, most, 7)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words", "drawn"]
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=repr) == plain(docs, target, 60, least, 97, most, 7)


def test_pieces_of_long_texts(monkeypatch):
    text = ("word other thing " * 300 + "x" * 500 + " end").encode()
    whole = resampling.bucket_stream(text, resampling._Bucket(1000), 3)
    monkeypatch.setattr(resampling, "PIECE", 37)
    cut = resampling.bucket_stream(text, resampling._Bucket(1000), 3)
    assert whole[1] == cut[1] == 902 and sorted(whole[0].tolist()) == sorted(cut[0].tolist())


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resampling.resample(none, one).count() == 0
    assert [(r.weight, r["rank"]) for r in resampling.resample(one, none, 100, 1).collect()] == [(3 * math.floor(1000 * math.log(10003 / 20000)), 1)]


def test_registered_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    want = con.sql(ORACLE_SQL["op11_resampling"])
    got = QUERIES["op11_resampling"](spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
