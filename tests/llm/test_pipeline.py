"""The pipeline's stages take effect on a small corpus of planted cases."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rnd = random.Random(1)
    syllables = "ka lo mi ter an do shi ver".split()
    prose = lambda n: " ".join("".join(rnd.choices(syllables, k=rnd.randrange(1, 4))) for _ in range(n))
    passage = prose(60)
    texts = [prose(80) for _ in range(40)]
    texts[5] = texts[4]
    texts[6] = texts[4] + " " + prose(3)
    texts[10] += " " + passage
    texts[11] = passage + " " + texts[11]
    texts[12] += ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    texts += ["".join(chr(rnd.randrange(33, 126)) for _ in range(400)), None, ""]
    rows = [(k, t, "xx", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    # junk without an id of its own goes, and the good text that shares its id stays
    junk = lambda: "".join(chr(rnd.randrange(33, 126)) for _ in range(400))
    rows += [(None, junk(), "xx", "s0", 400), (35, junk(), "xx", "s1", 400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), {r[0]: r for r in rows[:-2]}, passage


def test_stages(spark, corpus):
    at, rows, passage = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen[name] = {r.doc_id: r for r in docs.collect()}
            assert all(r.n_chars == len(r.text or "") for r in seen[name].values())
    assert set(seen["quality"]) == set(range(40)) and seen["quality"][35].text == rows[35][1]
    assert set(seen["near_copies"]) == set(range(40)) - {5, 6}
    assert passage in seen["repeats"][10].text and passage not in seen["repeats"][11].text
    assert corpus_pipeline.SECRET_MARK in seen["secrets"][12].text and "24be" not in seen["secrets"][12].text
    assert {k: r.text for k, r in seen["secrets"].items() if k != 12} == {k: r.text for k, r in seen["repeats"].items() if k != 12}
    assert {r.doc_id for r in docs.collect()} == set(seen["secrets"])


def test_run_is_the_stages(spark, corpus):
    at, _, _ = corpus
    got = corpus_pipeline.run(spark, at)
    assert got.columns[:3] == ["doc_id", "start", "length"] and got.agg({"length": "sum"}).first()[0] > 0


def test_near_copies_of_shared_ids(spark):
    """All texts of an id that several rows share stay, each once; columns may have the stages' own names."""
    kind = "doc_id long, text string, _row string, _nth int, component_id long, count long"
    words = lambda p: " ".join(f"{p}{k}" for k in range(30))
    rows = [(7, words("a")), (7, words("b")), (7, words("b")), (9, words("b") + " more"), (11, words("c")), (None, words("d")), (None, words("d")), (3, None), (3, None)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], kind)
    out = corpus_pipeline.near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in out.collect()) == sorted([(7, words("a")), (7, words("b")), (11, words("c")), (-1, words("d")), (-1, words("d")), (3, "")])
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0


def test_quality_keeps_clashing_columns(spark, corpus):
    at, rows, _ = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet").selectExpr("*", "'own' as _row", "1 as keep", "2 as threshold")
    out = corpus_pipeline.quality(spark, docs, at)
    assert out.columns == docs.columns and {r._row for r in out.collect()} == {"own"} and out.count() == 40
