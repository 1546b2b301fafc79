"""Tables that change together: last wins, all or nothing, only touched buckets."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.plans.registry import QUERIES
from lodestone.sources import versioned
from lodestone.sources.shared import new_folder
from lodestone.sources.versioned import Change, Conflict

KIND = "id string, seq long, v string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), KIND)


def held(spark, root, name="t", version=None):
    return {r.id: r.v for r in versioned.read(spark, root, name, version).collect()}


def test_last_wins_and_old_versions_stay(spark):
    root = new_folder(spark, "test-versioned")
    assert versioned.read(spark, root, "t") is None
    first = rows(spark, *((f"k{n}", 1, "old") for n in range(300)), ("k1", 3, "third"), ("k1", 2, "second"), (None, 1, "none"))
    assert versioned.commit(spark, root, {"t": Change(["id"], first, "seq"), "u": Change(["id"], first.limit(1), "seq")}) == 1
    assert len(held(spark, root)) == 301 and held(spark, root)["k1"] == "third"
    before = versioned.manifest(spark, root)[1]
    change = Change(["id"], rows(spark, ("k1", 2, "late"), ("k2", 5, "new"), ("z", 1, "added"), (None, 9, "null")), "seq", delete=spark.createDataFrame([("k3",)], "id string"))
    assert versioned.commit(spark, root, {"t": change}) == 2
    got = held(spark, root)
    assert len(got) == 301 and (got["k1"], got["k2"], got["z"], got[None]) == ("third", "new", "added", "null") and "k3" not in got
    after = versioned.manifest(spark, root)[1]
    moved = {b for b, f in after["t"].folders.items() if before["t"].folders.get(b) != f}
    assert 1 <= len(moved) <= 5 and after["u"] == before["u"]  # the other buckets' files are the same
    assert len(held(spark, root, version=1)) == 301 and "k3" in held(spark, root, version=1)
    versioned.commit(spark, root, {"t": Change(["id"], rows(spark, ("only", 1, "x")), "seq", replace=True)})
    assert held(spark, root) == {"only": "x"}
    assert versioned.vacuum(spark, root, keep=1) > 0 and held(spark, root) == {"only": "x"} and len(held(spark, root, "u")) == 1


def test_a_failed_writer_changes_nothing(spark):
    root = new_folder(spark, "test-versioned")
    versioned.commit(spark, root, {"t": Change(["id"], rows(spark, ("a", 1, "old")), "seq"), "u": Change(["id"], rows(spark, ("a", 1, "old")), "seq")})
    broken = rows(spark, ("a", 2, "new"), ("b", 2, "new")).withColumn("v", F.when(F.col("id") == "b", F.raise_error(F.lit("broken"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        versioned.commit(spark, root, {"t": Change(["id"], rows(spark, ("a", 2, "new")), "seq"), "u": Change(["id"], broken, "seq")})
    assert versioned.versions(spark, root) == [1] and held(spark, root) == held(spark, root, "u") == {"a": "old"}
    with pytest.raises(ValueError, match="key"):
        versioned.commit(spark, root, {"t": Change(["v"], rows(spark, ("a", 2, "new")), "seq")})


def test_the_second_of_two_writers_is_told(spark, monkeypatch):
    root = new_folder(spark, "test-versioned")
    versioned.commit(spark, root, {"t": Change(["id"], rows(spark, ("a", 1, "old")), "seq")})
    staged = versioned._staged

    def slow(*given):
        monkeypatch.setattr(versioned, "_staged", staged)
        versioned.commit(spark, root, {"t": Change(["id"], rows(spark, ("a", 2, "first")), "seq")})
        return staged(*given)

    monkeypatch.setattr(versioned, "_staged", slow)
    with pytest.raises(Conflict):
        versioned.commit(spark, root, {"t": Change(["id"], rows(spark, ("a", 3, "second")), "seq")})
    assert held(spark, root) == {"a": "first"}
    assert not list(Path(root.removeprefix("file:")).glob("manifest/.????????????????????????????????"))
    with pytest.raises(Conflict):
        versioned.commit(spark, root, {"t": Change(["id"], rows(spark, ("a", 3, "x")), "seq")}, base=1)


def test_index_upsert_equals_plain_form(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    vectors = [(r.vec_id, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label").collect()]
    for n, label in vectors:
        want[f"r{label % 3}", f"c{n}"] = (f"f{label}", 1)
    for n, label in vectors:
        if n % 5 == 4:
            del want[f"r{label % 3}", f"c{n}"]
    for n, label in vectors:
        key = (f"r{label % 3}", f"c{n}")
        if n % 3 == 0 and (key not in want or n % 2 == 0):
            want[key] = ("new", 2 if n % 2 == 0 else 0)
        if n % 3 == 1:
            want[key[0], key[1] + "+"] = (f"f{label}", 1)
    assert {(r.repository_id, r.id): (r.filepath, r.seq) for r in QUERIES["index_upsert"](spark, sf).collect()} == want
