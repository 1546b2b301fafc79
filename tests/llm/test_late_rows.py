"""The overwrite of late rows against a layout made by plain loops, with odd inputs."""

import hashlib
import math
import zlib
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from lodestone.llm import late_rows
from lodestone.llm.queries import QUERIES
from lodestone.llm.spark import shared_dir

ZERO = datetime(1970, 1, 1)
NAMES = ["sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority"]


def us(t):
    return None if t is None else (t - ZERO) // timedelta(microseconds=1)


def day(r):
    return -1 if r[4] is None else us(r[4]) // late_rows.DAY_US


def low(v):
    return (v is not None, v)


def plain_layout(rows, per_file):
    best = {}
    for r in rows:
        rank = tuple(low(v) for v in (r[5], *r[1:5], r[6]))
        if r[0] not in best or rank > best[r[0]][0]:
            best[r[0]] = (rank, r)
    days = defaultdict(list)
    for _, r in best.values():
        days[day(r)].append(r)
    return {(d, k // per_file): part for d, own in days.items() for own in [sorted(own, key=lambda r: (low(r[4]), low(r[0])))] for k in range(0, len(own), per_file) for part in [own[k : k + per_file]]}


def plain(sales, since, per_file):
    rows = list(sales)
    for r in sales:
        h = None if r[0] is None else zlib.crc32(str(r[0]).encode())
        if h is not None and h % 3 == 0 and day(r) % 4 == 0:
            rows.append((r[0], r[1], r[2], None if r[3] is None else r[3] + 1, r[4] + timedelta(days=h % 2), None if r[5] is None else r[5] + timedelta(days=1 + h % 97), r[6]))
    first, last = plain_layout([r for r in rows if r[5] is not None and r[5] < since], per_file), plain_layout(rows, per_file)
    versions = lambda layout: {r for part in layout.values() for r in part}
    changed = {day(r) for r in versions(first) ^ versions(last)}
    out = {}
    for (d, n), part in last.items():
        cents = sum(0 if r[3] is None else math.floor(100 * r[3] + 0.5) for r in part)
        ids = ",".join("" if r[0] is None else str(r[0]) for r in part)
        crc = sum(zlib.crc32(":".join("" if v is None else str(v) for v in (r[0], us(r[4]), us(r[5]))).encode()) for r in part)
        out[d, n] = (len(part), cents, crc, hashlib.sha256(ids.encode()).hexdigest(), d in changed)
    return out


def told(rows):
    return {(r.day, r.file_no): (r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in rows}


def frame(spark, rows, kind):
    fields = dict(zip(NAMES, (T.LongType(), T.LongType(), T.StringType(), T.DoubleType(), kind(), kind(), T.IntegerType()), strict=True))
    return spark.createDataFrame(rows, T.StructType([T.StructField(k, v) for k, v in fields.items()]))


def odd_sales():
    at = lambda d, s=0: datetime(2024, 3, 1) + timedelta(days=d, seconds=s)
    rows = [(k, k % 3, "done", float(k), at(k % 30, k * 977 % 86400), at(k % 30, k * 977 % 86400 + 60), 1) for k in range(400)]
    rows += [(k, 1, "open", None, at(4), at(5 + k % 40), None) for k in range(400, 560)]  # one hot instant
    rows += [(k, 1, None, 2.5, None, at(k % 40), 2) for k in range(560, 640)]  # no time: day -1
    rows += [(k, None, "late", 1.25, at(9, k), None, 3) for k in range(640, 650)]  # no arrival
    rows += [(7, 9, "again", 1.0, at(11), at(35), 4), (7, 9, "tie", 2.0, at(12), at(35), 4), (8, 8, "old", 3.0, at(3), at(0), 5)]
    rows += [rows[20], rows[20], (None, 1, "x", 1.0, at(2), at(2), 1), (None, 1, "y", 1.0, at(6), at(25), 1), (-5, 1, "x", 1.0, datetime(1969, 12, 31, 5), at(1), 1)]
    return rows


@pytest.mark.parametrize(("kind", "most"), [(T.TimestampNTZType, 1 << 16), (T.TimestampType, 16), (T.TimestampNTZType, 16)])
def test_equals_plain_form(spark, monkeypatch, kind, most):
    monkeypatch.setattr(late_rows, "MOST_ROWS", most)
    monkeypatch.setattr(late_rows.Layout.__init__, "__defaults__", (late_rows.SLICE_S, most))
    rows = odd_sales()
    got = late_rows.late_sales(frame(spark, rows, kind), files=60).collect()
    per_file = 1 + len(rows) // 60
    want = plain(rows, datetime(2024, 3, 20), per_file)
    assert told(got) == want
    assert {x[4] for x in want.values()} == {True, False}
    for r in got:
        stored = pq.ParquetFile(r.path.removeprefix("file:"))
        assert stored.schema_arrow.names == NAMES == r.columns.split(",") and stored.metadata.num_rows == r.n_rows
    top = Path(got[0].path.removeprefix("file:")).parent.parent.parent
    assert {str(p) for p in top.rglob("*.parquet")} == {r.path.removeprefix("file:").replace("//", "/") for r in got}
    assert not list(top.parent.glob(f"{top.name}.*"))


def test_days_that_are_not_touched_keep_their_bytes(spark):
    schema = frame(spark, [], T.TimestampNTZType).schema
    at = late_rows.Layout(f"{shared_dir(spark)}/late-bytes-{id(schema)}", schema, "sale_id", "sold_at", "arrived_at", 10)
    old = [(k, 1, "a", 1.0, datetime(2024, 1, 1 + k // 40, 1), datetime(2024, 1, 9), 1) for k in range(120)]
    late_rows.overwrite(spark, at, frame(spark, old, T.TimestampNTZType), new=True)
    top = Path(at.path.removeprefix("file:"))
    held = lambda: {str(p): p.read_bytes() for p in top.rglob("*.parquet")}
    before = held()
    moved = [(45, 1, "b", 1.0, datetime(2024, 1, 3, 2), datetime(2024, 1, 10), 1), (3, 1, "older", 1.0, datetime(2024, 1, 1), datetime(2024, 1, 8), 1)]
    days = sorted(r.day for r in late_rows.overwrite(spark, at, frame(spark, moved, T.TimestampNTZType)).collect())
    after = held()
    assert days == [19724, 19725] and {k: v for k, v in before.items() if "day=19723" in k} == {k: v for k, v in after.items() if "day=19723" in k}
    assert not {k for k in after if "day=19723" not in k} & set(before)
    late_rows.overwrite(spark, at, frame(spark, moved, T.TimestampNTZType))  # the same rows again change nothing
    assert held() == after
    gone = [(k, 1, "c", 1.0, datetime(2024, 1, 1), datetime(2024, 2, 1), 1) for k in range(40, 80)]  # a day loses all its rows
    late_rows.overwrite(spark, at, frame(spark, gone, T.TimestampNTZType))
    assert not list(top.glob("day=19724/*/*.parquet")) and sum(pq.read_metadata(p).num_rows for p in top.rglob("*.parquet")) == 120


def test_empty_and_clashing(spark):
    assert late_rows.late_sales(frame(spark, [], T.TimestampNTZType)).count() == 0
    with pytest.raises(ValueError, match="own"):
        late_rows.Layout("x", T.StructType([T.StructField("day", T.LongType())]), "day", "t", "a", 1)


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    sales = [tuple(r) for r in spark.read.parquet(f"{sf}/sales.parquet").select(*NAMES).collect()]
    got = QUERIES["op13_late_rows"](spark, sf).collect()
    assert told(got) == plain(sales, datetime(2024, 3, 20), 1 + len(sales) // 1100)
