"""Traces from streams of records against the batch form."""

from datetime import datetime, timedelta

from lodestone.plans.registry import QUERIES
from lodestone.sources.shared import new_folder
from lodestone.streaming import spans


def test_stream_equals_batch_on_events(spark):
    sf = "/root/testdata/sf0.001"
    told = lambda name: sorted(map(tuple, QUERIES[name](spark, sf).collect()))
    assert told("trace_stream") == told("trace_pairs")


def records(spark, *rows):
    zero = datetime(2024, 1, 1)
    return spark.createDataFrame([(t, zero + timedelta(seconds=s), kind, *rest) for t, s, kind, *rest in rows], spans.RECORD)


ROWS = [
    ("a", 9, "end", "1", None, None, None, None, None), ("a", 2, "start", "1", "embed", None, None, None, None), ("a", 5, "start", "2", "rank", None, None, None, None),
    ("a", 3, "tokens", None, None, 10, None, None, None), ("a", 4, "tokens", None, None, 1, 5, None, None), ("a", 7, "retrieval", None, None, None, None, 4, "bge"), ("a", 6, "retrieval", None, None, None, None, 9, "llm"),
    ("b", 20, "end", "9", None, None, None, None, None), ("c", 30, "other", None, None, None, None, None, None), ("d", 100_000, "start", "1", "late", None, None, None, None),
]


def test_records_out_of_order_open_and_orphaned(spark):
    rows = records(spark, *ROWS)
    batch = {r.trace_id: r for r in spans.pair_batch(rows).collect()}
    assert set(batch) == {"a", "d"}
    a = batch["a"]
    assert [(s.name, s.duration_ms) for s in a.spans] == [("embed", 7000), ("rank", None)] and (a.input_tokens, a.output_tokens, a.total_tokens, a.chunks_retrieved, a.reranker_used) == (11, 5, 16, 4, "bge")
    stream = spans.replay(spark, rows, new_folder(spark, "test-spans"), rounds=2)
    assert sorted(map(str, stream.collect())) == sorted(map(str, batch.values()))


def test_a_late_end_does_not_open_a_second_trace(spark):
    rows = records(spark, ("a", 0, "start", "1", "x", None, None, None, None), ("b", 50_000, "start", "1", "y", None, None, None, None), ("a", 99_000, "end", "1", None, None, None, None, None))
    got = {r.trace_id: [s.duration_ms for s in r.spans] for r in spans.replay(spark, rows, new_folder(spark, "test-spans"), rounds=4).collect()}
    assert got == {"a": [None], "b": [None]}  # the end came long after the trace was closed


def test_no_records(spark):
    assert spans.replay(spark, records(spark, ROWS[0]).limit(0), new_folder(spark, "test-spans")).count() == 0 and spans.pair_batch(records(spark, ROWS[0]).limit(0)).count() == 0


def test_a_trace_has_one_timer_and_packed_state():
    """Records in many batches: one timer a trace, and an entry of state a batch, so that closing reads them once."""
    from types import SimpleNamespace

    import pandas as pd

    class Held(list):
        reads = 0

        def appendList(self, rows):  # noqa: N802
            self.extend(rows)

        def get(self):
            self.reads += 1
            return iter(self)

    class Value:
        now = None

        def get(self):
            return self.now

        def update(self, value):
            self.now = value

        def clear(self):
            self.now = None

    held, timers = Held(), set()
    handle = SimpleNamespace(getListState=lambda *a: held, getValueState=lambda *a: Value(), registerTimer=timers.add, deleteTimer=timers.discard)
    traces = spans._Traces(1000)
    traces.init(handle)
    for k in range(20):
        rows = [(pd.Timestamp(k * 500 + j, unit="ms"), "start" if j < 50 else "end", f"s{k}-{j % 50}", "n", None, None, None, None) for j in range(100)]
        assert not list(traces.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=["at", "kind", "span_id", "name", "input_tokens", "output_tokens", "chunks", "reranker"])]), None))
    assert timers == {19 * 500 + 99 + 1000} and len(held) == 20
    expired = lambda ms: list(traces.handleExpiredTimer(("a",), None, SimpleNamespace(getExpiryTimeInMs=lambda: ms)))
    assert expired(5000) == [] and held.reads == 0
    (closed,) = expired(timers.pop())
    got = closed["spans"][0]
    assert held.reads == 1 and not held and len(got) == 1000 and {s["duration_ms"] for s in got} == {50} and got[0] == {"start_ms": 0, "span_id": "s0-0", "name": "n", "end_ms": 50, "duration_ms": 50}
