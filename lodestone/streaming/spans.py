"""Traces from a stream of single records: starts and ends of spans, token counts, retrieval reports.

Records of a trace wait in state, packed by batch, until none has come for `gap`; a trace has one timer,
which then closes it.  The order in which records come does not matter.  A span whose end never came stays open (null end and
duration); an end without a start is no span.  Tokens add up; of the retrieval reports the last by
time counts, then by number of chunks and name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RECORD = "trace_id string, at timestamp, kind string, span_id string, name string, input_tokens long, output_tokens long, chunks int, reranker string"
#: Kinds of records; others are ignored.
START, END, TOKENS, RETRIEVAL = "start", "end", "tokens", "retrieval"
TRACE = (
    "trace_id string, spans array<struct<start_ms:long,span_id:string,name:string,end_ms:long,duration_ms:long>>, input_tokens long, output_tokens long, total_tokens long, chunks_retrieved int, reranker_used string"
)
_HELD = pa.schema([("at_ms", pa.int64()), ("kind", pa.string()), ("span_id", pa.string()), ("name", pa.string()), ("input_tokens", pa.int64()), ("output_tokens", pa.int64()), ("chunks", pa.int32()), ("reranker", pa.string())])
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _folded(trace_id: str, rows: list[tuple]) -> dict:
    """One trace of its records (as `_HELD`)."""
    starts, ends, tokens, best = {}, {}, [0, 0], None
    for at, kind, span, name, put, got, chunks, reranker in rows:
        if kind == START:
            starts[span] = min(starts.get(span, (at, name)), (at, name), key=lambda x: (x[0], x[1] or ""))
        elif kind == END:
            ends[span] = max(ends.get(span, at), at)
        elif kind == TOKENS:
            tokens = [tokens[0] + int(put or 0), tokens[1] + int(got or 0)]
        elif kind == RETRIEVAL:
            own = (at, int(chunks or 0), reranker or "none")
            best = own if best is None else max(best, own)
    spans = sorted(({"start_ms": a, "span_id": s, "name": n, "end_ms": ends.get(s), "duration_ms": None if s not in ends else ends[s] - a} for s, (a, n) in starts.items()), key=lambda x: (x["start_ms"], x["span_id"] or ""))
    return {"trace_id": trace_id, "spans": spans, "input_tokens": tokens[0], "output_tokens": tokens[1], "total_tokens": sum(tokens), "chunks_retrieved": best[1] if best else 0, "reranker_used": best[2] if best else "none"}


def _packed(frame: pd.DataFrame, at_ms: np.ndarray) -> bytes:
    """The records of a batch as one Arrow stream."""
    columns = [pa.array(at_ms, pa.int64()), *(pa.array(frame[f.name], f.type, from_pandas=True) for f in _HELD if f.name != "at_ms")]
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, _HELD) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=_HELD))
    return out.getvalue().to_pybytes()


def _unpacked(held: list[bytes]) -> list[tuple]:
    table = pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in held)
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))


class _Traces(StatefulProcessor):
    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held, self.latest = handle, handle.getListState("held", "records binary"), handle.getValueState("latest", "at_ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new, latest = [], None
        for frame in rows:
            at = frame["at"].astype("datetime64[us]").to_numpy().view(np.int64) // 1000
            if key[0] is not None and len(at):  # heartbeats are no trace
                new.append((_packed(frame, at),))
                latest = int(at.max()) if latest is None else max(latest, int(at.max()))
        if new:
            self.held.appendList(new)
            before = self.latest.get()
            if before is None or before[0] < latest:
                if before is not None:
                    self.handle.deleteTimer(before[0] + self.gap_ms)
                self.latest.update((latest,))
                self.handle.registerTimer(latest + self.gap_ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        latest = self.latest.get()
        if latest is None or latest[0] + self.gap_ms > expiredTimerInfo.getExpiryTimeInMs():
            return  # closed already, or a later record has a timer of its own
        rows = _unpacked([r[0] for r in self.held.get()])
        self.held.clear()
        self.latest.clear()
        trace = _folded(key[0], rows)
        if trace["spans"] or trace["total_tokens"] or trace["reranker_used"] != "none":
            yield pd.DataFrame([trace])

    def close(self) -> None:
        pass


def pair(records: DataFrame, gap_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """Traces (TRACE) of a stream of records (RECORD); records later than `late` are dropped by the watermark.

    Heartbeats, records without a trace, move the watermark and are no trace.
    """
    records.sparkSession.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = records.withWatermark("at", late).groupBy("trace_id")
    traces = rows.transformWithStateInPandas(_Traces(gap_seconds * 1000), T._parse_datatype_string(TRACE), "Append", "EventTime")
    return traces.where(F.col("trace_id").isNotNull())


def pair_batch(records: DataFrame) -> DataFrame:
    """The same traces of a table: aggregations alone, spans first, so that a hot trace combines before the shuffle."""
    at = F.unix_millis("at")
    rows = records.where(F.col("trace_id").isNotNull())
    named = F.struct(at.alias("start_ms"), F.coalesce("name", F.lit("")).alias("name"))
    own = rows.where(F.col("kind").isin(START, END)).groupBy("trace_id", "span_id").agg(F.min(F.when(F.col("kind") == START, named)).alias("s"), F.max(F.when(F.col("kind") == END, at)).alias("end_ms"))
    own = own.where(F.col("s").isNotNull())
    span = F.struct("s.start_ms", "span_id", "s.name", "end_ms", (F.col("end_ms") - F.col("s.start_ms")).alias("duration_ms"))
    spans = own.groupBy("trace_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    total = lambda c: F.sum(F.when(F.col("kind") == TOKENS, F.coalesce(c, F.lit(0))).otherwise(0)).alias(c)
    report = F.struct(at.alias("at"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("reranker", F.lit("none")).alias("reranker"))
    sums = rows.groupBy("trace_id").agg(total("input_tokens"), total("output_tokens"), F.max(F.when(F.col("kind") == RETRIEVAL, report)).alias("r"))
    none = F.array().cast("array<struct<start_ms:bigint,span_id:string,name:string,end_ms:bigint,duration_ms:bigint>>")
    out = sums.join(spans, "trace_id", "left").select(
        "trace_id", F.coalesce("spans", none).alias("spans"), "input_tokens", "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.coalesce("r.chunks", F.lit(0)).alias("chunks_retrieved"), F.coalesce("r.reranker", F.lit("none")).alias("reranker_used"),
    )
    return out.where((F.size("spans") > 0) | (F.col("total_tokens") > 0) | (F.col("reranker_used") != "none"))


def replay(spark: SparkSession, records: DataFrame, folder: str, rounds: int = 3, gap_seconds: int = 1800, late: str = "1 hour") -> DataFrame:
    """Records arrive in `rounds` by time, each round is streamed through `pair` from where the last one ended; returns the traces.

    Within a round the order is arbitrary.  A heartbeat after the last record closes what is open.
    All files are in `folder`.
    """
    first, last = records.agg(F.min("at"), F.max("at")).first()
    if first is None:
        return spark.createDataFrame([], TRACE)
    step = (last - first) / rounds
    heart = spark.createDataFrame([(last,)], "last timestamp").coalesce(1)
    beat = heart.select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name != "at" else (F.col("last") + F.expr("interval 3650 days")).alias("at") for f in T._parse_datatype_string(RECORD).fields))
    for k in range(rounds + 1):
        here = F.col("at") >= F.lit(first + k * step)
        part = beat if k == rounds else records.where(here if k == rounds - 1 else here & (F.col("at") < F.lit(first + (k + 1) * step)))
        part.write.mode("append").parquet(f"{folder}/in")
        traces = pair(spark.readStream.schema(RECORD).parquet(f"{folder}/in"), gap_seconds, late)
        query = traces.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(TRACE).parquet(f"{folder}/out")
