"""Telemetry over `events`: an event stands for a trace of one span."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import telemetry
from ..sources.shared import new_folder
from ..streaming import spans
from .tables import Registry, read

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def traces(spark, d):
    tokens = F.get_json_object("props", "$.k").cast("long")
    span = F.array(F.struct(F.col("event_type").alias("name"), F.lit(0).cast("long").alias("start_ms"), F.floor("value").cast("long").alias("end_ms"), F.floor("value").cast("long").alias("duration_ms")))
    return read(spark, d, "events").select(
        F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.concat(F.lit("query "), F.repeat(F.lit("x"), (F.col("user_id") % 150).cast("int"))).alias("query"), F.col("event_type").alias("mode"), span.alias("spans"),
        F.struct(tokens.alias("total_tokens")).alias("token_usage"), F.struct((tokens * 15 / 1_000_000).alias("total_cost"), F.lit(0.02 / 1_000_000).alias("embedding_cost"), (tokens * 3 / 1_000_000).alias("llm_input_cost"), (tokens * 12 / 1_000_000).alias("llm_output_cost")).alias("cost_estimate"), (F.col("user_id") % 10).cast("int").alias("chunks_retrieved"),
        F.element_at(F.array(F.lit("none"), F.lit("bge"), F.lit("llm")), (F.col("user_id") % 3 + 1).cast("int")).alias("reranker_used"), (F.col("event_type") != "error").alias("success"),
    )


_T = (
    "WITH t AS (SELECT event_id AS id, (epoch_us(ts) // 1000) AS timestamp, 'query ' || repeat('x', (user_id % 150)::INT) AS query, event_type AS mode, floor(value)::BIGINT AS ms, (props->>'$.k')::BIGINT AS tokens, (props->>'$.k')::BIGINT * 15 / 1000000.0::DOUBLE AS cost, user_id % 10 AS chunks, "
    "(['none', 'bge', 'llm'])[user_id % 3 + 1] AS reranker, event_type <> 'error' AS success, strftime(ts, '%Y-%m-%d') AS day FROM events) "
)
_LAST = lambda n: f"(SELECT * FROM t ORDER BY timestamp DESC, id DESC LIMIT {n})"
_START, _END = 1704067200000, 1706659199999
_AT = lambda q: f"list_sort(list(ms))[floor(count(*) * {q}::DOUBLE)::BIGINT + 1]"


@_r.add(
    _T + "SELECT count(*) AS requests, sum(success::INT)::BIGINT AS succeeded, sum((NOT success)::INT)::BIGINT AS failed, coalesce(sum(tokens), 0)::BIGINT AS tokens, round(coalesce(sum(cost), 0), 6) AS cost, round(avg(ms), 6) AS average_latency, round(avg(chunks), 6) AS average_chunks, "
    f"{_AT(0.95)} AS p95_latency FROM t WHERE timestamp BETWEEN {_START} AND {_END}"
)
def metrics_summary(spark, d):
    m = telemetry.metrics(traces(spark, d), _START, _END)
    rounded = {"cost", "average_latency", "average_chunks"}
    return m.select(*(F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in m.columns if not c.startswith("by_")))


@_r.add(
    _T + "SELECT count(*) AS requests, sum(success::INT)::BIGINT AS succeeded, sum((NOT success)::INT)::BIGINT AS failed, coalesce(sum(tokens), 0)::BIGINT AS tokens, round(coalesce(sum(cost), 0), 6) AS cost, round(avg(ms), 6) AS average_latency, round(avg(chunks), 6) AS average_chunks, "
    f"{_AT(0.5)} AS p50_latency, {_AT(0.95)} AS p95_latency, {_AT(0.99)} AS p99_latency FROM t WHERE day BETWEEN '2024-01-05' AND '2024-01-25'"
)
def metrics_merged(spark, d):
    """Three weeks out of daily partial states."""
    rows = traces(spark, d)
    m = telemetry.merged_metrics(telemetry.daily_states(rows), rows, "2024-01-05", "2024-01-25")
    rounded = {"cost", "average_latency", "average_chunks"}
    return m.select(*(F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in m.columns))


@_r.add(_T + f"SELECT mode, count(*) AS n FROM t WHERE timestamp BETWEEN {_START} AND {_END} GROUP BY mode")
def metrics_by_mode(spark, d):
    return telemetry.metrics(traces(spark, d), _START, _END).select(F.explode("by_mode").alias("mode", "n"))


@_r.add(_T + f"SELECT reranker AS reranker_used, count(*) AS n FROM t WHERE timestamp BETWEEN {_START} AND {_END} GROUP BY reranker")
def metrics_by_reranker(spark, d):
    return telemetry.metrics(traces(spark, d), _START, _END).select(F.explode("by_reranker_used").alias("reranker_used", "n"))


@_r.add(_T + f"SELECT day, count(*) AS requests, sum(tokens)::BIGINT AS tokens, round(sum(cost), 6) AS cost FROM {_LAST(1000)} WHERE timestamp >= {_START} GROUP BY ROLLUP (day)")
def cost_by_day(spark, d):
    return telemetry.cost_by_day(traces(spark, d), _START).withColumn("cost", F.round("cost", 6))


@_r.add(_T + f"SELECT mode AS name, count(*) AS n, round(avg(ms), 6) AS average, {_AT(0.5)} AS p50, {_AT(0.95)} AS p95, {_AT(0.99)} AS p99 FROM {_LAST(500)} GROUP BY mode")
def latency_by_stage(spark, d):
    return telemetry.latency_by_stage(traces(spark, d)).withColumn("average", F.round("average", 6))


@_r.add(_T + f"SELECT round(0.02 / 1000000.0::DOUBLE * count(*), 9) AS embedding, round(sum(tokens * 3 / 1000000.0::DOUBLE), 6) AS llm_input, round(sum(tokens * 12 / 1000000.0::DOUBLE), 6) AS llm_output FROM {_LAST(1000)} WHERE timestamp >= {_START}")
def cost_breakdown(spark, d):
    c = telemetry.cost_breakdown(traces(spark, d), _START)
    return c.select(F.round("embedding", 9).alias("embedding"), F.round("llm_input", 6).alias("llm_input"), F.round("llm_output", 6).alias("llm_output"))


@_r.add(_T + "SELECT id, timestamp, ms FROM t WHERE id = 7")
def trace_by_id(spark, d):
    return telemetry.by_id(traces(spark, d), 7).select("id", "timestamp", telemetry.latency(F.col("spans")).alias("ms"))


@_r.add(_T + f"SELECT round(100.0::DOUBLE * sum(success::INT) / count(*), 6) AS success_rate FROM {_LAST(500)}")
def success_rate(spark, d):
    return telemetry.success_rate(traces(spark, d)).select(F.round("success_rate", 6).alias("success_rate"))


@_r.add(_T + "SELECT id, timestamp FROM t ORDER BY timestamp DESC, id DESC LIMIT 20")
def recent_traces(spark, d):
    return telemetry.recent(traces(spark, d), 20).select("id", "timestamp")


@_r.add(_T + "SELECT id FROM t ORDER BY timestamp DESC, id DESC LIMIT 1000")
def trace_ring(spark, d):
    return telemetry.recent(traces(spark, d), telemetry.RING).select("id")


@_r.add(_T + "SELECT id, timestamp, CASE WHEN length(query) > 100 THEN substr(query, 1, 100) || '...' ELSE query END AS query, mode, success, ms AS latency_ms, tokens AS total_tokens, round(cost, 6) AS total_cost FROM t ORDER BY timestamp DESC, id DESC LIMIT 50")
def traces_view(spark, d):
    return telemetry.view(traces(spark, d)).withColumn("total_cost", F.round("total_cost", 6))


_MODELS = ("gpt-4o", "claude-3-haiku-20240307", "unknown")
_PRICES = ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, (a, b) in telemetry.LLM_PRICES.items())


@_r.add(
    f"WITH p(model, i, o) AS (VALUES {_PRICES}), u AS (SELECT event_id, (['{_MODELS[0]}', '{_MODELS[1]}', '{_MODELS[2]}'])[event_id % 3 + 1] AS model, user_id AS input_tokens, (props->>'$.k')::BIGINT AS output_tokens FROM events) "
    "SELECT event_id, round(input_tokens * coalesce(i, 3.0) / 1000000, 9) AS llm_input_cost, round(output_tokens * coalesce(o, 15.0) / 1000000, 9) AS llm_output_cost, round(0.02 / 1000000 + input_tokens * coalesce(i, 3.0) / 1000000 + output_tokens * coalesce(o, 15.0) / 1000000, 9) AS total_cost FROM u LEFT JOIN p ON p.model = u.model"
)
def cost_model(spark, d):
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("event_id") % 3 + 1).cast("int"))
    usage = read(spark, d, "events").select("event_id", model.alias("model"), F.col("user_id").alias("input_tokens"), F.get_json_object("props", "$.k").cast("long").alias("output_tokens"))
    rows = telemetry.with_costs(usage)
    return rows.select("event_id", *(F.round(c, 9).alias(c) for c in ("llm_input_cost", "llm_output_cost", "total_cost")))


def records(spark, d):
    """Four records an event: the start and the end of a span, tokens and a retrieval; a trace is a day of every sixteenth user.

    Every seventh span has no end, every eleventh end no start.
    """
    base = read(spark, d, "events").select(
        F.concat(F.lit("t"), (F.col("user_id") % 16).cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("trace_id"), F.col("ts").cast("timestamp").alias("at"), "event_id", "event_type", F.floor("value").cast("long").alias("ms"),
        F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("user_id") % 10).cast("int").alias("found"), F.element_at(F.array(F.lit("none"), F.lit("bge"), F.lit("llm")), (F.col("user_id") % 3 + 1).cast("int")).alias("by"),
    )
    span = F.concat(F.lit("s"), F.col("event_id").cast("string"))

    def of(kind, **values):
        given = {"at": F.col("at"), "kind": F.lit(kind)} | values
        return base.select(*(given.get(f.name, F.col("trace_id") if f.name == "trace_id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], spans.RECORD).schema.fields))

    start = of(spans.START, span_id=F.when(F.col("event_id") % 11 != 5, span), name=F.col("event_type")).where("span_id is not null")
    end = of(spans.END, span_id=F.when(F.col("event_id") % 7 != 3, span), at=F.timestamp_millis(F.unix_millis("at") + F.col("ms"))).where("span_id is not null")
    return start.unionByName(end).unionByName(of(spans.TOKENS, input_tokens=F.col("k"), output_tokens=F.lit(1))).unionByName(of(spans.RETRIEVAL, chunks=F.col("found"), reranker=F.col("by")))


def _told(traces):
    took = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["duration_ms"], F.lit(0)))
    named = F.array_join(F.transform("spans", lambda x: F.concat(x["span_id"], F.lit(":"), x["name"], F.lit(":"), F.coalesce(x["duration_ms"].cast("string"), F.lit("open")))), ",")
    return traces.select("trace_id", F.size("spans").alias("n_spans"), took.alias("latency_ms"), named.alias("spans"), "total_tokens", "chunks_retrieved", "reranker_used")


@_r.add(
    "WITH t AS (SELECT 't' || (user_id % 16) || '-' || strftime(ts, '%Y%m%d') AS trace_id, epoch_us(ts) // 1000 AS place, event_id, event_type, floor(value)::BIGINT AS ms, (props->>'$.k')::BIGINT AS k, (user_id % 10)::INT AS found, (['none', 'bge', 'llm'])[user_id % 3 + 1] AS who FROM events), "
    "r AS (SELECT trace_id, sum(coalesce(k, 0) + 1)::BIGINT AS total_tokens, max({'place': place, 'found': found, 'who': who}) AS m FROM t GROUP BY trace_id), "
    "s AS (SELECT trace_id, count(*)::INT AS n_spans, sum(CASE WHEN event_id % 7 <> 3 THEN ms ELSE 0 END)::BIGINT AS latency_ms, string_agg('s' || event_id || ':' || event_type || ':' || CASE WHEN event_id % 7 <> 3 THEN ms::VARCHAR ELSE 'open' END, ',' ORDER BY place, 's' || event_id) AS spans FROM t WHERE event_id % 11 <> 5 GROUP BY trace_id) "
    "SELECT r.trace_id, coalesce(n_spans, 0) AS n_spans, coalesce(latency_ms, 0) AS latency_ms, coalesce(spans, '') AS spans, total_tokens, m.found AS chunks_retrieved, m.who AS reranker_used FROM r LEFT JOIN s ON s.trace_id = r.trace_id"
)
def trace_pairs(spark, d):
    return _told(spans.pair_batch(records(spark, d)))


@_r.add()
def trace_stream(spark, d):
    """The same traces from a stream that is stopped and goes on."""
    return _told(spans.replay(spark, records(spark, d), new_folder(spark, "spans"), gap_seconds=2 * 86400, late="1 day"))
