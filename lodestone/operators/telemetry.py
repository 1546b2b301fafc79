"""Telemetry: costs and roll-ups over a traces table."""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Dollars for a million tokens.
EMBEDDING_PRICES = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13, "text-embedding-ada-002": 0.10, "models/text-embedding-004": 0.00}
LLM_PRICES = {
    "claude-sonnet-4-20250514": (3.0, 15.0), "claude-3-5-sonnet-20241022": (3.0, 15.0), "claude-3-haiku-20240307": (0.25, 1.25), "claude-3-opus-20240229": (15.0, 75.0), "gpt-4o": (2.5, 10.0),
    "gpt-4o-mini": (0.15, 0.60), "gpt-4-turbo": (10.0, 30.0), "gemini-1.5-pro": (1.25, 5.0), "gemini-1.5-flash": (0.075, 0.30),
}
DEFAULT_EMBEDDING, DEFAULT_INPUT, DEFAULT_OUTPUT = 0.02, 3.0, 15.0
#: Traces that are kept, and those that performance is read from.
RING, PERFORMANCE = 1000, 500
DAY_MS = 24 * 60 * 60 * 1000


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in LLM_PRICES.items()], "model string, input_price double, output_price double")


def with_costs(usage: DataFrame, embedding_model: str = "text-embedding-3-small") -> DataFrame:
    """usage (model, input_tokens, output_tokens, …) with its four costs; unknown models have default prices."""
    rows = usage.join(F.broadcast(prices(usage.sparkSession)), "model", "left")  # nine rows
    per = lambda tokens, price, default: F.col(tokens) * F.coalesce(price, F.lit(default)) / 1_000_000
    rows = rows.withColumn("embedding_cost", F.lit(EMBEDDING_PRICES.get(embedding_model, DEFAULT_EMBEDDING) / 1_000_000))
    rows = rows.withColumn("llm_input_cost", per("input_tokens", "input_price", DEFAULT_INPUT)).withColumn("llm_output_cost", per("output_tokens", "output_price", DEFAULT_OUTPUT))
    return rows.withColumn("total_cost", F.col("embedding_cost") + F.col("llm_input_cost") + F.col("llm_output_cost")).drop("input_price", "output_price")


def exact_percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The elements at floor(n * share) of each group's sorted values: values are counted, and running counts find the places.

    Groups may be of any size: counts combine before the shuffle, and a hot group costs its distinct values.
    """
    from pyspark.sql import Window

    own = Window.partitionBy(*by)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    counted = counted.withColumn("_upto", F.sum("_n").over(own.orderBy(value))).withColumn("_all", F.sum("_n").over(own))
    return counted.groupBy(*by).agg(*(F.min(F.when(F.col("_upto") > F.floor(F.col("_all") * F.lit(q)), F.col(value))).alias(name) for name, q in shares.items()))


#: Buckets of the latency sketch for each power of two, and parts that a bracket is cut into.
_FINE, _PARTS = 64, 4096


def latency_bucket(value: Column) -> Column:
    """The bucket of a whole number that is not negative: itself below 64, then 64 buckets for each power of two.

    Counts by bucket merge by addition, a few thousand rows at most.
    """
    v = F.greatest(value.cast("long"), F.lit(0).cast("long"))
    e = F.length(F.bin(v)) - 1
    return F.when(v < _FINE, v).otherwise((e - 5) * _FINE + F.call_function("shiftright", v, F.greatest(e - 6, F.lit(0))) - _FINE).cast("long")


def bucket_bounds(bucket: int) -> tuple[int, int]:
    """The least and the greatest number of a bucket."""
    if bucket < _FINE:
        return bucket, bucket
    wide = bucket // _FINE - 1
    low = (bucket % _FINE + _FINE) << wide
    return low, low + (1 << wide) - 1


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], counts: dict[int, int] | None = None) -> dict[str, int | None]:
    """The elements at floor(n * share) of all sorted values, exactly; values are whole and not negative.

    The counts by bucket (of stored states, or counted here) name a bracket for each share; values in
    the brackets are counted again in ever finer parts.  Nothing is sorted and no task sees all values.
    """
    known = rows.where(F.col(value).isNotNull())
    if counts is None:
        counts = {r.b: r.n for r in known.groupBy(latency_bucket(F.col(value)).alias("b")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return dict.fromkeys(shares)
    open_, done = {}, {}
    for name, q in shares.items():
        place = min(math.floor(total * q), total - 1)
        for b in sorted(counts):
            if place < counts[b]:
                open_[name] = (*bucket_bounds(b), place)
                break
            place -= counts[b]
    while open_:
        for name in [n for n, (low, high, _) in open_.items() if low == high]:
            done[name] = open_.pop(name)[0]
        brackets = sorted({(low, high) for low, high, _ in open_.values()})
        if not brackets:
            break
        step = {b: -(-(b[1] - b[0] + 1) // _PARTS) for b in brackets}
        number = F.coalesce(*(F.when(F.col(value).between(*b), F.lit(k)) for k, b in enumerate(brackets)))
        part = F.coalesce(*(F.when(F.col(value).between(*b), F.floor((F.col(value) - b[0]) / step[b])) for b in brackets))
        found = known.select(F.col(value).cast("long").alias(value)).select(number.alias("k"), part.alias("p")).where("k is not null").groupBy("k", "p").agg(F.count("*").alias("n")).orderBy("k", "p").collect()
        for name, (low, high, place) in list(open_.items()):
            k = brackets.index((low, high))
            for r in (r for r in found if r.k == k):
                if place < r.n:
                    a = low + r.p * step[low, high]
                    open_[name] = (a, min(high, a + step[low, high] - 1), place)
                    break
                place -= r.n
    return done


def daily_states(traces: DataFrame) -> DataFrame:
    """Partial states by day, mode, reranker, success and latency bucket; states of any days merge by addition."""
    rows = traces.withColumn("latency", latency(F.col("spans")))
    day = F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd")
    return rows.groupBy(day.alias("day"), "mode", "reranker_used", "success", latency_bucket(F.col("latency")).alias("bucket")).agg(
        F.count("*").alias("n"), F.sum("latency").alias("latency"), F.coalesce(F.sum("token_usage.total_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("cost_estimate.total_cost"), F.lit(0.0)).alias("cost"),
        F.coalesce(F.sum("chunks_retrieved"), F.lit(0)).alias("chunks"), F.count("chunks_retrieved").alias("n_chunks"),
    )


def merged_metrics(states: DataFrame, traces: DataFrame, first: str, last: str, shares: dict[str, float] | None = None) -> DataFrame:
    """Metrics of the days from first to last, of their states; percentiles look at the traces only inside their brackets."""
    shares = {"p50_latency": 0.5, "p95_latency": 0.95, "p99_latency": 0.99} if shares is None else shares
    own = states.where(F.col("day").between(first, last))
    counts = {r.bucket: r.n for r in own.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    day = F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd")
    rows = traces.where(day.between(first, last)).withColumn("latency", latency(F.col("spans")))
    high = quantiles(rows, "latency", shares, counts)
    mean = lambda a, b: F.coalesce(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return own.agg(
        zero(F.sum("n")).alias("requests"), zero(F.sum(F.when(F.col("success"), F.col("n")))).alias("succeeded"), zero(F.sum(F.when(~F.col("success"), F.col("n")))).alias("failed"), zero(F.sum("tokens")).alias("tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), mean("latency", "n").alias("average_latency"), mean("chunks", "n_chunks").alias("average_chunks"), *(F.lit(v or 0).cast("long").alias(k) for k, v in high.items()),
    )


def latency(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["duration_ms"], F.lit(0)))


def metrics(traces: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """One row over traces from start to end (epoch ms, inclusive); zeros and empty maps without any.

    Without an end it is now, without a start a day before the end.
    """
    end = end if end is not None else int(time.time() * 1000)
    start = start if start is not None else end - DAY_MS
    rows = traces.where(F.col("timestamp").between(start, end)).withColumn("latency", latency(F.col("spans")))
    total = rows.agg(
        F.count("*").alias("requests"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum("token_usage.total_tokens"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("cost_estimate.total_cost"), F.lit(0.0)).alias("cost"), F.coalesce(F.avg("latency"), F.lit(0.0)).alias("average_latency"), F.coalesce(F.avg("chunks_retrieved"), F.lit(0.0)).alias("average_chunks"),
    )
    p95 = quantiles(rows, "latency", {"p95_latency": 0.95})["p95_latency"] or 0
    count = lambda c: rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(c, "n"))).alias(f"by_{c}"))
    return total.withColumn("p95_latency", F.lit(p95).cast("long")).crossJoin(count("mode")).crossJoin(count("reranker_used"))


def recent(traces: DataFrame, n: int, order: str = "timestamp", key: str = "id") -> DataFrame:
    """The n latest, newest first; each task keeps n."""
    return traces.orderBy(F.desc(order), F.desc(key)).limit(n)


def view(traces: DataFrame, n: int = 50) -> DataFrame:
    """The latest traces for a list: long queries are cut, spans summed; 200 at most."""
    cut = F.when(F.length("query") > 100, F.concat(F.substring("query", 1, 100), F.lit("..."))).otherwise(F.col("query"))
    return recent(traces, min(n, 200)).select("id", "timestamp", cut.alias("query"), "mode", "success", latency(F.col("spans")).alias("latency_ms"), "token_usage.total_tokens", "cost_estimate.total_cost")


def by_id(traces: DataFrame, key: str) -> DataFrame:
    return traces.where(F.col("id") == key)


def recorded(traces: DataFrame, spans: DataFrame, usage: DataFrame) -> DataFrame:
    """Traces with their spans and summed tokens, from tables of single records.

    traces: id and more; spans: (id, name, start_ms, end_ms), open ones with a null end; usage: (id,
    input_tokens, output_tokens).  A trace without records has no spans and zero tokens.
    """
    took = spans.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    listed = took.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "name", "end_ms", "duration_ms"))).alias("_s"))
    tokens = usage.groupBy("id").agg(F.sum("input_tokens").alias("_i"), F.sum("output_tokens").alias("_o"))
    rows = traces.join(listed, "id", "left").join(tokens, "id", "left")
    kind = "array<struct<name:string,start_ms:bigint,end_ms:bigint,duration_ms:bigint>>"
    ordered = F.transform("_s", lambda x: F.struct(x["name"], x["start_ms"].cast("long"), x["end_ms"].cast("long"), x["duration_ms"].cast("long"))).cast(kind)
    i, o = (F.coalesce(c, F.lit(0)).cast("long") for c in ("_i", "_o"))
    use = F.struct(i.alias("input_tokens"), o.alias("output_tokens"), (i + o).alias("total_tokens"))
    return rows.withColumn("spans", F.coalesce(ordered, F.array().cast(kind))).withColumn("token_usage", use).drop("_s", "_i", "_o")


def cost_by_day(traces: DataFrame, since: int, last: int = RING) -> DataFrame:
    """(day, requests, tokens, cost) by UTC day, and a total row whose day is null, over the `last` traces."""
    day = F.date_format(F.timestamp_millis("timestamp"), "yyyy-MM-dd")
    return recent(traces, last).where(F.col("timestamp") >= since).rollup(day.alias("day")).agg(F.count("*").alias("requests"), F.sum("token_usage.total_tokens").alias("tokens"), F.sum("cost_estimate.total_cost").alias("cost"))


def cost_breakdown(traces: DataFrame, since: int, last: int = RING) -> DataFrame:
    """One row of the three parts of the cost of the `last` traces: embedding, llm_input, llm_output."""
    part = lambda c: F.coalesce(F.sum(f"cost_estimate.{c}_cost"), F.lit(0.0)).alias(c)
    return recent(traces, last).where(F.col("timestamp") >= since).agg(*map(part, ("embedding", "llm_input", "llm_output")))


def latency_by_stage(traces: DataFrame, last: int = PERFORMANCE) -> DataFrame:
    """(name, n, average, p50, p95, p99) of span durations of the `last` traces."""
    spans = recent(traces, last).select(F.explode("spans").alias("s")).select("s.name", "s.duration_ms").where("duration_ms is not null")
    high = exact_percentiles(spans, ["name"], "duration_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return spans.groupBy("name").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("average")).join(high, "name")


def success_rate(traces: DataFrame, last: int = PERFORMANCE) -> DataFrame:
    return recent(traces, last).agg(F.coalesce(100.0 * F.count_if("success") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("success_rate"))


VIEWS = {"metrics": metrics, "traces": view, "costs": cost_by_day, "breakdown": cost_breakdown, "latency": latency_by_stage}


def by_view(name: str):
    """The function of a view; an error that lists the valid ones."""
    if name not in VIEWS:
        raise ValueError(f"unknown view {name!r}; valid: {', '.join(VIEWS)}")
    return VIEWS[name]
