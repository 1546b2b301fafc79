"""Retrieval: vector stage, graph stage, reranking, and the search service with validated options."""

from __future__ import annotations

import re
import sys
import threading
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, vector

#: Bounds of the options and the longest query.
LIMITS = {"top_k": (1, 50), "max_hops": (0, 5), "max_expanded_chunks": (1, 100)}
RERANKERS = ("none", "bge", "llm")
MAX_QUERY = 2000
EXCERPT, PENALTY = 500, 0.1
#: Fixed value: seconds that a reranking model has.
RERANK_SECONDS = 30.0
#: Positions of a model's answer that are read; more than any request's hits.
MAX_PICKS = 200


@dataclass(frozen=True)
class Options:
    top_k: int = 10
    min_score: float = 0.0
    expand_graph: bool = True
    max_hops: int = 2
    max_expanded_chunks: int = 20
    reranker: str = "bge"
    rerank_top_k: int = 5
    strict: bool = False
    repository_id: str | None = None


def validate(query: object, given: dict) -> str | None:
    """The first thing wrong with a request, or None."""
    if not isinstance(query, str) or not query.strip():
        return "query is required"
    if len(query) > MAX_QUERY:
        return f"query exceeds {MAX_QUERY} characters"
    for name, (low, high) in LIMITS.items():
        if name in given and (isinstance(given[name], bool) or not isinstance(given[name], (int, float)) or not low <= given[name] <= high):
            return f"{name} must be between {low} and {high}"
    if "reranker" in given and given["reranker"] not in RERANKERS:
        return "reranker must be one of " + ", ".join(RERANKERS)
    return None


def vector_stage(store: DataFrame, query: Sequence[float], o: Options) -> DataFrame:
    """Chunks with score, rank and stage; the wide vector column ends here."""
    where = F.col("repository_id") == o.repository_id if o.repository_id is not None else None
    hits = vector.top_k(store, query, o.top_k, o.min_score, o.strict, where=where).drop("embedding", "norm")
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).withColumn("stage", F.lit("vector"))


def _held(rows: DataFrame) -> DataFrame:
    """A stage's rows, `top_k` at most, computed once and not again by each later use."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def graph_stage(hits: DataFrame, chunks: DataFrame, edges: DataFrame, o: Options) -> DataFrame:
    """Chunks of the hits' files and of files near them, in file order; hits keep their score, others have 0."""
    hits = _held(hits)
    start = hits.groupBy("filepath").agg(F.min("rank").alias("rank"))
    files = sorted({r.filepath for r in hits.select("filepath").collect() if r.filepath is not None})
    there = chunks.where(F.col("filepath").isin(files)).select("filepath").distinct()  # the filter reaches the scan
    known = _held(start.join(F.broadcast(there), "filepath", "left_semi"))
    near = graph.expanded_chunks(edges, chunks.drop("embedding", "norm"), known, o.max_hops, o.max_expanded_chunks)
    scores = hits.select("id", F.col("score").alias("_score"), F.col("rank").alias("vector_rank"))
    return near.join(F.broadcast(scores), "id", "left").withColumn("score", F.coalesce("_score", F.lit(0.0))).drop("_score").withColumn("stage", F.lit("graph"))


def first_k(hits: DataFrame, k: int) -> DataFrame:
    """The first k unchanged: what a failed reranker leaves."""
    return hits.where(F.col("rank") <= k).withColumn("stage", F.lit("reranked"))


def rerank_by(hits: DataFrame, scorer: Callable[[str, DataFrame], DataFrame], query: str, k: int) -> DataFrame:
    """The best k by a scorer that gives (id, rerank_score), perhaps with an `error`; missing scores are 0, ties keep their order.

    k or fewer hits stay as they are; a scorer that fails, here or in a task, leaves the first k.
    """
    try:
        scores = scorer(query, hits)
    except Exception:  # a model's failures are of any kind
        return first_k(hits, k)
    if "error" not in scores.columns:
        scores = scores.withColumn("error", F.lit(None).cast("string"))
    every = Window.partitionBy()  # hits are max_expanded_chunks at most
    rows = hits.join(scores.select("id", "rerank_score", "error"), "id", "left")
    rows = rows.withColumn("_few", F.count("*").over(every) <= k).withColumn("_failed", F.count("error").over(every) > 0)
    as_is = F.col("_few") | F.col("_failed")
    value = F.when(as_is, F.col("score")).otherwise(F.coalesce("rerank_score", F.lit(0.0)))
    order = [F.when(as_is, F.lit(0.0)).otherwise(-value), F.col("rank")]
    out = rows.withColumn("score", value).withColumn("stage", F.lit("reranked")).withColumn("_at", F.row_number().over(Window.orderBy(*order)))
    return out.where(F.col("_at") <= k).withColumn("rank", F.col("_at")).drop("_few", "_failed", "_at", "rerank_score", "error")


def model_scorer(load: Callable[[], Callable[[str, list[str]], Sequence[float]]], limit_s: float = RERANK_SECONDS) -> Callable[[str, DataFrame], DataFrame]:
    """A scorer that runs a model in the tasks: `load` gives it once a task, and it scores a batch of passages at a time.

    (id, rerank_score, error): a batch that raises, answers with another number of scores or takes
    longer than `limit_s` has null scores and says why; the plan then keeps the first k.
    """

    def scorer(query: str, hits: DataFrame) -> DataFrame:
        read = passage(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("filepath", "start_line", "end_line", "node_type", "name", "content")))
        schema = f"id {hits.schema['id'].dataType.simpleString()}, rerank_score double, error string"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model: list = []
            for batch in batches:
                scores, error = _within(limit_s, load, model, query, batch.column(1).to_pylist())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores or [None] * n, pa.float64()), pa.array([error] * n, pa.string())], ["id", "rerank_score", "error"])

        return hits.select("id", read.alias("passage")).mapInArrow(run, schema)

    return scorer


def _within(limit_s: float, load: Callable, model: list, query: str, passages: list[str]) -> tuple[list[float] | None, str | None]:
    """The scores of a batch, or why there are none."""
    out: list = []

    def work() -> None:
        try:
            if not model:
                model.append(load())
            scores = [float(x) for x in model[0](query, passages)]
            out.append((scores, None) if len(scores) == len(passages) else (None, f"{len(scores)} scores for {len(passages)} passages"))
        except Exception as e:  # a model's failures are of any kind
            out.append((None, f"{type(e).__name__}: {e}"))

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    thread.join(limit_s)
    return out[0] if out else (None, f"no answer in {limit_s} s")


def passage(path: Column, start: Column, end: Column, kind: Column, name: Column, content: Column) -> Column:
    """What a cross-encoder reads of a chunk."""
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(" ("), kind, F.lit(": "), name, F.lit(")\n"), content)


def overlap_scorer(query: str, hits: DataFrame) -> DataFrame:
    """The offline scorer: the share of the query's words that a chunk has."""
    words = sorted(set(re.findall(r"\w+", query.lower())))
    own = F.array_distinct(F.split(F.lower("content"), r"\W+"))
    return hits.select("id", (F.size(F.array_intersect(own, F.array(*map(F.lit, words)).cast("array<string>"))) / max(len(words), 1)).alias("rerank_score"))


def rank_answer(answer: str, n: int, k: int) -> list[int]:
    """Valid positions in the first bracketed list of numbers of a model's answer, k at most."""
    m = re.search(r"\[[\d,\s]*\]", answer or "")
    return [i for i in map(int, re.findall(r"\d+", m[0])) if i < n][:k] if m else []


def rerank_by_answer(hits: DataFrame, answer: str, k: int) -> DataFrame:
    """Hits in the order of a model's answer, with scores falling by a tenth; the first k where it is unusable.

    Positions beyond the hits don't count; k or fewer hits stay as they are.
    """
    picks = F.array(*(F.lit(i + 1) for i in rank_answer(answer, sys.maxsize, MAX_PICKS))).cast("array<int>")
    n = F.count("*").over(Window.partitionBy())
    valid = F.slice(F.filter("_picks", lambda i: i <= F.col("_n")), 1, k)
    rows = hits.withColumn("_picks", picks).withColumn("_n", n).withColumn("_picks", valid)
    place = F.array_position("_picks", F.col("rank").cast("int"))
    as_is = (F.col("_n") <= k) | (F.size("_picks") == 0)
    rows = rows.withColumn("_place", F.when(as_is, F.col("rank").cast("long")).otherwise(place)).where((F.col("_place") > 0) & (F.col("_place") <= k))
    score = F.when(as_is, F.col("score")).otherwise(1 - PENALTY * (F.col("_place") - 1))
    return rows.withColumn("score", score).withColumn("rank", F.col("_place").cast("int")).withColumn("stage", F.lit("reranked")).drop("_picks", "_n", "_place")


def prompt(query: str, hits: DataFrame) -> str:
    """The request to a model that ranks: numbered excerpts of the hits, which are 100 at most."""
    rows = hits.orderBy("rank").select("filepath", "name", F.substring("content", 1, EXCERPT).alias("content")).collect()
    listed = "\n\n".join(f"[{k}] {r.filepath}: {r.name}\n{r.content}" for k, r in enumerate(rows))
    return f"Rank the code by relevance to the query. Answer with a JSON array of its numbers, best first.\n\nQuery: {query}\n\n{listed}"


def rerank(hits: DataFrame, query: str, o: Options, scorer=overlap_scorer, ask: Callable[[str], str] | None = None) -> DataFrame:
    """By the reranker's name: none, bge by the scorer, llm by what `ask` says to the prompt; a failure leaves the first k."""
    if o.reranker == "none":
        return hits
    hits = _held(hits)  # LIMITS bound them
    if o.reranker == "bge":
        return rerank_by(hits, scorer, query, o.rerank_top_k)
    try:
        if ask is None:
            raise ValueError("no model to ask")
        answer = ask(prompt(query, hits))
    except Exception:  # a model's failures are of any kind
        return first_k(hits, o.rerank_top_k)
    return rerank_by_answer(hits, answer, o.rerank_top_k)


def retrieve(store: DataFrame, edges: DataFrame | None, query: Sequence[float], text: str = "", options: Options | None = None, scorer=overlap_scorer, ask=None) -> DataFrame:
    """Vector top-k, graph expansion, rerank, each computed once; an empty vector stage empties all."""
    o = options or Options()
    hits = vector_stage(store, query, o)
    if o.expand_graph and edges is not None:
        hits = graph_stage(hits, store, edges, o)
    return rerank(hits, text, o, scorer, ask)


#: What the service returns of a chunk, as far as the store has it.
RESULT = ("filepath", "start_line", "end_line", "node_type", "name", "content", "score", "language")


def search(store: DataFrame, edges: DataFrame | None, query: str, embed: Callable[[str], Sequence[float]], given: dict | None = None, scorer=overlap_scorer, ask=None) -> DataFrame:
    """The service: from a query's text to ranked results (RESULT, rank, stage); ValueError for a bad request.

    Options are the service's own with the given ones over them.  Without a graph, or when expansion is
    turned off, it is the vector stage alone with the reranker's k.
    """
    if error := validate(query, given or {}):
        raise ValueError(error)
    o = Options(**({"reranker": "llm", "max_expanded_chunks": 15} | (given or {})))
    if edges is None or not o.expand_graph:
        hits = vector_stage(store, embed(query), replace(o, top_k=o.rerank_top_k))
    else:
        hits = retrieve(store, edges, embed(query), query, o, scorer, ask)
    return hits.select(*(c for c in RESULT if c in hits.columns), "rank", "stage").orderBy("rank")


def stage_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("stage").agg(F.count("*").alias("chunks"), F.count_if(F.col("score") == 0).alias("added"))
