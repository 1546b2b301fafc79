"""Context text, citations, token estimates and chat checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import LIMITS, RERANKERS

MAX_MESSAGES, MAX_CONTENT = 50, 2000
ROLES = ("user", "assistant")


def block(rank: Column, path: Column, start: Column, end: Column, kind: Column, name: Column, content: Column, imports: Column, exports: Column) -> Column:
    """The numbered block of one chunk."""
    listed = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise("none")
    return F.concat(
        F.lit("\n--- Chunk "), rank.cast("string"), F.lit(" ---\nFile: "), path, F.lit("\nLines: "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit("\nType: "), kind,
        F.lit("\nName: "), name, F.lit("\n\n"), content, F.lit("\n\n[Imports: "), listed(imports), F.lit("]\n[Exports: "), listed(exports), F.lit("]\n"),
    )


def joined(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The blocks of a result in rank order, as one text for each group (column context)."""
    rows = hits.withColumn("_block", block(*(F.col(c) for c in ("rank", "filepath", "start_line", "end_line", "node_type", "name", "content", "imports", "exports"))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_block"))), lambda x: x["_block"]), "\n")
    return rows.groupBy(*(by or [])).agg(F.concat(F.lit("<codebase_context>\n"), text, F.lit("\n</codebase_context>")).alias("context"))


def citations(hits: DataFrame) -> DataFrame:
    return hits.orderBy("rank").select("filepath", "start_line", "end_line")


def preview(content: Column, lines: int = 5) -> Column:
    return F.array_join(F.slice(F.split(content, "\n"), 1, lines), "\n")


def input_tokens(chars: Column) -> Column:
    """Estimate from the summed length of contents and query."""
    return F.ceil(chars / 4).cast("long")


def last_user_message(messages: DataFrame) -> DataFrame:
    """(conv_id, text) of each conversation's last user message."""
    return messages.where(F.col("role") == "user").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def chat_errors(messages: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(conv_id, error): the first rule that a conversation breaks; null if none.

    Too many messages, then each message in order of turn: role, content, length.  With `requests`
    (conv_id, top_k, reranker) first whether there are messages at all, and last the options.
    """
    own = F.when(F.col("role").isNull() | ~F.col("role").isin(*ROLES), "invalid role").when(F.col("text").isNull(), "content is required").when(F.length("text") > MAX_CONTENT, "content too long")
    rows = messages.withColumn("_own", own).groupBy("conv_id").agg(F.count("*").alias("n"), F.min_by("_own", F.when(F.col("_own").isNotNull(), F.struct("turn", "_own"))).alias("own"))
    error = F.when(F.col("n") > MAX_MESSAGES, "too many messages").otherwise(F.col("own"))
    if requests is None:
        return rows.select("conv_id", error.alias("error"))
    low, high = LIMITS["top_k"]
    option = F.when(~F.col("top_k").between(low, high), f"top_k must be between {low} and {high}").when(~F.col("reranker").isin(*RERANKERS), "reranker must be one of " + ", ".join(RERANKERS))
    both = requests.select("conv_id", "top_k", "reranker").join(rows, "conv_id", "left")
    return both.select("conv_id", F.when(F.col("n").isNull(), "messages are required").otherwise(F.coalesce(error, option)).alias("error"))


def decode_stream(rows: DataFrame) -> DataFrame:
    """(seq, kind, body) of protocol lines: 2 chunks, 0 text, d done, 3 error."""
    names = F.create_map(*(F.lit(x) for x in ("2", "chunks", "0", "text", "d", "done", "3", "error")))
    return rows.select("seq", F.element_at(names, F.substring("line", 1, 1)).alias("kind"), F.expr("substr(line, 3)").alias("body")).where("kind is not null")
