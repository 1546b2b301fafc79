"""Context, chat and answer operators over `documents` and `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analyzers, context, substring
from ..sources.shared import new_folder
from .tables import Registry, read

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


@_r.add("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark, d):
    return context.last_user_message(read(spark, d, "conversations"))


_OWN = "CASE WHEN role IS NULL OR role NOT IN ('user', 'assistant') THEN 'invalid role' WHEN text IS NULL THEN 'content is required' WHEN length(text) > 2000 THEN 'content too long' END"
_ERRORS = f"SELECT conv_id, CASE WHEN count(*) > 50 THEN 'too many messages' ELSE arg_min(own, turn) FILTER (own IS NOT NULL) END AS error FROM (SELECT *, {_OWN} AS own FROM conversations) GROUP BY conv_id"


@_r.add(_ERRORS)
def chat_validation(spark, d):
    return context.chat_errors(read(spark, d, "conversations"))


@_r.add(
    f"WITH e AS ({_ERRORS}), r AS (SELECT DISTINCT conv_id + 1 AS conv_id FROM conversations) SELECT r.conv_id, CASE WHEN e.conv_id IS NULL THEN 'messages are required' WHEN error IS NOT NULL THEN error "
    "WHEN r.conv_id % 60 NOT BETWEEN 1 AND 50 THEN 'top_k must be between 1 and 50' WHEN r.conv_id % 7 = 3 THEN 'reranker must be one of none, bge, llm' END AS error FROM r LEFT JOIN e ON e.conv_id = r.conv_id"
)
def chat_requests(spark, d):
    """A request for the conversation after each one, some without messages or with options out of bounds."""
    rows = read(spark, d, "conversations")
    asked = rows.select((F.col("conv_id") + 1).alias("conv_id")).distinct()
    asked = asked.withColumn("top_k", (F.col("conv_id") % 60).cast("int")).withColumn("reranker", F.when(F.col("conv_id") % 7 == 3, "other").otherwise("bge"))
    return context.chat_errors(rows, asked)


@_r.add("SELECT conv_id, ceil(sum(length(text)) / 4.0)::BIGINT AS input_tokens, sum(ceil(length(text) / 4.0))::BIGINT AS output_tokens FROM conversations GROUP BY conv_id")
def token_estimate(spark, d):
    return read(spark, d, "conversations").groupBy("conv_id").agg(context.input_tokens(F.sum(F.length("text"))).alias("input_tokens"), F.sum(context.input_tokens(F.length("text"))).alias("output_tokens"))


@_r.add(
    "SELECT lang, length(c) AS length, md5(c) AS digest FROM (SELECT lang, '<codebase_context>' || chr(10) || string_agg(chr(10) || '--- Chunk ' || rank || ' ---' || chr(10) || 'File: ' || source || chr(10) || 'Lines: 1-' || doc_id || chr(10) || 'Type: function' || chr(10) || 'Name: d' || doc_id || chr(10) || chr(10) || text || chr(10) || chr(10) || '[Imports: none]' || chr(10) || '[Exports: ' || lang || ', x]' || chr(10), chr(10) ORDER BY rank) || chr(10) || '</codebase_context>' AS c "
    "FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 5 GROUP BY lang)"
)
def context_text(spark, d):
    """The context of each language's first five documents."""
    from pyspark.sql import Window

    docs = read(spark, d, "documents").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("rank <= 5")
    hits = docs.select("lang", "rank", F.col("source").alias("filepath"), F.lit(1).alias("start_line"), F.col("doc_id").alias("end_line"), F.lit("function").alias("node_type"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("content"), F.array().cast("array<string>").alias("imports"), F.array("lang", F.lit("x")).alias("exports"))
    c = context.joined(hits, ["lang"])
    return c.select("lang", F.length("context").alias("length"), F.md5(F.col("context").cast("binary")).alias("digest"))


@_r.add("SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[1:5], chr(10))) AS preview FROM documents")
def citation_preview(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(context.preview(F.col("text")).cast("binary")).alias("preview"))


@_r.add(
    "SELECT conv_id, turn, concat_ws(',', 'text', CASE WHEN regexp_matches(text, 'import\\s+.*from|require\\(') THEN 'deps' END, CASE WHEN regexp_matches(text, 'function\\s+\\w+|const\\s+\\w+\\s*=\\s*(async\\s+)?\\(') THEN 'calls' END, "
    "CASE WHEN regexp_matches(text, 'function\\s+\\w+|const\\s+\\w+\\s*=\\s*(async\\s+)?\\(') THEN 'complexity' END, CASE WHEN regexp_matches(text, 'interface\\s+\\w+|type\\s+\\w+\\s*=|:\\s*\\w+[\\w<>,\\s]*') THEN 'types' END) AS views FROM conversations"
)
def answer_views(spark, d):
    rows = read(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.array_join(analyzers.views(F.col("text"), F.lit("")), ",").alias("views"))


@_r.add("SELECT conv_id * 1000 + turn AS seq, (['chunks', 'text', 'done', 'error'])[turn % 5 + 1] AS kind, coalesce(text, '') AS body FROM conversations WHERE turn % 5 < 4")
def stream_decode(spark, d):
    """Each message as a protocol line; every fifth kind of line is unknown."""
    code = F.element_at(F.array(*map(F.lit, "20d3x")), (F.col("turn") % 5 + 1).cast("int"))
    rows = read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.concat(code, F.lit(":"), F.coalesce("text", F.lit(""))).alias("line"))
    return context.decode_stream(rows)


@_r.add()
def substring_search(spark, d):
    """Documents that hold a word anywhere, from an index of all their trigrams."""
    path = new_folder(spark, "grams")
    substring.build(read(spark, d, "documents").select("doc_id", "text", "source"), path, "doc_id", ["text"])
    return substring.search(spark, path, "License").select("doc_id", "source")
