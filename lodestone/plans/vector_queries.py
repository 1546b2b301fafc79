"""Vector store, embedding and retrieval quality over `embeddings`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ann, embedding, evaluation, retrieval, vector
from ..sources import index_store, versioned
from ..sources.shared import new_folder
from .tables import Registry, read

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

_SCORED = "SELECT e.vec_id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _query(store):
    """The vector of row 0: one row of a fixed id."""
    return [float(x) for x in store.where("vec_id = 0").first()["embedding"]]


def _shown(rows):
    return rows.select("vec_id", F.round("score", 6).alias("score"))


@_r.add(f"SELECT vec_id, round(s, 6) AS score FROM ({_SCORED}) WHERE s >= 0 ORDER BY s DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    store = read(spark, d, "embeddings")
    return _shown(vector.top_k(store, _query(store), 10, key="vec_id"))


@_r.add(f"SELECT vec_id, round(s, 6) AS score FROM ({_SCORED}) WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 50")
def vector_min_score(spark, d):
    store = read(spark, d, "embeddings")
    return _shown(vector.top_k(store, _query(store), 50, 0.2, key="vec_id"))


@_r.add(f"SELECT vec_id, round(s, 6) AS score FROM ({_SCORED}) WHERE s > 0.3 ORDER BY s DESC, vec_id LIMIT 10")
def vector_strict(spark, d):
    store = read(spark, d, "embeddings")
    return _shown(vector.top_k(store, _query(store), 10, 0.3, strict=True, key="vec_id"))


@_r.add(f"SELECT 'defaults' AS asked, vec_id, label, round(s, 6) AS similarity FROM (SELECT * FROM ({_SCORED}) WHERE s > 0.3 ORDER BY s DESC, vec_id LIMIT 10) UNION ALL SELECT 'given', vec_id, label, round(s, 6) FROM (SELECT * FROM ({_SCORED}) WHERE s > 0.1 ORDER BY s DESC, vec_id LIMIT 25)")
def search_function(spark, d):
    """The table function in SQL text, with its defaults and with given bounds."""
    store = read(spark, d, "embeddings")
    vector.register_search(spark, store, key="vec_id")
    q = "array(" + ", ".join(f"{x!r}D" for x in _query(store)) + ")"
    return spark.sql(f"SELECT 'defaults' AS asked, vec_id, label, round(similarity, 6) AS similarity FROM search_chunks({q}) UNION ALL SELECT 'given', vec_id, label, round(similarity, 6) FROM search_chunks({q}, min_similarity => 0.1D, match_count => 25)")


@_r.add(f"SELECT vec_id, round(s, 6) AS score FROM ({_SCORED}) WHERE label = 3 AND s >= 0 ORDER BY s DESC, vec_id LIMIT 10")
def vector_filtered(spark, d):
    store = read(spark, d, "embeddings")
    return _shown(vector.top_k(store, _query(store), 10, key="vec_id", where=F.col("label") == 3))


_BATCH = (
    "SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s, "
    "row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q"
)


def _batch(spark, d, k=5):
    store = read(spark, d, "embeddings")
    asked = store.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.batch_top_k(store, asked, k, "vec_id", "query_id")


@_r.add(f"SELECT query_id, vec_id, round(s, 6) AS score, rank FROM ({_BATCH}) WHERE rank <= 5")
def vector_batch_topk(spark, d):
    return _batch(spark, d).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def _asked(spark, d):
    store = read(spark, d, "embeddings")
    return store, store.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@_r.add(f"SELECT query_id, vec_id, round(s, 6) AS score, rank FROM ({_BATCH}) WHERE rank <= 10")
def vector_ann_all_lists(spark, d):
    """Every list probed: the index has each row once, and the answers are exact."""
    store, asked = _asked(spark, d)
    centers = ann.centroids(store, "vec_id")
    found = ann.search(ann.indexed(store, centers), centers, asked, 10, "vec_id", "query_id", probes=len(centers))
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@_r.add("SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, (SELECT count(*) FROM embeddings) AS indexed, count(*) FILTER (vec_id % 100 = 0) * least(10, count(*)) AS wanted, true AS enough FROM embeddings")
def vector_ann_recall(spark, d):
    """Recall of the ten nearest with as many probes as tuning asks for, against the exact scan: 0.9 or more is enough."""
    store, asked = _asked(spark, d)
    centers = ann.centroids(store, "vec_id")
    index = ann.indexed(store, centers)
    probes = ann.probes_for(index, centers, "vec_id")
    found = ann.search(index, centers, asked, 10, "vec_id", "query_id", probes=probes)
    exact = vector.batch_top_k(store, asked, 10, "vec_id", "query_id")
    whole = index.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") == 1).alias("indexed"))
    return ann.recall(found, exact, "vec_id", "query_id").crossJoin(whole).select("queries", "indexed", "wanted", (F.col("recall") >= 0.9).alias("enough"))


@_r.add()
def vector_ann_topk(spark, d):
    """The stored index: written by list, and searched with as many probes as tuning asks for."""
    store, asked = _asked(spark, d)
    path = new_folder(spark, "index")
    ann.build(store, path, "vec_id")
    index, centers = ann.load(spark, path)
    return ann.search(index, centers, asked, 10, "vec_id", "query_id", probes=ann.probes_for(index, centers, "vec_id"))


@_r.add("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 3 = 1")
def store_upsert(spark, d):
    store = read(spark, d, "embeddings").select("vec_id", "label")
    new = store.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100).union(store.where("vec_id % 3 = 1").select(F.col("vec_id") + 1_000_000, "label"))
    return vector.upsert(store, new, ["vec_id"])


@_r.add("SELECT label, max(vec_id) AS vec_id FROM embeddings GROUP BY label")
def store_last_wins(spark, d):
    return vector.last_wins(read(spark, d, "embeddings").select("label", "vec_id"), ["label"], "vec_id")


@_r.add()
def index_upsert(spark, d):
    """Two transactions over an index of all vectors: the second replaces a third of the chunks, adds some and deletes a fifth."""
    rows = read(spark, d, "embeddings").select(
        F.concat(F.lit("r"), (F.col("label") % 3).cast("string")).alias("repository_id"), F.concat(F.lit("c"), F.col("vec_id").cast("string")).alias("id"),
        F.concat(F.lit("f"), F.col("label").cast("string")).alias("filepath"), F.lit(1).cast("long").alias("seq"), "embedding", "vec_id",
    )
    nodes = lambda r: r.select("repository_id", "filepath").distinct()
    edges = lambda r: nodes(r).select("repository_id", F.col("filepath").alias("src"), F.lit("f0").alias("dst"))
    root = new_folder(spark, "index")
    index_store.upsert_index(spark, root, rows.drop("vec_id"), nodes(rows), edges(rows), "all-minilm")
    new = rows.where("vec_id % 3 = 0").withColumn("seq", F.when(F.col("vec_id") % 2 == 0, F.lit(2)).otherwise(F.lit(0)).cast("long")).withColumn("filepath", F.lit("new"))
    new = new.unionByName(rows.where("vec_id % 3 = 1").withColumn("id", F.concat("id", F.lit("+"))))
    index_store.upsert_index(spark, root, new.drop("vec_id"), nodes(new), edges(new), "all-minilm", gone=rows.where("vec_id % 5 = 4").select("repository_id", "id"))
    return versioned.read(spark, root, "embeddings").select("repository_id", "id", "filepath", "seq", F.size("embedding").alias("dimension"))


@_r.add("SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (1, 2, 3) AND label <> 4")
def store_delete(spark, d):
    rows = read(spark, d, "embeddings").select("vec_id", F.col("label").alias("filepath"))
    return vector.delete_path(vector.delete_ids(rows, [1, 2, 3], "vec_id"), 4).withColumnRenamed("filepath", "label")


@_r.add("SELECT count(*) AS count, max(len(embedding)) AS dimension, 'all-minilm' AS model FROM embeddings")
def store_stats(spark, d):
    return vector.stats(read(spark, d, "embeddings"), "all-minilm")


_MODELS = [*vector.DIMENSIONS, "unknown"]


@_r.add(
    "WITH m(model, d) AS (VALUES " + ", ".join(f"('{k}', {v})" for k, v in vector.DIMENSIONS.items()) + f") SELECT doc_id, name AS model, coalesce(d, 1536) AS dimension FROM (SELECT doc_id, ({_MODELS})[doc_id % {len(_MODELS)} + 1] AS name FROM documents) LEFT JOIN m ON m.model = name"
)
def model_dimension(spark, d):
    """Each document with a model of the list or an unknown one."""
    name = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("doc_id") % len(_MODELS) + 1).cast("int"))
    return read(spark, d, "documents").select("doc_id", name.alias("model"), vector.dimension(name).alias("dimension"))


_BYTE = "(('0x' || substr(sha256(text), (i % 32) * 2 + 1, 2))::INT / 255.0::DOUBLE * 2 - 1)"


@_r.add(
    "WITH b AS (SELECT doc_id, list_transform(range(384), lambda i: " + _BYTE + ") AS v FROM documents), n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM b) "
    "SELECT doc_id, len(v) AS dims, round(v[1] / l, 6) AS d0, round(v[34] / l, 6) AS d33, round(v[384] / l, 6) AS d383 FROM n"
)
def mock_embed(spark, d):
    v = read(spark, d, "documents").select("doc_id", embedding.hash_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", F.size("v").alias("dims"), *(F.round(F.col("v")[k], 6).alias(f"d{k}") for k in (0, 33, 383)))


def _hits(spark, d):
    """Each query's nearest five, others than itself; relevant are those of its label."""
    labels = read(spark, d, "embeddings").select("vec_id", "label")
    rows = _batch(spark, d, 6).where("query_id <> vec_id")
    own = rows.join(labels, "vec_id").withColumn("name", F.concat(F.lit("dir/"), "label", F.lit("/f"), "label", F.lit(".ts")))
    lists = own.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("files"))
    wanted = F.array(F.concat(F.lit("f"), F.col("label").cast("string"), F.lit(".ts")))
    return lists.join(F.broadcast(labels.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")), "query_id").select(
        F.col("query_id").alias("id"), "files", F.col("files").alias("chunk_names"), wanted.alias("expected_files"), wanted.alias("expected_chunks")
    )


_EVAL = (
    f"WITH t AS (SELECT b.query_id, b.rank, e.label, q.label AS own FROM ({_BATCH}) b JOIN embeddings e ON e.vec_id = b.vec_id JOIN embeddings q ON q.vec_id = b.query_id WHERE b.rank <= 6 AND b.query_id <> b.vec_id), "
    "u AS (SELECT query_id, label, min(rank) AS rank, any_value(own) AS own FROM t GROUP BY query_id, label), n AS (SELECT query_id, rank, label, own, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM u), "
    "c AS (SELECT query_id, min(p) AS place FROM (SELECT query_id, label, own, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p FROM t) WHERE label = own GROUP BY query_id), "
    "s AS (SELECT n.query_id AS id, sum((label = own)::INT) * 1.0::DOUBLE / count(*) AS precision, max((label = own)::INT)::DOUBLE AS recall, greatest(coalesce(1.0::DOUBLE / min(CASE WHEN label = own THEN n.place END), 0), coalesce(1.0::DOUBLE / any_value(c.place), 0)) AS mrr FROM n LEFT JOIN c ON c.query_id = n.query_id GROUP BY n.query_id) "
)


@_r.add(_EVAL + "SELECT id, round(precision, 6) AS precision, recall, round(mrr, 6) AS mrr FROM s")
def eval_scores(spark, d):
    return evaluation.score(_hits(spark, d)).select("id", F.round("precision", 6).alias("precision"), "recall", F.round("mrr", 6).alias("mrr"))


@_r.add(_EVAL + "SELECT count(*) AS cases, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, sum((recall >= 0.5)::INT)::BIGINT AS passed FROM s")
def eval_summary(spark, d):
    s = evaluation.summary(evaluation.score(_hits(spark, d)))
    return s.select("cases", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr")), "passed")


_CASES_SQL = (
    "WITH a AS (SELECT conv_id * 1000 + turn AS id, coalesce(text, '') AS text, CASE turn % 4 WHEN 0 THEN ['THE', 'de', 'zz'] WHEN 1 THEN ['La', 'und'] WHEN 2 THEN [] ELSE ['.', 'qqq', 'e', 'x'] END::VARCHAR[] AS patterns, role AS category, CASE WHEN conv_id % 2 = 0 THEN 'easy' ELSE 'hard' END AS difficulty FROM conversations), "
    "s AS (SELECT *, len(list_filter(patterns, lambda p: contains(lower(text), lower(p)))) AS found FROM a), r AS (SELECT *, CASE WHEN len(patterns) > 0 THEN found * 1.0::DOUBLE / len(patterns) ELSE 0 END AS score FROM s) "
)


def _patterns(spark, d):
    """Each message as an answer, with patterns by its turn."""
    wanted = F.expr("CASE turn % 4 WHEN 0 THEN array('THE', 'de', 'zz') WHEN 1 THEN array('La', 'und') WHEN 2 THEN cast(array() AS array<string>) ELSE array('.', 'qqq', 'e', 'x') END")
    rows = read(spark, d, "conversations")
    return evaluation.pattern_score(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"), wanted.alias("patterns"), F.col("role").alias("category"), F.when(F.col("conv_id") % 2 == 0, "easy").otherwise("hard").alias("difficulty")))


@_r.add(_CASES_SQL + "SELECT id, found AS n_found, len(patterns) - found AS n_missed, score, score >= 0.5 AS passed FROM r")
def pattern_score(spark, d):
    return _patterns(spark, d).select("id", F.size("found").alias("n_found"), F.size("missed").alias("n_missed"), "score", "passed")


@_r.add(_CASES_SQL + "SELECT category, difficulty, count(*) AS n, avg((score >= 0.5)::INT) AS rate FROM r GROUP BY GROUPING SETS ((category), (difficulty), ())")
def pass_rates(spark, d):
    return evaluation.pass_rates(_patterns(spark, d))


@_r.add(f"SELECT vec_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, vec_id) AS rank, 'vector' AS stage FROM ({_SCORED}) WHERE s >= 0 ORDER BY s DESC, vec_id LIMIT 10")
def search_vector_stage(spark, d):
    store = read(spark, d, "embeddings").withColumn("id", F.col("vec_id"))
    o = retrieval.Options(expand_graph=False, reranker="none")
    return retrieval.retrieve(store, None, _query(store), options=o).select("vec_id", F.round("score", 6).alias("score"), "rank", "stage")


_NEAR = (
    f"WITH h AS (SELECT vec_id, label, s, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM ({_SCORED}) WHERE s >= 0 ORDER BY s DESC, vec_id LIMIT 3), f0 AS (SELECT label, row_number() OVER (ORDER BY min(rank)) AS r FROM h GROUP BY label), "
    # a file imports the next one by label and, if even, the one after
    "l AS (SELECT DISTINCT label FROM embeddings), g AS (SELECT a.label AS src, b.label AS dst, b.label - a.label AS seq FROM l a JOIN l b ON b.label = a.label + 1 OR (a.label % 2 = 0 AND b.label = a.label + 2)), "
    "n1 AS (SELECT src AS label, dst AS t, 0 AS way, seq FROM g UNION ALL SELECT dst, src, 1, seq FROM g), m AS (SELECT t AS label, min((f0.r, way, seq, t)) AS place FROM n1 JOIN f0 ON f0.label = n1.label WHERE t NOT IN (SELECT label FROM f0) GROUP BY t), "
    "f AS (SELECT label, r AS file_rank FROM f0 UNION ALL SELECT label, 1000 + row_number() OVER (ORDER BY place) FROM m), "
    "c AS (SELECT e.vec_id, e.label, row_number() OVER (ORDER BY f.file_rank, e.vec_id) AS rank FROM embeddings e JOIN f ON f.label = e.label) "
)


def _files(spark, d):
    """Labels stand for files, a chunk's text is its number and label; (store, edges, query vector)."""
    rows = read(spark, d, "embeddings")
    path = F.col("label").cast("string")
    store = rows.select(
        F.col("vec_id").alias("id"), path.alias("filepath"), F.col("vec_id").alias("start_line"), F.col("vec_id").alias("end_line"), F.lit("function").alias("node_type"),
        F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("name"), F.concat_ws(" ", F.concat(F.lit("n"), (F.col("vec_id") % 3).cast("string")), F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string"))).alias("content"), F.lit("ts").alias("language"), "embedding",
    )
    labels = rows.select("label").distinct()
    a, b = labels.select(F.col("label").alias("a")), labels.select(F.col("label").alias("b"))
    steps = a.select("a", F.explode(F.when(F.col("a") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("seq"))
    edges = steps.withColumn("b", F.col("a") + F.col("seq")).join(b, "b").select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), F.col("seq").cast("long").alias("seq"))
    return store, edges, [float(x) for x in store.where("id = 0").first()["embedding"]]


@_r.add(_NEAR + "SELECT c.vec_id, round(coalesce(h.s, 0), 6) AS score, c.rank, 'graph' AS stage FROM c LEFT JOIN h ON h.vec_id = c.vec_id WHERE c.rank <= 100")
def search_graph_stage(spark, d):
    """Vector hits, then the chunks of their files and of files one import away."""
    store, edges, query = _files(spark, d)
    o = retrieval.Options(top_k=3, max_hops=1, max_expanded_chunks=100, reranker="none")
    return retrieval.retrieve(store, edges, query, options=o).select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"), "rank", "stage")


@_r.add(
    _NEAR + "SELECT label::VARCHAR AS filepath, vec_id AS start_line, 'f' || vec_id AS name, s AS score, rank, 'reranked' AS stage FROM (SELECT *, row_number() OVER (ORDER BY s DESC, old) AS rank FROM "
    "(SELECT vec_id, label, c.rank AS old, ((vec_id % 3 = 1)::INT + (vec_id % 2 = 0)::INT) / 2.0::DOUBLE AS s FROM c WHERE c.rank <= 100)) WHERE rank <= 5"
)
def search_service(spark, d):
    """From a query's text to reranked results, with a graph."""
    store, edges, query = _files(spark, d)
    given = {"top_k": 3, "max_hops": 1, "max_expanded_chunks": 100, "reranker": "bge"}
    return retrieval.search(store, edges, "n1 m0", lambda _: query, given).select("filepath", "start_line", "name", "score", "rank", "stage")


@_r.add(
    _NEAR + "SELECT vec_id AS start_line, CASE c.rank WHEN 3 THEN 1.0::DOUBLE WHEN 1 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS score, CASE c.rank WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS rank, 'reranked' AS stage FROM c WHERE c.rank IN (1, 3, 10)"
)
def search_answer_rerank(spark, d):
    """The order of a model's answer; a position beyond the hits does not count."""
    store, edges, query = _files(spark, d)
    given = {"top_k": 3, "max_hops": 1, "max_expanded_chunks": 100}
    rows = retrieval.search(store, edges, "n1", lambda _: query, given, ask=lambda _: "best: [2, 0, 4000, 9]")
    return rows.select("start_line", F.round("score", 6).alias("score"), "rank", "stage")
