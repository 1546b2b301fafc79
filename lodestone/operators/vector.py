"""Vector store: cosine scoring, top-k, upsert and deletion over an embeddings table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .nearest import batch_top_k as batch_top_k

#: Dimension by model.
DIMENSIONS = {
    "text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "text-embedding-004": 768, "nomic-embed-text": 768, "mxbai-embed-large": 1024, "all-minilm": 384,
}
#: Ids that stand in a plan as literals at most.
LITERAL_IDS = 200


def dimension(model: Column) -> Column:
    """The dimension of a model, 1536 if unknown."""
    table = F.create_map(*(F.lit(x) for kv in DIMENSIONS.items() for x in kv))
    return F.coalesce(F.element_at(table, model), F.lit(1536))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def checked(a: Column, size: int) -> Column:
    """The vector; an error where its length differs."""
    return F.when(a.isNull() | (F.size(a) == size), a).otherwise(F.raise_error(F.concat(F.lit(f"dimension mismatch: expected {size}, got "), F.size(a).cast("string"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0, an error where lengths differ."""
    both = norm(a) * norm(b)
    value = F.when(both == 0, F.lit(0.0)).otherwise(dot(a, b) / both)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("dimension mismatch")).cast("double"))


def with_norms(store: DataFrame, vector: str = "embedding") -> DataFrame:
    """The store with its norms, which a search then does not compute again."""
    return store.withColumn("norm", norm(F.col(vector)))


def _scored(store: DataFrame, query: Sequence[float], vector: str) -> DataFrame:
    literal = F.array(*(F.lit(float(x)) for x in query))
    length = float(sum(float(x) ** 2 for x in query)) ** 0.5
    own = F.col("norm") if "norm" in store.columns else norm(F.col(vector))
    value = dot(checked(F.col(vector), len(query)), literal) / (own * F.lit(length))
    return store.withColumn("score", F.when((own == 0) | F.lit(length == 0), F.lit(0.0)).otherwise(value))


def top_k(store: DataFrame, query: Sequence[float], k: int = 10, min_score: float = 0.0, strict: bool = False, key: str = "id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k nearest rows by cosine, best first, ties by key; no sort of the whole, each task keeps k.

    min_score is inclusive, or exclusive with `strict`.  `where` is pushed to the scan.  Null vectors
    have no score and never match; k of 0 gives no rows.
    """
    rows = _scored(store if where is None else store.where(where), query, vector)
    rows = rows.where(F.col("score") > min_score if strict else F.col("score") >= min_score)
    return rows.orderBy(F.desc("score"), key).limit(k)


def create(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def upsert(store: DataFrame, new: DataFrame, keys: Sequence[str] = ("id",), order: str | None = None, vector: str = "embedding") -> DataFrame:
    """Rows of `new` replace those of `store` with their key; of equal keys in `new` the last one stays.

    Last is the greatest `order`, or without one the last in the order that `new` is read.  Where the
    store has vectors, new ones must have their dimension.
    """
    if vector in store.columns and (some := store.select(F.size(vector).alias("n")).where("n >= 0").first()):
        new = new.withColumn(vector, checked(F.col(vector), some["n"]))
    ordered = new.withColumn("_at", F.col(order) if order else F.monotonically_increasing_id())
    fresh = last_wins(ordered, keys, "_at").select(*new.columns)
    return store.join(fresh.select(*keys), list(keys), "left_anti").select(*store.columns).unionByName(fresh)


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key with the greatest order: an aggregation that combines before the shuffle."""
    kept = F.max_by(F.struct(*(F.col(c) for c in rows.columns)), F.col(order))
    return rows.groupBy(*keys).agg(kept.alias("_row")).select("_row.*")


def _among(store: DataFrame, ids: Sequence, key: str, how: str) -> DataFrame:
    """Rows whose key is among the ids or not; many ids are a table and not a part of the plan."""
    if len(ids) <= LITERAL_IDS:
        hit = F.col(key).isin(*ids) if ids else F.lit(False)
        return store.where(hit if how == "left_semi" else ~F.coalesce(hit, F.lit(False)))
    listed = store.sparkSession.createDataFrame([(x,) for x in ids], store.select(key).schema)
    return store.join(listed, key, how).select(*store.columns)


def delete_ids(store: DataFrame, ids: Sequence, key: str = "id") -> DataFrame:
    return _among(store, ids, key, "left_anti")


def with_ids(store: DataFrame, ids: Sequence, key: str = "id") -> DataFrame:
    """What `delete_ids` removes; its count is the number of removed rows."""
    return _among(store, ids, key, "left_semi")


def delete_path(store: DataFrame, path: str) -> DataFrame:
    """All but a file's rows, which `by_path` gives: their count is the number of removed rows."""
    return store.where(~F.coalesce(F.col("filepath") == path, F.lit(False)))


def by_path(store: DataFrame, path: str) -> DataFrame:
    return store.where(F.col("filepath") == path)


def stats(store: DataFrame, model: str, vector: str = "embedding") -> DataFrame:
    """One row: count, dimension, model."""
    return store.agg(F.count("*").alias("count"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dimension")).withColumn("model", F.lit(model))


def register_search(spark: SparkSession, store: DataFrame, name: str = "search_chunks", key: str = "id", vector: str = "embedding") -> None:
    """Make a table function known to the session's SQL: `SELECT * FROM search_chunks(query, match_count => 10, min_similarity => 0.3D)`.

    The store's columns but its vectors, and `similarity`, which is greater than `min_similarity`; the
    best `match_count` rows, ties by key.  Each task keeps as many before they meet.
    """
    store.createOrReplaceTempView(f"{name}_store")
    own = [f for f in store.schema.fields if f.name not in (vector, "norm")]
    listed, typed = ", ".join(f"`{f.name}`" for f in own), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    product = lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x)"
    q, v = f"{name}.query_embedding", f"CAST(`{vector}` AS ARRAY<DOUBLE>)"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(query_embedding ARRAY<DOUBLE>, match_count INT DEFAULT 10, min_similarity DOUBLE DEFAULT 0.3D) RETURNS TABLE ({typed}, similarity DOUBLE) RETURN "
        f"SELECT {listed}, similarity FROM (SELECT {listed}, similarity, row_number() OVER (ORDER BY similarity DESC, `{key}`) AS _place FROM ("
        f"SELECT {listed}, coalesce({product(v, q)} / nullif(sqrt({product(v, v)}) * sqrt({product(q, q)}), 0D), 0D) AS similarity FROM {name}_store WHERE `{vector}` IS NOT NULL"
        f") WHERE similarity > {name}.min_similarity) WHERE _place <= {name}.match_count"
    )
