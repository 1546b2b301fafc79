"""The index as tables: chunks with vectors by repository, graph nodes and edges, meta; and JSON interchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vector import last_wins
from ..schema import GRAPH_EDGES, GRAPH_NODES, INDEX_META
from . import versioned

TABLES = ("embeddings", "graph_nodes", "graph_edges", "index_meta")


def save(df: DataFrame, path: str, name: str, by: str | None = None) -> None:
    """Write a table; with `by` only the partitions at hand are replaced."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(by)
    writer.parquet(f"{path}/{name}")


def save_repository(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, path: str, order: str = "start_line", model: str | None = None) -> None:
    """Replace one repository's rows: chunks deduplicated by id (the last one stays), edges distinct; with `model` the meta row of the whole index follows."""
    save(last_wins(chunks, ["repository_id", "id"], order), path, "embeddings", "repository_id")
    save(nodes, path, "graph_nodes", "repository_id" if "repository_id" in nodes.columns else None)
    save(edges.dropDuplicates(["src", "dst"]), path, "graph_edges", "repository_id" if "repository_id" in edges.columns else None)
    if model is not None:
        spark = chunks.sparkSession
        save(meta(model, load(spark, path, "graph_nodes"), load(spark, path, "embeddings")), path, "index_meta")


def upsert_index(spark: SparkSession, root: str, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, model: str, order: str = "seq", gone: DataFrame | None = None) -> int:
    """One transaction over chunks (last by `order` wins), nodes, edges and meta; `gone`: (repository_id, id) of chunks to delete.

    Only the buckets of touched keys are rewritten; the version's number is returned.
    """
    base, _ = versioned.manifest(spark, root)
    head = chunks.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension")).select(
        F.lit("1").alias("version"), F.current_timestamp().alias("indexed_at"), F.lit(model).alias("model"), F.col("dimension").cast("int").alias("dimension")
    )
    changes = {
        "embeddings": versioned.Change(["repository_id", "id"], chunks, order, gone),
        "graph_nodes": versioned.Change(["repository_id", "filepath"], nodes),
        "graph_edges": versioned.Change(["repository_id", "src", "dst"], edges),
        "index_meta": versioned.Change(["version"], head, "indexed_at"),
    }
    return versioned.commit(spark, root, changes, base)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at))


def load(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A saved table, or None where nothing is indexed."""
    return spark.read.parquet(f"{path}/{name}") if exists(spark, f"{path}/{name}") else None


def missing(spark: SparkSession, path: str, names: tuple[str, ...] = TABLES) -> list[str]:
    """Preflight: tables that are not there."""
    return [n for n in names if not exists(spark, f"{path}/{n}")]


def truncate(spark: SparkSession, path: str) -> None:
    """Replace all tables by empty ones; the vectors' table keeps its columns."""
    if (chunks := load(spark, path, "embeddings")) is not None:
        empty = spark.createDataFrame([], chunks.schema)
        empty.write.mode("overwrite").parquet(f"{path}/embeddings")
    for name, schema in (("graph_nodes", GRAPH_NODES), ("graph_edges", GRAPH_EDGES), ("index_meta", INDEX_META)):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{name}")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def import_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def meta(model: str, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counts and configuration; the dimension is that of the longest vector (0 without vectors)."""
    size = F.coalesce(F.max(F.size("embedding")), F.lit(0)) if "embedding" in chunks.columns else F.lit(0)
    file = [c for c in ("repository_id", "filepath") if c in files.columns]
    n = files.agg(F.countDistinct(*file).alias("files")).crossJoin(chunks.agg(F.count("*").alias("chunks"), size.cast("int").alias("dimension")))
    return n.select(F.lit("1").alias("version"), F.current_timestamp().alias("indexed_at"), F.lit(model).alias("model"), "dimension", "files", "chunks")


def status(spark: SparkSession, path: str, embedding: str | None = None, llm: str | None = None) -> dict:
    """Whether there is a store and whether it holds chunks, the last meta row (None without one), and the models named."""
    chunks, about = load(spark, path, "embeddings"), load(spark, path, "index_meta")
    last = about.orderBy(F.col("indexed_at").desc()).first() if about is not None else None
    return {"ready": chunks is not None, "indexed": chunks is not None and not chunks.isEmpty(), "meta": last.asDict() if last else None, "embedding": embedding, "llm": llm}
