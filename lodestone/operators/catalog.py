"""Repository catalog: listing, upsert, status, statistics and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import repository_id
from .vector import last_wins


def with_ids(rows: DataFrame, url: str = "url") -> DataFrame:
    """Rows with the repository id of their address; an error where it is none."""
    own = repository_id(F.col(url))
    return rows.withColumn("id", F.when(own.isNotNull(), own).otherwise(F.raise_error(F.concat(F.lit("invalid repository address: "), F.coalesce(F.col(url), F.lit("null"))))))


def ready(repositories: DataFrame) -> DataFrame:
    """Ready repositories, most stars first, then last indexed; nulls have defaults."""
    rows = repositories.where(F.col("status") == "ready").orderBy(F.desc("stars"), F.desc("indexed_at"), "id")
    return rows.withColumn("stars", F.coalesce("stars", F.lit(0))).withColumn("default_branch", F.coalesce("default_branch", F.lit("main"))).withColumn("file_count", F.coalesce("file_count", F.lit(0))).withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def upsert(repositories: DataFrame, new: DataFrame, keep: tuple[str, ...] = ("indexed_at",), order: str | None = None) -> DataFrame:
    """New rows replace those of their id; `keep` columns stay where the new value is null.

    Of new rows with one id the one with the greatest `order` wins, then the greatest row.
    """
    fresh = F.col("n._new").isNotNull()
    ranked = new.withColumn("_at", F.struct(*([order] if order else []), *new.columns))
    both = repositories.alias("o").join(last_wins(ranked, ["id"], "_at").select(*new.columns).withColumn("_new", F.lit(1)).alias("n"), "id", "full")
    cols = [F.when(fresh, F.coalesce(f"n.{c}", f"o.{c}") if c in keep else F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in repositories.columns if c != "id"]
    return both.select("id", *cols)


def update_status(repositories: DataFrame, id_: str, status: str, file_count: int | None = None, chunk_count: int | None = None) -> DataFrame:
    own = F.col("id") == id_
    rows = repositories.withColumn("status", F.when(own, F.lit(status)).otherwise(F.col("status")))
    for name, value in (("file_count", file_count), ("chunk_count", chunk_count)):
        rows = rows.withColumn(name, F.when(own, F.coalesce(F.lit(value).cast("int"), name)).otherwise(F.col(name)))
    return rows


def statistics(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repository_id").agg(F.count("*").alias("chunk_count"), F.count_distinct("filepath").alias("file_count"))


def search(repositories: DataFrame, text: str) -> DataFrame:
    low = F.lit(text.lower())
    return repositories.where(F.contains(F.lower("name"), low) | F.contains(F.lower(F.coalesce("description", F.lit(""))), low))


def by_slug(repositories: DataFrame, slug: str) -> DataFrame:
    parts = slug.split("--")
    if len(parts) != 2:
        return repositories.limit(0)
    return repositories.where((F.lower("owner") == parts[0].lower()) & (F.lower("name") == parts[1].lower()))
