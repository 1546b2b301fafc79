"""Repository catalog over `supplier` and `nation`, and address functions over `pages`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import catalog
from .tables import Registry, read

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def repositories(spark, d):
    """Suppliers as repositories; their nation's name is the owner."""
    rows = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.concat(F.lit("github:"), "n_name", F.lit("/"), "s_name").alias("id"), F.col("n_name").alias("owner"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("About "), "n_name")).alias("description"),
        F.when(F.col("s_suppkey") % 5 != 0, F.floor("s_acctbal").cast("int")).alias("stars"), F.lit(None).cast("string").alias("default_branch"), F.lit(None).cast("int").alias("file_count"), F.lit(3).alias("chunk_count"),
        F.when(F.col("s_suppkey") % 3 == 0, "indexing").otherwise("ready").alias("status"), F.lit("2024-01-01").alias("indexed_at"),
    )


_R = (
    "WITH r AS (SELECT 'github:' || n_name || '/' || s_name AS id, n_name AS owner, s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN 'About ' || n_name END AS description, CASE WHEN s_suppkey % 5 <> 0 THEN floor(s_acctbal)::INT END AS stars, "
    "CASE WHEN s_suppkey % 3 = 0 THEN 'indexing' ELSE 'ready' END AS status FROM supplier JOIN nation ON s_nationkey = n_nationkey) "
)


@_r.add(_R + "SELECT id, coalesce(stars, 0) AS stars, 'main' AS default_branch, 0 AS file_count FROM r WHERE status = 'ready'")
def repo_list(spark, d):
    return catalog.ready(repositories(spark, d)).select("id", "stars", "default_branch", "file_count")


@_r.add(_R + "SELECT id FROM r WHERE contains(lower(name), 'nation_1') OR contains(lower(coalesce(description, '')), 'nation_1')")
def repo_search(spark, d):
    return catalog.search(repositories(spark, d), "NATION_1").select("id")


@_r.add(_R + "SELECT id, lower(owner || '--' || name) AS slug, 2 AS parts FROM r")
def repo_slug(spark, d):
    rows = repositories(spark, d)
    slug = paths.slug(F.col("owner"), F.col("name"))
    return rows.select("id", slug.alias("slug"), F.size(F.array(paths.parse_slug(slug)["owner"], paths.parse_slug(slug)["name"])).alias("parts"))


@_r.add(_R + ", f AS (SELECT min(lower(owner || '--' || name)) AS s FROM r) SELECT id FROM r, f WHERE lower(owner || '--' || name) = s")
def repo_by_slug(spark, d):
    rows = repositories(spark, d)
    slug = rows.agg(F.min(paths.slug(F.col("owner"), F.col("name")))).first()[0]
    return catalog.by_slug(rows, slug).select("id")


@_r.add(_R + "SELECT id, CASE WHEN status = 'ready' THEN coalesce(stars, -1) + 1 ELSE coalesce(stars, -1) END AS stars, '2024-01-01' AS indexed_at FROM r UNION ALL SELECT 'github:new/repo', 8, NULL")
def repo_upsert(spark, d):
    rows = repositories(spark, d).select("id", F.coalesce("stars", F.lit(-1)).alias("stars"), "status", "indexed_at")
    new = rows.where("status = 'ready'").select("id", (F.col("stars") + 1).alias("stars"), "status", F.lit(None).cast("string").alias("indexed_at"))
    extra = spark.createDataFrame([("github:new/repo", 8, "ready", None)], new.schema)
    return catalog.upsert(rows, new.union(extra)).select("id", "stars", "indexed_at")


@_r.add(_R + ", f AS (SELECT min(id) AS m FROM r) SELECT id, CASE WHEN id = m THEN 'failed' ELSE status END AS status, CASE WHEN id = m THEN 7 END AS file_count, 3 AS chunk_count FROM r, f")
def repo_status(spark, d):
    rows = repositories(spark, d)
    return catalog.update_status(rows, rows.agg(F.min("id")).first()[0], "failed", file_count=7).select("id", "status", "file_count", "chunk_count")


@_r.add("SELECT 'r' || (l_suppkey % 7) AS repository_id, count(*) AS chunk_count, count(DISTINCT l_partkey) AS file_count FROM lineitem GROUP BY 1")
def repo_stats(spark, d):
    chunks = read(spark, d, "lineitem").select(F.concat(F.lit("r"), (F.col("l_suppkey") % 7).cast("string")).alias("repository_id"), F.col("l_partkey").alias("filepath"))
    return catalog.statistics(chunks)


@_r.add(
    "WITH u AS (SELECT page_id, 'https://github.com/' || replace(regexp_extract(url, '//([^/]+)', 1), '.', '-') || '/repo' || page_id || CASE WHEN page_id % 2 = 0 THEN '.git' ELSE '/tree' END AS a FROM pages) "
    "SELECT page_id, regexp_extract(a, 'github\\.com[/:]([^/]+)/([^/.]+)', 1) AS owner, regexp_extract(a, 'github\\.com[/:]([^/]+)/([^/.]+)', 2) AS name, 'github:' || regexp_extract(a, 'github\\.com[/:]([^/]+)/([^/.]+)', 1) || '/' || regexp_extract(a, 'github\\.com[/:]([^/]+)/([^/.]+)', 2) AS id, "
    "a || '/blob/main/x.ts#L1-L' || page_id AS citation FROM u"
)
def url_parse(spark, d):
    host = F.regexp_replace(F.regexp_extract("url", "//([^/]+)", 1), r"\.", "-")
    a = F.concat(F.lit("https://github.com/"), host, F.lit("/repo"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".git").otherwise("/tree"))
    rows = read(spark, d, "pages").select("page_id", a.alias("a"))
    own = F.col("a")
    return rows.select("page_id", paths.owner(own).alias("owner"), paths.repository(own).alias("name"), paths.repository_id(own).alias("id"), paths.citation_url(own, F.lit("main"), F.lit("x.ts"), F.lit(1), F.col("page_id")).alias("citation"))
