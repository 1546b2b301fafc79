"""Dependency graph over the project's files, and over supplier-part edges of `lineitem`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .tables import LINES_SQL, Registry, projects, read

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NAMES = "unnest(list_filter(list_transform(string_split({}, ','), lambda s: trim(regexp_replace(trim(s), '^.*\\s+as\\s+', ''))), lambda x: x <> ''))"
_P = _sql(graph.STATIC_IMPORT)
IMPORTS_SQL = (
    f"WITH {LINES_SQL}, m AS (SELECT filepath, line, regexp_extract(raw, {_P}, 1) <> '' AS is_type, regexp_extract(raw, {_P}, 2) AS star, coalesce(nullif(regexp_extract(raw, {_P}, 3), ''), regexp_extract(raw, {_P}, 5)) AS named, "
    f"regexp_extract(raw, {_P}, 4) AS one, regexp_extract(raw, {_P}, 6) AS source FROM lines), "
    "i AS (SELECT filepath, regexp_replace(star, '\\*\\s+as\\s+', '') AS symbol, source, is_type, line FROM m WHERE source <> '' AND star <> '' UNION ALL SELECT filepath, one, source, is_type, line FROM m WHERE source <> '' AND one <> '' "
    f"UNION ALL SELECT filepath, {_NAMES.format('named')}, source, is_type, line FROM m WHERE source <> '' AND named <> '' "
    f"UNION ALL SELECT filepath, '*', regexp_extract(raw, {_sql(graph.DYNAMIC_IMPORT)}, 1), false, line FROM lines WHERE regexp_extract(raw, {_sql(graph.DYNAMIC_IMPORT)}, 1) <> '' "
    f"UNION ALL SELECT filepath, '*', regexp_extract(raw, {_sql(graph.REQUIRE)}, 1), false, line FROM lines WHERE regexp_extract(raw, {_sql(graph.REQUIRE)}, 1) <> '') "
)


@_r.add(IMPORTS_SQL + "SELECT filepath, symbol, source, is_type, line FROM i")
def import_rows(spark, d):
    return graph.imports(projects(spark, d)).select("filepath", "symbol", F.col("from").alias("source"), "is_type", "line")


_FIRST = "coalesce(" + ", ".join(f"nullif(regexp_extract(raw, {_sql(p)}, 1), '')" for p in graph.EXPORTS) + ")"
_LIST = f"regexp_extract(raw, {_sql(graph.EXPORT_LIST)}, 1)"
EXPORTS_SQL = (
    f"WITH {LINES_SQL}, e AS (SELECT filepath, {_FIRST} AS symbol, line FROM lines WHERE {_FIRST} IS NOT NULL UNION ALL SELECT filepath, {_NAMES.format(_LIST)}, line FROM lines WHERE {_FIRST} IS NULL AND {_LIST} <> '' "
    f"UNION ALL SELECT filepath, 'default', line FROM lines WHERE {_FIRST} IS NULL AND {_LIST} = '' AND regexp_matches(raw, {_sql(graph.EXPORT_DEFAULT)})) "
)


@_r.add(EXPORTS_SQL + "SELECT filepath, symbol, line FROM e")
def export_rows(spark, d):
    return graph.exports(projects(spark, d)).select("filepath", "symbol", "line")


@_r.add(EXPORTS_SQL + "SELECT DISTINCT filepath FROM e WHERE symbol = 'hash'")
def symbol_exporters(spark, d):
    return graph.exporters(projects(spark, d), "hash")


_LINKS = "('src/app.ts', 'src/model/user.ts'), ('src/app.ts', 'src/crypto.ts'), ('src/app.ts', 'src/log.js'), ('src/model/user.ts', 'src/crypto.ts'), ('src/model/user.ts', 'packages/core/base.ts')"


@_r.add(f"WITH {LINES_SQL}, l(a, b) AS (VALUES {_LINKS}), p AS (SELECT DISTINCT doc_id // 12 AS n FROM documents), e AS (SELECT 'p' || n || '/' || a AS src, 'p' || n || '/' || b AS dst FROM p, l) "
    "SELECT src, dst FROM e WHERE src IN (SELECT filepath FROM files) AND dst IN (SELECT filepath FROM files)"
    " AND (dst NOT LIKE '%packages%' OR replace(dst, 'base.ts', 'package.json') IN (SELECT filepath FROM files))")
def project_edges(spark, d):
    files = projects(spark, d)
    return graph.edges(files, graph.workspace_packages(files)).select("src", "dst")


def _edges(spark, d):
    """Suppliers as files that import parts; the first order line gives the order."""
    rows = read(spark, d, "lineitem")
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    return rows.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).agg(F.min(seq).alias("seq"))


_E = "WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, min(l_orderkey * 10 + l_linenumber) AS seq FROM lineitem GROUP BY ALL) "


@_r.add(
    _E + "SELECT src || '.ts' AS src, dst || '.ts' AS dst, row_number() OVER (PARTITION BY src ORDER BY seq, dst) AS seq FROM e"
)
def edges_build(spark, d):
    """Each supplier's order lines as the import lines of its file, resolved against the parts' files."""
    rows = read(spark, d, "lineitem")
    at = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_partkey").cast("string").alias("part"))
    line = lambda x: F.concat(F.lit("import { a } from './p"), x["part"], F.lit("';"))
    source = F.array_join(F.transform(F.sort_array(F.collect_list(at)), line), "\n")
    files = rows.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".ts")).alias("filepath")).agg(source.alias("content"))
    parts = rows.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".ts")).alias("filepath")).distinct().withColumn("content", F.lit("export const a = 1;"))
    return graph.edges(files.unionByName(parts))


@_r.add(_E + "SELECT dst AS src, src AS dst FROM e")
def edges_reverse(spark, d):
    return graph.reverse(_edges(spark, d)).select("src", "dst")


@_r.add(_E + "SELECT dst AS filepath FROM e WHERE src = 's1'")
def graph_dependencies(spark, d):
    return graph.dependencies(_edges(spark, d), "s1")


@_r.add(_E + "SELECT src AS filepath FROM e WHERE dst = 'p1'")
def graph_dependents(spark, d):
    return graph.dependents(_edges(spark, d), "p1")


@_r.add(_E + "SELECT n.c AS total_files, t.c AS total_edges, round(t.c * 1.0::DOUBLE / n.c, 6) AS avg_imports, round(t.c * 1.0::DOUBLE / n.c, 6) AS avg_dependents FROM (SELECT count(*) AS c FROM (SELECT src FROM e UNION SELECT dst FROM e)) n, (SELECT count(*) AS c FROM e) t")
def graph_stats(spark, d):
    rows = _edges(spark, d)
    s = graph.statistics(rows.select(F.col("src").alias("filepath")).union(rows.select("dst")).distinct(), rows)
    return s.select("total_files", "total_edges", F.round("avg_imports", 6).alias("avg_imports"), F.round("avg_dependents", 6).alias("avg_dependents"))


@_r.add(
    _E + ", a AS (SELECT src AS x, dst AS y FROM e UNION ALL SELECT dst, src FROM e), h1 AS (SELECT DISTINCT y AS f FROM a WHERE x = 's1' AND y <> 's1'), h2 AS (SELECT DISTINCT y AS f FROM a WHERE x IN (SELECT f FROM h1) AND y <> 's1' AND y NOT IN (SELECT f FROM h1)) "
    "SELECT 's1' AS filepath, 0 AS hop UNION ALL SELECT f, 1 FROM h1 UNION ALL SELECT f, 2 FROM h2"
)
def bfs_hops(spark, d):
    return graph.hops(_edges(spark, d), spark.createDataFrame([("s1",)], "filepath string"), 2)


@_r.add(
    _E.replace("WITH", "WITH RECURSIVE", 1) + ", a AS (SELECT src AS x, dst AS y FROM e UNION ALL SELECT dst, src FROM e), r AS (SELECT 's1' AS f, 0 AS hop UNION SELECT y, hop + 1 FROM r JOIN a ON x = f WHERE hop < 8) "
    "SELECT f AS filepath, min(hop) AS hop FROM r GROUP BY f"
)
def graph_reach(spark, d):
    """Everything that one supplier can reach; the SQL looks no further than eight hops, which all fit into."""
    return graph.hops(_edges(spark, d), spark.createDataFrame([("s1",)], "filepath string"))


@_r.add(_E + "SELECT 's1' AS filepath, 1 AS rank UNION ALL SELECT dst, rank + 1 FROM (SELECT dst, row_number() OVER (ORDER BY seq, dst) AS rank FROM e WHERE src = 's1') WHERE rank < 20")
def bfs_capped(spark, d):
    start = spark.createDataFrame([("s1", 1)], "filepath string, rank int")
    return graph.expand(_edges(spark, d), start, 1, max_files=20).select("filepath", "rank")


@_r.add(
    _E + ", f AS (SELECT 's1' AS filepath, 1 AS fr UNION ALL SELECT dst, rank + 1 FROM (SELECT dst, row_number() OVER (ORDER BY seq, dst) AS rank FROM e WHERE src = 's1') WHERE rank < 20) "
    "SELECT id, filepath, rank FROM (SELECT p_partkey AS id, f.filepath, row_number() OVER (ORDER BY fr, p_size, p_partkey) AS rank FROM part JOIN f ON f.filepath = 'p' || p_partkey) WHERE rank <= 20"
)
def expanded_chunks(spark, d):
    chunks = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("filepath"), F.col("p_size").alias("start_line"))
    start = spark.createDataFrame([("s1", 1)], "filepath string, rank int")
    return graph.expanded_chunks(_edges(spark, d), chunks, start, 1, 20).select("id", "filepath", "rank")
