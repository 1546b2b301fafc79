"""Chunks and line analysers over the project's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import analyzers, chunking
from .tables import LINES_SQL, Registry, projects, read

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LINES = f"WITH {LINES_SQL}, t AS (SELECT filepath, line, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS x FROM lines) "
_g = lambda rule, g: f"regexp_extract(x, {_sql(rule)}, {g})"


@_r.add()
def parse_chunks(spark, d):
    rows = chunking.chunks(projects(spark, d))
    return rows.select("id", "filepath", "start_line", "end_line", "node_type", "name", "language", *(F.array_join(c, ",").alias(c) for c in ("imports", "exports", "types")))


@_r.add(
    "WITH " + LINES_SQL + " SELECT filepath, line, 'import' AS kind, regexp_extract(raw, 'import\\s+.*from\\s+[''\"](.+)[''\"]', 1) AS \"to\" FROM lines WHERE regexp_extract(raw, 'import\\s+.*from\\s+[''\"](.+)[''\"]', 1) <> '' "
    "UNION ALL SELECT filepath, line, 'import', regexp_extract(raw, 'require\\([''\"](.+)[''\"]\\)', 1) FROM lines WHERE regexp_extract(raw, 'require\\([''\"](.+)[''\"]\\)', 1) <> '' "
    "UNION ALL SELECT filepath, line, 'extends', regexp_extract(raw, 'extends\\s+(\\w+)', 1) FROM lines WHERE regexp_extract(raw, 'extends\\s+(\\w+)', 1) <> '' "
    "UNION ALL SELECT filepath, line, 'implements', trim(unnest(string_split(regexp_extract(raw, 'implements\\s+([\\w,\\s]+)', 1), ','))) FROM lines WHERE regexp_extract(raw, 'implements\\s+([\\w,\\s]+)', 1) <> ''"
)
def inline_dependencies(spark, d):
    return analyzers.inline_dependencies(projects(spark, d)).select("filepath", "line", "kind", "to")


@_r.add(
    _LINES + f", k AS (SELECT filepath, line, x, CASE WHEN regexp_matches(x, {_sql(analyzers.INTERFACE)}) THEN 1 WHEN regexp_matches(x, {_sql(analyzers.ALIAS)}) THEN 2 WHEN regexp_matches(x, {_sql(analyzers.TYPED_FUNCTION)}) THEN 3 "
    f"WHEN regexp_matches(x, {_sql(analyzers.TYPED_ARROW)}) THEN 4 WHEN regexp_matches(x, {_sql(analyzers.TYPED_VARIABLE)}) AND NOT contains(x, '=>') AND NOT contains(x, 'function') THEN 5 ELSE 0 END AS r FROM t) "
    f"SELECT filepath, line, CASE r WHEN 1 THEN {_g(analyzers.INTERFACE, 2)} WHEN 2 THEN {_g(analyzers.ALIAS, 2)} WHEN 3 THEN {_g(analyzers.TYPED_FUNCTION, 3)} WHEN 4 THEN {_g(analyzers.TYPED_ARROW, 3)} ELSE {_g(analyzers.TYPED_VARIABLE, 3)} END AS name, "
    "CASE r WHEN 1 THEN 'interface' WHEN 2 THEN 'type' WHEN 5 THEN 'variable' ELSE 'function' END AS kind FROM k WHERE r > 0"
)
def type_flow(spark, d):
    return analyzers.type_flow(projects(spark, d)).select("filepath", "line", "name", "kind")


#: A file for each item: what a scanner without states loses or invents.
_TRICKY = """import { load } from './f@';
const rule = /[{"'`]/g;
export function f@(a: string): number {
  return `${[a].map(x => `}${x}`).join("}")}`.length;
}
const g@ = async (n: number) => n / 2 / 1;
app.on('x', (e) => {
  function inner@() { return e; }
});
class C@ {
  private on: (a: T) => void = rule;
  run(a) { return /}/.test(a); }
}
export { g@, rule as r };
"""
_FOUND = "('f@', 'function', 3, 5, 'f@', 'string,number'), ('g@', 'function', 6, 6, '', 'number'), ('anonymous', 'function', 7, 9, '', ''), ('inner@', 'function', 8, 8, '', ''), ('C@', 'class', 10, 13, '', 'C@,T,void'), ('run', 'function', 12, 12, '', ''), ('g@, rule', 'other', 14, 14, '', '')"


@_r.add(
    f"WITH k(name, node_type, start_line, end_line, exports, types) AS (VALUES {_FOUND}) SELECT 'item' || item_id || '.ts' AS filepath, replace(k.name, '@', item_id::VARCHAR) AS name, node_type, start_line, end_line, replace(exports, '@', item_id::VARCHAR) AS exports, replace(types, '@', item_id::VARCHAR) AS types, "
    f"md5(array_to_string(string_split(replace({_sql(_TRICKY)}, '@', item_id::VARCHAR), chr(10))[start_line:end_line], chr(10))) AS digest, './f' || item_id AS imports FROM items, k"
)
def parse_files(spark, d):
    """The table function in SQL text, over a file for each item."""
    chunking.register(spark)
    files = read(spark, d, "items").select(F.concat(F.lit("item"), F.col("item_id").cast("string"), F.lit(".ts")).alias("filepath"), F.replace(F.lit(_TRICKY), F.lit("@"), F.col("item_id").cast("string")).alias("content"))
    rows = spark.sql("SELECT c.* FROM {files} f, LATERAL parse_file(f.filepath, f.content) c", files=files)
    return rows.select("filepath", "name", "node_type", "start_line", "end_line", F.array_join("exports", ",").alias("exports"), F.array_join("types", ",").alias("types"), F.md5(F.col("content").cast("binary")).alias("digest"), F.array_join("imports", ",").alias("imports"))


@_r.add()
def call_graph(spark, d):
    return analyzers.call_graph(projects(spark, d)).withColumn("calls", F.array_join("calls", ","))


_SCORE = " + ".join(f"regexp_matches(x, {_sql(b)})::INT" for b in analyzers.BRANCHES)
_COMPLEXITY = (
    "WITH RECURSIVE " + _LINES.removeprefix("WITH ") + f", k AS (SELECT filepath, line, CASE WHEN regexp_matches(x, {_sql(analyzers.FUNCTION_HEAD)}) THEN {_g(analyzers.FUNCTION_HEAD, 3)} || {_g(analyzers.FUNCTION_HEAD, 6)} "
    f"WHEN regexp_matches(x, {_sql(analyzers.METHOD_HEAD)}) THEN {_g(analyzers.METHOD_HEAD, 2)} ELSE '' END AS name, contains(x, '}}') AS closes, length(replace(x, '}}', '')) - length(replace(x, '{{', '')) AS opens, {_SCORE} AS score FROM t), "
    "w AS (SELECT *, sum(opens) OVER o AS depth, sum(score) OVER o AS upto FROM k WINDOW o AS (PARTITION BY filepath ORDER BY line)), "
    "e AS (SELECT h.filepath, h.name, h.line, h.upto - h.score AS before, coalesce(min(n.line), 2147483647) AS stop FROM w h LEFT JOIN w n ON n.filepath = h.filepath AND n.line >= h.line AND n.closes AND n.depth <= h.depth - h.opens "
    "WHERE h.name NOT IN ('', 'if', 'for', 'while', 'switch') GROUP BY ALL), "
    "r AS (SELECT filepath, min(line) AS line, arg_min(stop, line) AS stop FROM e GROUP BY filepath UNION ALL SELECT e.filepath, min(e.line), arg_min(e.stop, e.line) FROM r JOIN e ON e.filepath = r.filepath AND e.line > r.stop GROUP BY e.filepath), "
    "c AS (SELECT e.filepath, e.name, e.line, (w.upto - e.before + 1)::INT AS complexity, (w.line - e.line + 1)::INT AS loc FROM r JOIN e ON e.filepath = r.filepath AND e.line = r.line JOIN w ON w.filepath = e.filepath AND w.line = e.stop) "
)


@_r.add(_COMPLEXITY + "SELECT *, CASE WHEN complexity <= 3 THEN 'Simple' WHEN complexity <= 6 THEN 'Moderate' WHEN complexity <= 10 THEN 'Complex' ELSE 'Very Complex' END AS bucket FROM c")
def complexity(spark, d):
    return analyzers.complexity(projects(spark, d))


@_r.add(_COMPLEXITY + "SELECT count(*) AS functions, avg(complexity) AS average, max(complexity) AS highest FROM c")
def complexity_summary(spark, d):
    return analyzers.complexity_summary(analyzers.complexity(projects(spark, d)))


_is = lambda rule: f"regexp_matches(x, {_sql(rule)})"


@_r.add(
    _LINES + f", k AS (SELECT filepath, line, x, CASE WHEN {_is(analyzers.FUNCTION_HEAD)} THEN 'FunctionDeclaration' WHEN {_is(analyzers.CLASS)} THEN 'ClassDeclaration' WHEN {_is(analyzers.NAMED_TYPE)} THEN CASE {_g(analyzers.NAMED_TYPE, 2)} WHEN 'interface' THEN 'InterfaceDeclaration' ELSE 'TypeAlias' END "
    f"WHEN {_is(analyzers.VARIABLE)} AND NOT contains(x, '=>') AND NOT contains(x, 'function') THEN 'VariableDeclaration' WHEN {_is(analyzers.OUTLINE_IMPORT)} THEN 'ImportDeclaration' ELSE '' END AS kind FROM t), "
    "s AS (SELECT *, CASE WHEN kind IN ('FunctionDeclaration', 'ClassDeclaration') THEN 1 WHEN kind = '' AND x = '}' THEN -1 ELSE 0 END AS step FROM k), "
    "u AS (SELECT *, sum(step) OVER (PARTITION BY filepath ORDER BY line) AS upto FROM s), "
    "v AS (SELECT *, least(0, coalesce(min(upto) OVER (PARTITION BY filepath ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lowest FROM u) "
    f"SELECT filepath, CASE kind WHEN 'ImportDeclaration' THEN 0 ELSE upto - step - lowest END::INT AS depth, kind, CASE kind WHEN 'FunctionDeclaration' THEN {_g(analyzers.FUNCTION_HEAD, 3)} || {_g(analyzers.FUNCTION_HEAD, 6)} WHEN 'ClassDeclaration' THEN {_g(analyzers.CLASS, 2)} "
    f"WHEN 'VariableDeclaration' THEN {_g(analyzers.VARIABLE, 3)} WHEN 'ImportDeclaration' THEN {_g(analyzers.OUTLINE_IMPORT, 1)} ELSE {_g(analyzers.NAMED_TYPE, 3)} END AS name, line FROM v WHERE kind <> ''"
)
def outline(spark, d):
    return analyzers.outline(projects(spark, d))


@_r.add("SELECT doc_id, 3 AS blocks, 'print(1)' AS code, n_chars + 2 AS first_chars FROM documents")
def fence_split(spark, d):
    """Each document as the prose before and after a fence."""
    docs = read(spark, d, "documents")
    content = F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n```python\nprint(1)\n```\nend"))
    blocks = analyzers.fence_blocks(docs.select(F.col("doc_id").cast("string").alias("filepath"), content.alias("content")))
    out = blocks.groupBy("filepath").agg(F.count("*").alias("blocks"), F.max(F.when(F.col("kind") == "code", F.col("body"))).alias("code"), F.max(F.when(F.col("pos") == 0, F.length("body"))).alias("first_chars"))
    return out.select(F.col("filepath").cast("long").alias("doc_id"), "blocks", "code", F.col("first_chars").cast("long").alias("first_chars"))


_EXT = ("ts", "TSX", "js", "py", "go", "rs", "md", "pyi")
_PATH_SQL = "'src/' || source || '/d' || (doc_id % 10) || '/f' || doc_id || '.' || (['" + "', '".join(_EXT) + "'])[doc_id % 8 + 1]"


def _paths(spark, d):
    docs = read(spark, d, "documents")
    kind = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % 8 + 1).cast("int"))
    path = F.concat(F.lit("src/"), "source", F.lit("/d"), (F.col("doc_id") % 10).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), kind)
    return docs.withColumn("path", path)


@_r.add(
    f"SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'typescript' WHEN 1 THEN 'typescript' WHEN 2 THEN 'typescript' WHEN 3 THEN 'python' WHEN 4 THEN 'go' WHEN 5 THEN 'rust' WHEN 7 THEN 'python' END AS language, "
    f"array_to_string(string_split({_PATH_SQL}, '/')[-2:], '/') AS short, '.../' || array_to_string(string_split({_PATH_SQL}, '/')[-3:], '/') AS longer, 'src/' || source AS folder FROM documents"
)
def path_functions(spark, d):
    p = F.col("path")
    up = paths.normal(F.concat_ws("/", paths.parent(p), F.lit(".."), F.lit("."), F.lit("")))
    return _paths(spark, d).select("doc_id", paths.language(p).alias("language"), paths.short(p).alias("short"), paths.short(p, 3, ".../").alias("longer"), up.alias("folder"))


@_r.add(
    f"SELECT doc_id, 'f' || doc_id || '-' || substr(sha256({_PATH_SQL} || ':1:' || text), 1, 12) AS hash_id, {_PATH_SQL} || ':1-' || len(string_split(text, chr(10))) AS range_id FROM documents"
)
def chunk_ids(spark, d):
    end = F.size(F.split("text", "\n"))
    return _paths(spark, d).select("doc_id", chunking.content_hash_id(F.col("path"), F.lit(1), F.col("text")).alias("hash_id"), chunking.line_range_id(F.col("path"), F.lit(1), end).alias("range_id"))


_CONTENT = "CASE doc_id % 5 WHEN 0 THEN '// ' || replace(text, chr(10), chr(10) || '# ') WHEN 1 THEN '  ' || chr(10) WHEN 2 THEN substr(text, 1, 8) ELSE text END"


@_r.add(
    f"WITH c AS (SELECT doc_id, {_CONTENT} AS c FROM documents) SELECT doc_id, CASE WHEN regexp_replace(c, '^\\s+|\\s+$', '', 'g') = '' THEN 'empty' "
    "WHEN len(list_filter(string_split(c, chr(10)), lambda s: NOT regexp_matches(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), '^(//|/\\*|\\*|#|$)'))) = 0 THEN 'only comments' WHEN length(regexp_replace(c, '^\\s+|\\s+$', '', 'g')) < 10 THEN 'too short' END AS reason FROM c"
)
def chunk_validate(spark, d):
    content = F.expr("CASE doc_id % 5 WHEN 0 THEN concat('// ', replace(text, '\\n', '\\n# ')) WHEN 1 THEN '  \\n' WHEN 2 THEN substr(text, 1, 8) ELSE text END")
    return read(spark, d, "documents").select("doc_id", chunking.validate(content).alias("reason"))


@_r.add("SELECT doc_id, length(c) AS length, md5(c) AS digest FROM (SELECT doc_id, CASE WHEN length(text) > 2500 THEN substr(text, 1, 2500) || chr(10) || '// ... truncated' ELSE text END AS c FROM documents)")
def chunk_truncate(spark, d):
    cut = chunking.truncate(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.length(cut).alias("length"), F.md5(cut.cast("binary")).alias("digest"))


@_r.add("SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[2:3], chr(10))) AS digest FROM documents")
def content_slice(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(chunking.slice_lines(F.col("text"), F.lit(2), F.lit(3)).cast("binary")).alias("digest"))
