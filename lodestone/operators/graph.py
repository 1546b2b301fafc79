"""Dependency graph: import and export rows, resolution, edges, bounded and whole expansion, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import normal, parent, trim
from ..sources.shared import new_folder

#: Line patterns of imports and exports.
STATIC_IMPORT = r"^import\s+(type\s+)?(?:(\*\s+as\s+\w+)|(?:\{([^}]+)\})|(\w+))?\s*(?:,\s*(?:\{([^}]+)\}))?\s*from\s+['\"]([^'\"]+)['\"]"
DYNAMIC_IMPORT = r"import\(['\"]([^'\"]+)['\"]\)"
REQUIRE = r"require\(['\"]([^'\"]+)['\"]\)"
EXPORTS = (
    r"^export\s+(?:async\s+)?function\s+(\w+)", r"^export\s+class\s+(\w+)", r"^export\s+interface\s+(\w+)", r"^export\s+type\s+(\w+)", r"^export\s+(?:const|let|var)\s+(\w+)",
)
EXPORT_LIST = r"^export\s+\{([^}]+)\}"
EXPORT_DEFAULT = r"^export\s+default"
FILE_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: Rows of an expansion's files up to which they are broadcast.
BROADCAST_FILES = 100_000
#: Parts into which the neighbours of each file are cut, so that a hub's do not meet in one task.
HUB_PARTS = 8


def lines(files: DataFrame) -> DataFrame:
    """(filepath, line, text) with lines from 1."""
    return files.select("filepath", F.posexplode(F.split("content", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def _names(listed: Column) -> Column:
    """Names of a brace list: what stands after `as`, else the name; empty ones go."""
    own = F.transform(F.split(listed, ","), lambda s: trim(F.element_at(F.split(trim(s), r"\s+as\s+"), -1)))
    return F.filter(own, lambda s: s != "")


def imports(files: DataFrame) -> DataFrame:
    """(filepath, symbol, from, is_type, line, pos): a row for each imported symbol, in order."""
    part = lambda g: F.regexp_extract("text", STATIC_IMPORT, g)
    one = lambda c: F.when(c != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    star = F.regexp_replace(part(2), r"\*\s+as\s+", "")
    listed = F.when(part(3) != "", part(3)).otherwise(part(5))
    symbols = F.concat(one(star), one(part(4)), F.when(listed != "", _names(listed)).otherwise(F.array().cast("array<string>")))
    static = F.struct(symbols.alias("symbols"), part(6).alias("from"), (part(1) != "").alias("is_type"), F.lit(0).alias("kind"))
    any_ = lambda rule, kind: F.struct(F.array(F.lit("*")).alias("symbols"), F.regexp_extract("text", rule, 1).alias("from"), F.lit(False).alias("is_type"), F.lit(kind).alias("kind"))
    found = F.filter(F.array(static, any_(DYNAMIC_IMPORT, 1), any_(REQUIRE, 2)), lambda x: x["from"] != "")
    rows = lines(files).where(F.col("text").contains("import") | F.col("text").contains("require")).select("filepath", "line", F.explode(found).alias("i"))
    rows = rows.select("filepath", "line", "i.from", "i.is_type", "i.kind", F.posexplode("i.symbols").alias("at", "symbol"))
    return rows.select("filepath", "symbol", "from", "is_type", "line", (F.col("kind") * 10_000 + F.col("at")).alias("pos"))


def import_sources(files: DataFrame) -> DataFrame:
    """(filepath, from, at): a row for each statement that imports a symbol; `at` grows with line and kind.

    The rows of `imports` without their symbols, which edges don't need.
    """
    part = lambda g: F.regexp_extract("text", STATIC_IMPORT, g)
    rows = lines(files).where(F.col("text").contains("import") | F.col("text").contains("require"))
    # each pattern is a column of its own, read more than once below, and so runs once on a line
    rows = rows.select("filepath", "line", *(part(g).alias(f"g{g}") for g in range(2, 7)), F.regexp_extract("text", DYNAMIC_IMPORT, 1).alias("dynamic"), F.regexp_extract("text", REQUIRE, 1).alias("required"))
    named = (F.col("g2") != "") | (F.col("g4") != "") | F.when(F.col("g3") != "", F.col("g3")).otherwise(F.col("g5")).rlike(r"[^\s,]")
    kinds = F.array(F.when(named & (F.col("g6") != ""), F.col("g6")), F.when(F.col("dynamic") != "", F.col("dynamic")), F.when(F.col("required") != "", F.col("required")))
    found = rows.select("filepath", "line", F.posexplode(kinds).alias("kind", "from")).where(F.col("from").isNotNull())
    return found.select("filepath", "from", (F.col("line").cast("long") * 3 + F.col("kind")).alias("at"))


def exports(files: DataFrame) -> DataFrame:
    """(filepath, symbol, line, pos): the first rule that matches a line gives its symbols."""
    first = F.coalesce(*(F.nullif(F.regexp_extract("text", r, 1), F.lit("")) for r in EXPORTS))
    listed = F.regexp_extract("text", EXPORT_LIST, 1)
    symbols = F.when(first.isNotNull(), F.array(first)).when(listed != "", _names(listed)).when(F.col("text").rlike(EXPORT_DEFAULT), F.array(F.lit("default")))
    rows = lines(files).where(F.col("text").startswith("export")).select("filepath", "line", F.posexplode(symbols).alias("pos", "symbol"))
    return rows.select("filepath", "symbol", "line", "pos")


def nodes(files: DataFrame) -> DataFrame:
    """(filepath, exports, imports) with lists in source order."""
    ordered = lambda what: F.transform(F.array_sort(F.collect_list(F.struct("line", "pos", what))), lambda x: x["v"])
    out = exports(files).groupBy("filepath").agg(ordered(F.col("symbol").alias("v")).alias("exports"))
    into = imports(files).groupBy("filepath").agg(ordered(F.struct("symbol", "from", "is_type", "line").alias("v")).alias("imports"))
    kind = "array<struct<symbol:string,from:string,is_type:boolean,line:int>>"
    return files.select("filepath").distinct().join(out, "filepath", "left").join(into, "filepath", "left").select(
        "filepath", F.coalesce("exports", F.array().cast("array<string>")).alias("exports"), F.coalesce("imports", F.array().cast(kind)).alias("imports")
    )


def workspace_packages(manifests: DataFrame) -> DataFrame:
    """(package, directory) from (filepath, content) of package.json files one level under workspace folders."""
    rows = manifests.where(F.col("filepath").rlike(r"^(?:.*/)?(packages|apps|libs|modules)/[^/]+/package\.json$"))
    return rows.select(F.get_json_object("content", "$.name").alias("package"), parent(F.col("filepath")).alias("directory")).where("package is not null")


_KNOWN = r"(" + "|".join(e.replace(".", r"\.") for e in FILE_EXTENSIONS) + ")$"


def spellings(files: DataFrame, follow: bool = True) -> DataFrame:
    """(key, exact, choice, dst): the paths under which imports may name a file, two or three each.

    Its own path is exact; without its extension, or as the folder of an index file, it is the better
    the lower `choice` is.  Without `follow` only `.ts` files may be named without their extension.
    """
    path = F.col("filepath")
    extension = F.regexp_extract(path, _KNOWN, 1)
    rank = F.array_position(F.array(*map(F.lit, FILE_EXTENSIONS)), extension).cast("int") - 1
    stem = F.expr("substr(filepath, 1, length(filepath) - length(_e))")
    key = lambda k, exact, choice: F.struct(k.alias("key"), F.lit(exact).alias("exact"), choice.cast("int").alias("choice"))
    n = len(FILE_EXTENSIONS)
    own = files.select("filepath").distinct().withColumn("_e", extension).withColumn("_r", rank)
    named = F.filter(
        F.array(key(path, True, F.lit(0)), key(stem, False, F.col("_r")), key(F.regexp_replace(stem, "/index$", ""), False, F.when(stem.endswith("/index"), F.col("_r") + n))),
        lambda x: x["exact"] | (x["choice"].isNotNull() & (x["choice"] >= 0) & (x["choice"] < (2 * n if follow else 1))),
    )
    return own.select(F.explode(named).alias("s"), path.alias("dst")).select("s.*", "dst")


def edges(files: DataFrame, packages: DataFrame | None = None, follow: bool = True) -> DataFrame:
    """(src, dst, seq): distinct imports of known files; seq is their order within src.

    Relative paths resolve against the importing file, scoped names against workspace packages; other
    packages are external.  One equi-join with the files' spellings finds the file that is meant: an
    import is one row in it, whatever its extension may be.  The spellings are settled to one file each
    before it, and what it finds is dealt once, by the importing file.
    """
    rows = import_sources(files)
    relative = rows.where(F.col("from").startswith(".") | F.col("from").startswith("/"))
    relative = relative.withColumn("base", normal(F.when(F.col("from").startswith("/"), F.col("from")).otherwise(F.concat_ws("/", parent(F.col("filepath")), "from"))))
    targets = relative.select("filepath", "at", "base")
    if packages is not None:
        scoped = rows.where(F.col("from").startswith("@")).withColumn("parts", F.split("from", "/")).withColumn("package", F.array_join(F.slice("parts", 1, 2), "/"))
        rest = F.array_join(F.slice("parts", 3, F.greatest(F.size("parts") - 2, F.lit(0))), "/")
        scoped = scoped.join(packages, "package").withColumn("base", F.when(rest == "", F.col("directory")).otherwise(normal(F.concat_ws("/", "directory", rest))))
        targets = targets.unionByName(scoped.select("filepath", "at", "base"))
    asked = targets.select("filepath", "at", F.col("base").alias("key"), F.col("base").rlike(_KNOWN).alias("exact"))
    meant = spellings(files, follow).groupBy("key", "exact").agg(F.min(F.struct("choice", "dst")).alias("to"))
    known = asked.join(meant, ["key", "exact"]).select("filepath", "at", "to.choice", "to.dst").repartition("filepath")
    best = known.groupBy("filepath", "at").agg(F.min_by("dst", F.struct("choice", "dst")).alias("dst"))
    once = best.groupBy(F.col("filepath").alias("src"), "dst").agg(F.min("at").alias("at"))
    return once.select("src", "dst", F.row_number().over(Window.partitionBy("src").orderBy("at", "dst")).cast("long").alias("seq"))


def reverse(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *([F.col("seq")] if "seq" in rows.columns else []))


def dependencies(rows: DataFrame, file: str) -> DataFrame:
    return rows.where(F.col("src") == file).select(F.col("dst").alias("filepath"))


def dependents(rows: DataFrame, file: str) -> DataFrame:
    return rows.where(F.col("dst") == file).select(F.col("src").alias("filepath"))


def expand(rows: DataFrame, start: DataFrame, max_hops: int = 2, include_imports: bool = True, include_dependents: bool = True, max_files: int = 20) -> DataFrame:
    """Breadth-first expansion: (filepath, hop, rank) in queue order, start files first and never cut.

    start: (filepath, rank).  Each hop is one join of a frontier of max_files rows at most with the
    edges; the frontier is broadcast while that bound is small.  The hops are unrolled.
    """
    few = F.broadcast if max_files <= BROADCAST_FILES else lambda x: x
    seen = start.select("filepath", F.lit(0).alias("hop"), F.col("rank").cast("long").alias("rank"))
    frontier = seen
    first = start.count()  # a query's start files are few
    for hop in range(1, max_hops + 1):
        near = []
        if include_imports:
            near.append(rows.select(F.col("src").alias("filepath"), F.col("dst").alias("to"), F.lit(0).alias("way"), "seq"))
        if include_dependents:
            near.append(rows.select(F.col("dst").alias("filepath"), F.col("src").alias("to"), F.lit(1).alias("way"), "seq"))
        if not near or first >= max_files:
            break
        around = near[0] if len(near) == 1 else near[0].unionByName(near[1])
        met = around.join(few(frontier.select("filepath", "rank")), "filepath").select(F.col("to").alias("filepath"), F.struct("rank", "way", "seq", F.col("to").alias("tie")).alias("at"))
        met = met.join(few(seen.select("filepath")), "filepath", "left_anti").groupBy("filepath").agg(F.min("at").alias("at"))
        met = met.orderBy("at").limit(max_files)  # each task keeps as many
        frontier = met.select("filepath", F.lit(hop).alias("hop"), (F.row_number().over(Window.orderBy("at")) + hop * 1_000_000).cast("long").alias("rank"))
        seen = seen.unionByName(frontier)
    ordered = seen.orderBy("rank").limit(max(max_files, first))
    return ordered.select("filepath", "hop", F.row_number().over(Window.orderBy("rank")).alias("rank"))


def hops(rows: DataFrame, start: DataFrame, max_hops: int | None = None, include_imports: bool = True, include_dependents: bool = True) -> DataFrame:
    """(filepath, hop): every file within max_hops of the start files, uncut; without max_hops every file that can be reached.

    A delta iteration.  The edges are read once, into a table of neighbours in buckets by file; each round
    joins with it only the files that the last round found, so it moves these and never the edges, and the
    rounds end where nothing new is found.  Each round's files are written to the shared folder, which ends
    lineage.  Files are broadcast by their counted number alone: Parquet's bytes say little of the rows, and
    the parts multiply them.  Null paths are no files; without start files there are no rows.
    """
    spark = rows.sparkSession
    ways = ([("src", "dst")] if include_imports else []) + ([("dst", "src")] if include_dependents else [])
    folder, table = new_folder(spark, "hops"), f"neighbours_{uuid.uuid4().hex}"

    def found(hop: int, files: DataFrame) -> DataFrame:
        path = f"{folder}/hop={hop}"
        files.write.parquet(path)
        return spark.read.schema("filepath string").parquet(path)

    def seen(rounds: int) -> DataFrame:
        paths = [f"{folder}/hop={k}" for k in range(rounds + 1)]
        return spark.read.schema("filepath string, hop int").option("basePath", folder).parquet(*paths)

    def held(files: DataFrame, n: int) -> DataFrame:
        return F.broadcast(files) if n <= BROADCAST_FILES else files.hint("merge")

    frontier, hop = found(0, start.select("filepath").where("filepath is not null").distinct()), 0
    if not ways:
        return seen(hop)
    near = [rows.select(F.col(a).alias("filepath"), F.col(b).alias("to")) for a, b in ways]
    near = (near[0] if len(near) == 1 else near[0].unionByName(near[1])).where("filepath <> to")
    near = near.withColumn("part", F.pmod(F.xxhash64("to"), F.lit(HUB_PARTS)).cast("int"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near.repartition(buckets, "filepath", "part").write.bucketBy(buckets, "filepath", "part").option("path", new_folder(spark, "neighbours")).saveAsTable(table)
    new = total = frontier.count()
    try:
        while new and (max_hops is None or hop < max_hops):
            asked = frontier.select("filepath", F.explode(F.sequence(F.lit(0), F.lit(HUB_PARTS - 1))).alias("part"))
            met = spark.table(table).join(held(asked, new * HUB_PARTS), ["filepath", "part"]).select(F.col("to").alias("filepath")).distinct()
            frontier = found(hop + 1, met.join(held(seen(hop), total), "filepath", "left_anti"))
            new = frontier.count()
            if new:
                hop, total = hop + 1, total + new
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # its files stay
    return seen(hop)


def expanded_chunks(rows: DataFrame, chunks: DataFrame, start: DataFrame, max_hops: int = 2, max_chunks: int = 20, order: str = "start_line") -> DataFrame:
    """Chunks of the expanded files in file order, cut at max_chunks: chunk columns and rank."""
    files = expand(rows, start, max_hops, max_files=max_chunks).select("filepath", F.col("rank").alias("file_rank"))
    found = chunks.join(F.broadcast(files), "filepath").orderBy("file_rank", order, "id").limit(max_chunks)
    return found.withColumn("rank", F.row_number().over(Window.orderBy("file_rank", order, "id")))


def exporters(files: DataFrame, symbol: str) -> DataFrame:
    return exports(files).where(F.col("symbol") == symbol).select("filepath").distinct()


def statistics(node_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: total_files, total_edges, avg_imports, avg_dependents; averages are 0 without files."""
    n = node_rows.agg(F.count("*").alias("total_files"))
    e = rows.agg(F.count("*").alias("total_edges"))
    share = F.coalesce(F.col("total_edges") / F.nullif(F.col("total_files"), F.lit(0)), F.lit(0.0))
    return n.crossJoin(e).select("total_files", "total_edges", share.alias("avg_imports"), share.alias("avg_dependents"))
