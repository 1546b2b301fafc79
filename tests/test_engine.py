"""Operators of code retrieval on small frames."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.functions import paths
from lodestone.operators import agent, analyzers, catalog, chunking, context, embedding, evaluation, graph, nearest, retrieval, telemetry, vector
from lodestone.plans.tables import project
from lodestone.schema import GRAPH_EDGES, REPOSITORIES, TRACES
from lodestone.sources import files as sources
from lodestone.sources import index_store
from lodestone.streaming import traces as streaming


def vectors(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, filepath string, embedding array<float>")


STORE = [("a", "x.ts", [1.0, 0.0, 0.0]), ("b", "x.ts", [0.9, 0.1, 0.0]), ("c", "y.ts", [0.0, 1.0, 0.0]), ("z", "y.ts", [0.0, 0.0, 0.0])]


def test_top_k_order_ties_and_bounds(spark):
    store = vectors(spark, *STORE)
    got = vector.top_k(store, [1, 0, 0], 10).collect()
    assert [r.id for r in got] == ["a", "b", "c", "z"] and got[0].score == pytest.approx(1.0) and got[3].score == 0
    assert [r.id for r in vector.top_k(vector.with_norms(store), [1, 0, 0], 2).collect()] == ["a", "b"]
    assert vector.top_k(store, [1, 0, 0], 10, 0.5).count() == 2 and vector.top_k(store, [1, 0, 0], 10, 0.0, strict=True).count() == 2
    assert vector.top_k(store, [1, 0, 0], 0).count() == 0 and vector.top_k(store, [0, 0, 0], 5).count() == 4
    with pytest.raises(PySparkException, match="dimension mismatch"):
        vector.top_k(store, [1, 0], 1).collect()


def test_store_changes(spark):
    store = vectors(spark, *STORE)
    new = vectors(spark, ("a", "x.ts", [0.0, 0.0, 1.0]))
    got = {r.id: list(r.embedding) for r in vector.upsert(store, new).collect()}
    assert len(got) == 4 and got["a"] == [0, 0, 1]
    assert vector.upsert(vector.upsert(store, new), new).count() == 4
    assert vector.delete_ids(store, ["a", "b"]).count() == 2 and vector.delete_ids(store, []).count() == 4
    assert vector.delete_path(store, "x.ts").count() == 2 and vector.by_path(store, "y.ts").count() == 2
    assert vector.stats(vector.create(spark, store.schema), "m").first()[:2] == (0, 0)


def test_embedding_backends(spark):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(6)], "id int, text string").coalesce(1)

    def backend(texts):
        if "t2" in texts:
            raise RuntimeError("remote failure")
        return [[float(len(t))] for t in texts]

    got = {r.id: r.embedding for r in embedding.embed(rows, backend, batch=2).collect()}
    assert got == {0: [2.0], 1: [2.0], 2: None, 3: None, 4: [2.0], 5: [2.0]}
    assert embedding.pending(rows, rows.where("id < 4")).count() == 2
    v = rows.select(embedding.hash_embedding(F.col("text"), 40).alias("v")).first().v
    assert len(v) == 40 and sum(x * x for x in v) == pytest.approx(1.0) and v[0] == pytest.approx(v[32])


def test_graph_of_the_project(spark):
    files = project(spark)
    edges = graph.edges(files, graph.workspace_packages(files)).cache()
    pairs = {(r.src, r.dst) for r in edges.collect()}
    assert ("src/app.ts", "src/log.js") in pairs and ("src/model/user.ts", "packages/core/base.ts") in pairs
    plain = {(r.src, r.dst) for r in graph.edges(files, follow=False).collect()}
    assert plain == {("src/app.ts", "src/model/user.ts"), ("src/app.ts", "src/crypto.ts"), ("src/app.ts", "src/log.js"), ("src/model/user.ts", "src/crypto.ts")}
    start = spark.createDataFrame([("src/crypto.ts", 1)], "filepath string, rank int")
    one = [r.filepath for r in graph.expand(edges, start, 1).orderBy("rank").collect()]
    two = [r.filepath for r in graph.expand(edges, start, 2).orderBy("rank").collect()]
    assert one[0] == "src/crypto.ts" and set(one[1:]) == {"src/app.ts", "src/model/user.ts"} and two[:3] == one and set(two[3:]) == {"src/log.js", "packages/core/base.ts"}
    assert graph.expand(edges, start, 0).count() == 1 and graph.expand(edges, start, 2, max_files=2).count() == 2
    both = spark.createDataFrame([("src/app.ts", 1), ("src/log.js", 2)], "filepath string, rank int")
    assert graph.expand(edges, both, 2, max_files=1).count() == 2
    assert graph.expand(edges, start, 2, include_imports=False, include_dependents=False).count() == 1
    nodes = {r.filepath: r for r in graph.nodes(files).collect()}
    assert nodes["src/crypto.ts"].exports == ["hash", "verify", "default"] and nodes["README.md"].imports == []
    assert [i.symbol for i in nodes["src/app.ts"].imports] == ["User", "Login", "hash", "verify", "log", "React", "*"]
    empty = spark.createDataFrame([], GRAPH_EDGES)
    assert graph.statistics(files.limit(0), empty).first()[:] == (0, 0, 0.0, 0.0)


def test_chunks_of_languages(spark):
    rows = chunking.chunks(project(spark)).collect()
    of = lambda path: [(r.node_type, r.name, r.start_line, r.end_line, list(r.exports)) for r in rows if r.filepath == path]
    assert of("src/app.ts") == [("function", "signIn", 8, 17, ["signIn"]), ("function", "limit", 19, 19, ["limit"]), ("function", "grow", 20, 23, [])]
    assert [x[:2] for x in of("src/model/user.ts")] == [("interface", "User"), ("type", "Session"), ("class", "Account"), ("class", "Hidden"), ("function", "run"), ("other", "Account, Hidden")]
    assert [x[:2] for x in of("tools/run.py")] == [("function", "main"), ("function", "inner"), ("class", "Job"), ("function", "go")]
    assert [x[:2] for x in of("cmd/main.go")] == [("type", "Server"), ("struct", "Server"), ("function", "Start"), ("function", "main")]
    assert [x[:2] for x in of("lib/mod.rs")] == [("struct", "Point"), ("class", "impl Point"), ("function", "fmt"), ("type", "Kind"), ("function", "run")]
    assert not of("README.md") and not of("src/empty.ts") and not of("src/comment.ts")
    app = next(r for r in rows if r.name == "signIn")
    own = spark.createDataFrame([(app.filepath, app.content)], "p string, c string")
    assert own.select(chunking.content_hash_id(F.col("p"), F.lit(app.start_line), F.col("c"))).first()[0] == app.id


@pytest.mark.parametrize("text", ['const s = "} function x() {";\nfunction y() { return `}${"{"}`; }\n', "function y() { // }\n  return '}';\n}\n", "/* function z() {} */\nfunction y() {}\n"])
def test_strings_and_comments_do_not_confuse_the_scanner(text):
    assert [r[6] for r in chunking.parse("a.ts", text)] == ["y"]


def test_chunk_checks(spark):
    texts = [None, " \n", "// a\n\n * b\n# c", "short", "long enough text", "x" * 2501]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    assert [r[0] for r in rows.select(chunking.validate(F.col("t"))).collect()] == ["empty", "empty", "only comments", "too short", None, None]
    cut = rows.select(chunking.truncate(F.col("t")).alias("c")).collect()
    assert cut[4].c == texts[4] and cut[5].c == "x" * 2500 + chunking.CUT


def test_analysers(spark):
    files = project(spark)
    calls = {(r.filepath, r.name): r.calls for r in analyzers.call_graph(files).collect()}
    # a line such as `if (…) {` has the shape of a method head
    assert calls[("src/app.ts", "if")] == ["deny", "verify", "list", "info", "hash"] and calls[("src/model/user.ts", "open")] == ["check", "hash"]
    kinds = {(r.filepath, r.kind): r.targets for r in analyzers.by_kind(analyzers.inline_dependencies(files)).collect()}
    assert kinds[("src/model/user.ts", "implements")] == ["Stored", "Named"] and kinds[("src/model/user.ts", "extends")] == ["Base"]
    flows = {r.name: (r.kind, r.type, r.flows) for r in analyzers.type_flow(files).collect()}
    assert flows["hash"] == ("function", "(string) → string", ["string", "string"]) and flows["limit"] == ("variable", "number", ["number"]) and flows["Session"][1].endswith("…")
    worst = analyzers.complexity(files).orderBy(F.desc("complexity")).first()
    assert (worst.name, worst.complexity, worst.loc, worst.bucket) == ("signIn", 8, 10, "Complex")
    depths = {r.name: r.depth for r in analyzers.outline(files.where("filepath = 'src/model/user.ts'")).collect()}
    assert depths["../crypto"] == 0 and depths["Hidden"] == 0  # the lone brace of a method closes its class
    text = spark.createDataFrame([("f", "a\n```js\nx = 1\n```\nb\n```mermaid\ng\n```\n```\ny\n```")], "filepath string, content string")
    assert [(r.kind, r.language) for r in analyzers.fence_blocks(text).orderBy("pos").collect()] == [("text", None), ("code", "js"), ("text", None), ("mermaid", None), ("text", None), ("code", "typescript")]
    assert text.select(analyzers.all_code(F.col("content"))).first()[0] == "x = 1\n\ny"
    shown = text.select(analyzers.views(F.col("content"), F.lit("import a from 'b'")).alias("v")).first().v
    assert shown == ["text", "diagram", "ast", "deps"]
    assert text.select(analyzers.analysis_input(F.array(F.lit("a"), F.lit("")), F.array(F.lit("b")))).first()[0] == "a\n\nb"
    repos = spark.createDataFrame([("r1",), ("r2",)], "id string")
    known = spark.createDataFrame([("r1", ["q"])], "id string, questions array<string>")
    assert {r.id: r.questions for r in analyzers.suggested_questions(repos, known, ["d"]).collect()} == {"r1": ["q"], "r2": ["d"]}
    circle = analyzers.radial_layout(spark.createDataFrame([("a", "file"), ("b", "file")], "id string, kind string")).orderBy("id").collect()
    assert circle[0].x == pytest.approx(250) and circle[1].x == pytest.approx(-250)


CHUNKS = [("c1", "x.ts", 1, 5, "function", "alpha", "find the user token", [1.0, 0.0]), ("c2", "x.ts", 6, 9, "class", "beta", "other words", [0.9, 0.1]), ("c3", "y.ts", 1, 2, "function", "gamma", "user token store", [0.0, 1.0]), ("c4", "z.ts", 1, 2, "function", "delta", "class alpha here", [-1.0, 0.0])]


def chunk_frame(spark):
    return spark.createDataFrame(CHUNKS, "id string, filepath string, start_line int, end_line int, node_type string, name string, content string, embedding array<float>")


def test_retrieval_stages(spark):
    store = chunk_frame(spark)
    edges = spark.createDataFrame([("x.ts", "y.ts", 1)], GRAPH_EDGES)
    o = retrieval.Options(top_k=1, reranker="none")
    rows = retrieval.retrieve(store, edges, [1.0, 0.0], options=o).orderBy("rank").collect()
    assert [(r.id, r.stage, r.score > 0) for r in rows] == [("c1", "graph", True), ("c2", "graph", False), ("c3", "graph", False)]
    two = retrieval.retrieve(store, edges, [1.0, 0.0], "user token store", retrieval.Options(top_k=1, rerank_top_k=2)).orderBy("rank").collect()
    assert [(r.id, r.stage) for r in two] == [("c3", "reranked"), ("c1", "reranked")]
    assert retrieval.retrieve(store.limit(0), edges, [1.0, 0.0], "x").count() == 0
    hits = retrieval.vector_stage(store, [1.0, 0.0], retrieval.Options(top_k=3))
    assert [(r.id, round(r.score, 1)) for r in retrieval.rerank_by_answer(hits, "best: [2, 0, 9]", 2).orderBy("rank").collect()] == [("c3", 1.0), ("c1", 0.9)]
    assert retrieval.rerank_by_answer(hits, "no list", 2).count() == 2
    assert {r.stage: r.chunks for r in retrieval.stage_counts(hits).collect()} == {"vector": 3}


@pytest.mark.parametrize(
    ("query", "given", "ok"),
    [("q", {}, True), ("", {}, False), (5, {}, False), ("q" * 2001, {}, False), ("q", {"top_k": 1}, True), ("q", {"top_k": 50}, True), ("q", {"top_k": 51}, False), ("q", {"top_k": "5"}, False), ("q", {"max_hops": 0}, True), ("q", {"max_hops": 6}, False), ("q", {"max_expanded_chunks": 101}, False), ("q", {"reranker": "llm"}, True), ("q", {"reranker": "x"}, False)],
)
def test_option_bounds(query, given, ok):
    assert (retrieval.validate(query, given) is None) == ok


def test_tools_and_loop(spark):
    files = project(spark)
    assert [r.text for r in agent.read_file(files, "../src/./crypto.ts", 1, 2).collect()][0].startswith("const node")
    top = agent.list_directory(files, "", 2).collect()
    assert [r.name for r in top][:2] == ["cmd", "lib"] and top[-1].name == "README.md" and not top[-1].is_folder
    assert [r.id for r in agent.find_symbol(chunk_frame(spark), "alpha").collect()] == ["c1", "c4"]
    said = iter([{"tool": "look", "input": {"path": "p"}, "input_tokens": 2}, {"tool": "none"}, {"text": "done", "output_tokens": 3}])
    run = agent.loop(lambda m: next(said), {"look": lambda path: f"saw {path}"}, "q")
    assert run.answer == "done" and [s["output"] for s in run.steps] == ["saw p", "unknown tool none"] and (run.input_tokens, run.output_tokens, run.files) == (2, 3, {"p"})
    assert agent.loop(lambda m: {"tool": "t", "text": "end"}, {}, "q", 2).answer == "end"


def test_catalog(spark):
    rows = [("github:a/b", "A", "B", "u", None, None, None, None, None, None, "ready", None), ("github:c/d", "C", "D", "u", "Text", None, 5, "dev", 1, 2, "ready", None), ("github:e/f", "E", "F", "u", None, None, 9, None, 1, 2, "failed", None)]
    repos = spark.createDataFrame(rows, REPOSITORIES)
    assert [(r.id, r.stars, r.default_branch) for r in catalog.ready(repos).collect()] == [("github:c/d", 5, "dev"), ("github:a/b", 0, "main")]
    assert catalog.search(repos, "tEx").count() == 1 and catalog.by_slug(repos, "a--b").count() == 1 and catalog.by_slug(repos, "a").count() == 0
    assert catalog.update_status(repos, "github:c/d", "failed", chunk_count=9).where("id = 'github:c/d'").select("status", "file_count", "chunk_count").first()[:] == ("failed", 1, 9)
    ids = catalog.with_ids(spark.createDataFrame([("https://github.com/o/cal.com",), ("git@github.com:o/r.git",)], "url string"))
    assert [r.id for r in ids.collect()] == ["github:o/cal", "github:o/r"]
    with pytest.raises(PySparkException, match="invalid repository"):
        catalog.with_ids(spark.createDataFrame([("nowhere",)], "url string")).collect()


def trace_rows(spark):
    rows = [(f"t{k}", 1704067200000 + k * 3_600_000, "q" * (k * 30), None, "chat", [("retrieval", 0, 10 * k, 10 * k), ("open", 0, 0, None)], (1, 2, 3), (0.0, 0.0, 0.0, 0.5), k, "llm" if k % 2 else None, k != 3, None) for k in range(30)]
    return spark.createDataFrame(rows, TRACES)


def test_telemetry(spark):
    rows = trace_rows(spark)
    m = telemetry.metrics(rows, 0, 2**60).first()
    assert (m.requests, m.succeeded, m.failed, m.tokens, m.cost, m.p95_latency) == (30, 29, 1, 90, 15.0, 280) and m.by_mode == {"chat": 30} and m.by_reranker_used == {"llm": 15}
    none = telemetry.metrics(rows.limit(0), 0, 1).first()
    assert (none.requests, none.tokens, none.cost, none.p95_latency, none.by_mode) == (0, 0, 0.0, 0, {})
    days = {r.day: r.requests for r in telemetry.cost_by_day(rows, 0).collect()}
    assert days == {"2024-01-01": 24, "2024-01-02": 6, None: 30}
    s = telemetry.latency_by_stage(rows).collect()
    assert [(r.name, r.n, r.p50, r.p95, r.p99) for r in s] == [("retrieval", 30, 150, 280, 290)]
    assert telemetry.recent(rows, 0).count() == 0 and telemetry.view(rows, 500).first().query == "q" * 100 + "..."
    assert telemetry.cost_by_day(rows, 0, last=5).where("day is null").first().requests == 5 and telemetry.latency_by_stage(rows, 3).first().n == 3
    assert telemetry.metrics(rows).first().requests == 0  # the last day
    spans = spark.createDataFrame([("a", "y", 5, 9), ("a", "x", 0, 5), ("b", "z", 3, None)], "id string, name string, start_ms long, end_ms long")
    usage = spark.createDataFrame([("a", 10, 2), ("a", 5, 1)], "id string, input_tokens long, output_tokens long")
    made = {r.id: r for r in telemetry.recorded(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), spans, usage).collect()}
    assert [(x.name, x.duration_ms) for x in made["a"].spans] == [("x", 5), ("y", 4)] and made["a"].token_usage.total_tokens == 18
    assert made["b"].spans[0].duration_ms is None and made["c"].spans == [] and made["c"].token_usage.total_tokens == 0
    with pytest.raises(ValueError, match="valid: metrics"):
        telemetry.by_view("x")


def test_evaluation_bounds(spark):
    rows = spark.createDataFrame([(1, ["a/x.ts", "b/x.ts", "y.ts"], ["f"], ["y"], ["f"]), (2, [], [], ["y"], []), (3, ["z"], [], [], [])], "id int, files array<string>, chunk_names array<string>, expected_files array<string>, expected_chunks array<string>")
    got = {r.id: (r.precision, r.recall, r.mrr) for r in evaluation.score(rows).collect()}
    assert got == {1: (0.5, 1.0, 1.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 1.0, 0.0)}
    with pytest.raises(AssertionError):
        evaluation.gate(0.5)


def test_scan_and_index(spark, tmp_path):
    root = tmp_path / "re po"
    for p in ("src/a.ts", "node_modules/b.ts", "src/deep/c.py", "src/D.TS", "go.sum", "x.md"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("text é")
    got = {r.filepath: r.content for r in sources.scan(spark, str(root), "r").collect()}
    assert got == {"src/a.ts": "text é", "src/deep/c.py": "text é"}
    at = str(tmp_path / "index")
    assert index_store.load(spark, at, "embeddings") is None and index_store.missing(spark, at) == list(index_store.TABLES)
    chunks = spark.createDataFrame([("r1", "i", 1), ("r1", "i", 2), ("r2", "i", 3)], "repository_id string, id string, start_line int")
    nodes = spark.createDataFrame([("f",)], "filepath string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b")], "src string, dst string")
    index_store.save_repository(chunks, nodes, edges, at)
    index_store.save_repository(chunks.where("repository_id = 'r2'").withColumn("start_line", F.lit(9)), nodes, edges, at)
    kept = {(r.repository_id, r.start_line) for r in index_store.load(spark, at, "embeddings").collect()}
    assert kept == {("r1", 2), ("r2", 9)} and index_store.load(spark, at, "graph_edges").count() == 1
    assert index_store.status(spark, at, "mock")["meta"] is None
    index_store.truncate(spark, at)
    assert index_store.load(spark, at, "graph_edges").count() == 0


def test_index_meta_and_status(spark, tmp_path):
    """The save writes the meta row over all repositories; status reads it, and tells a missing store from an empty one."""
    at = str(tmp_path / "index")
    nothing = {"ready": False, "indexed": False, "meta": None, "embedding": "mock", "llm": None}
    assert index_store.status(spark, at, "mock") == nothing
    chunks = spark.createDataFrame([("r1", "i", 1, [1.0, 0.0]), ("r1", "i", 2, [0.0, 1.0]), ("r2", "j", 3, None)], "repository_id string, id string, start_line int, embedding array<float>")
    nodes = spark.createDataFrame([("r1", "f"), ("r1", "g"), ("r2", "g")], "repository_id string, filepath string")
    edges = spark.createDataFrame([("r1", "f", "g")], "repository_id string, src string, dst string")
    for r in ("r1", "r2"):
        mine = f"repository_id = '{r}'"
        index_store.save_repository(chunks.where(mine), nodes.where(mine), edges.where(mine), at, model="mock")
    got = index_store.status(spark, at, "mock", "none")
    assert got["ready"] and got["indexed"] and got["llm"] == "none" and index_store.missing(spark, at) == []
    assert {k: got["meta"][k] for k in ("version", "model", "dimension", "files", "chunks")} == {"version": "1", "model": "mock", "dimension": 2, "files": 3, "chunks": 2}
    index_store.truncate(spark, at)
    assert index_store.status(spark, at, "mock") == nothing | {"ready": True}


def test_daily_stream(spark, tmp_path):
    trace_rows(spark).write.parquet(str(tmp_path / "in"))
    query = streaming.daily(streaming.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.requests for r in spark.table("daily").collect()) == [6, 24]


def test_paths(spark):
    row = spark.range(1).select(paths.normal(F.lit("a/./b/../../c//d")).alias("n"), paths.short(F.lit("a/b/c/d"), 3, ".../").alias("s"), paths.parse_slug(F.lit("a--b--c")).alias("p"), paths.citation_url(F.lit(None).cast("string"), F.lit("m"), F.lit("f"), F.lit(1), F.lit(2)).alias("u")).first()
    assert row.n == "c/d" and row.s == ".../b/c/d" and row.p is None and row.u == "f#L1-L2"
    lines = spark.createDataFrame([(1, "0:hi"), (2, "zz")], "seq int, line string")
    assert [tuple(r) for r in context.decode_stream(lines).collect()] == [(1, "text", "hi")]


def test_search_service(spark):
    rows = [(f"c{k}", f"{n}.ts", k, k + k % 2, "function", n, f"{n} token {k}", "typescript", v) for k, (n, v) in enumerate([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("a", [0.8, 0.2])], 1)]
    store = spark.createDataFrame(rows, "id string, filepath string, start_line int, end_line int, node_type string, name string, content string, language string, embedding array<double>")
    edges = spark.createDataFrame([("a.ts", "c.ts", 1)], "src string, dst string, seq long")
    embed = lambda text: [1.0, 0.0]
    found = lambda given, **more: [(r.filepath, r.start_line, round(r.score, 2), r.rank, r.stage) for r in retrieval.search(store, edges, "token 3", embed, given, **more).collect()]
    one = {"top_k": 1, "rerank_top_k": 2}
    best = found(one | {"reranker": "bge"})
    assert [x[:2] for x in best] == [("c.ts", 3), ("a.ts", 1)] and {x[4] for x in best} == {"reranked"}

    def broken(*_):
        raise RuntimeError("no model")

    first = [("a.ts", 1, 1.0, 1, "reranked"), ("a.ts", 4, 0.0, 2, "reranked")]
    assert found(one | {"reranker": "bge"}, scorer=broken) == found(one) == found(one, ask=broken) == found(one, ask=lambda p: "none") == first
    assert found(one, ask=lambda p: "[2, 0]" if "[2] c.ts: c" in p else "")[0] == ("c.ts", 3, 1.0, 1, "reranked")
    assert len(found(one | {"reranker": "none"})) == 3
    plain = retrieval.search(store, None, "x", embed, {"rerank_top_k": 3}).collect()
    assert [r.start_line for r in plain] == [1, 2, 4] and {r.stage for r in plain} == {"vector"}
    with pytest.raises(ValueError, match="query is required"):
        retrieval.search(store, edges, " ", embed)
    files = spark.createDataFrame([("a.ts", "one\ntwo"), ("d/e.ts", "x")], "filepath string, content string")
    tools = agent.tools(files, store, edges, lambda q, given: retrieval.search(store, edges, q, embed, given))
    text = tools["search_code"]("token", 2)
    assert text.startswith("Found 2 relevant code chunks:\n\n[1] a.ts (lines 1-2)\nType: function | Name: a\nScore: 1.000\n\n```typescript\n") and "[2] " in text
    assert tools["search_code"]("").startswith("Error searching code: query is required")
    assert tools["read_file"]("a.ts", 2) == "2: two" and tools["list_directory"]() == "d/\na.ts" and tools["get_file_dependencies"]("c.ts") == "Imports: \nImported by: a.ts"
    assert tools["find_symbol"]("nothing") == "Symbol not found: nothing"


def test_store_changes(spark, monkeypatch):
    store = spark.createDataFrame([("a", [1.0, 0.0], "x"), ("b", [0.0, 1.0], None)], "id string, embedding array<double>, filepath string")
    new = spark.createDataFrame([("a", [0.5, 0.5], "y"), ("a", [0.1, 0.9], "z")], "id string, embedding array<double>, filepath string").coalesce(1)
    assert {r.id: r.filepath for r in vector.upsert(store, new).collect()} == {"a": "z", "b": None}
    with pytest.raises(Exception, match="dimension mismatch"):
        vector.upsert(store, spark.createDataFrame([("c", [1.0], "x")], store.schema)).collect()
    many = [f"n{k}" for k in range(500)] + ["b"]
    assert [r.id for r in vector.delete_ids(store, many).collect()] == ["a"] and vector.with_ids(store, many).count() == 1
    assert vector.delete_path(store, "x").count() == 1
    near = vectors(spark, *STORE)
    got = vector.batch_top_k(near, near.select(F.col("id").alias("q"), "embedding"), 1, "id", "q", min_score=0.1).collect()
    assert {(r.q, r.id) for r in got} == {("a", "a"), ("b", "b"), ("c", "c")}
    queries = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(9)], "q int, embedding array<double>")
    whole = sorted(map(tuple, vector.batch_top_k(store, queries, 1, "id", "q").collect()))
    monkeypatch.setattr(nearest, "BROADCAST_NUMBERS", 6)
    assert sorted(map(tuple, vector.batch_top_k(store, queries, 1, "id", "q").collect())) == whole and len(whole) == 9


CODE = {
    "regex": ("const re = /[{]/;\nexport function g() { return 1; }\n", ["g"]),
    "division": ("function a(x) { return x / 2; } function b(y) { return y / 3 /* } */; }\n", ["a", "b"]),
    "template": ("const t = `${[1].map(x => `}${x}{`)}`;\nfunction after() {}\n", ["t", "after"]),
    "argument": ("app.get('/x', async (req, res) => {\n  res.end();\n});\nfunction after() {}\n", ["anonymous", "after"]),
    "single": ("list.map(x => x + 1);\n", ["anonymous"]),
    "types": ("function f(cb: (x: number) => void, o: { a: () => void }): () => void { return cb; }\nconst h: (a: A) => B = other;\n", ["f"]),
    "default": ("export default () => 1;\n", ["anonymous"]),
    "object": ("send({ go() { return 1; }, on: (e) => e });\n", ["go", "anonymous"]),
    "abstract": ("abstract class A { abstract x(): void; run(): void { go(); } }\nexport abstract class B { run() {} }\n", ["run"]),
    "overload": ("function over(a: string): void;\nfunction over(a) { return a; }\nfunction* gen() { yield 1; }\n", ["over"]),
    "pattern": ("const { a, b } = wrap(() => 1);\nfor (const x of y) { z(); }\n", ["{ a, b }"]),
    "nested": ("if (x) {\n  function inner() {}\n  class K { m() {} }\n}\n", ["inner", "K", "m"]),
}


@pytest.mark.parametrize("name", CODE)
def test_script_chunks(name):
    text, names = CODE[name]
    assert [r[6] for r in chunking.parse("a.ts", text)] == names


def test_markup_only_in_its_own_files():
    text = "export const App = () => <div className=\"x\">{items.map(i => <Item key={i} text='}' />)} don't {/* } */}</div>;\nfunction Next() { return <><b>it's</b></>; }\n"
    assert [r[6] for r in chunking.parse("a.tsx", text)] == ["App", "Next"] and [r[6] for r in chunking.parse("a.ts", "const f = <T>(x: T) => x;\nfunction g() {}\n")] == ["f", "g"]
    assert chunking.parse("a.ts", "export default () => 1;")[0][9] == ["anonymous"]


@pytest.mark.parametrize("text", ["const x = a +\n" * 20_000, "const x = [\n" + "  a +\n" * 40_000 + "];\n", "`${" * 5_000, "const f = (a) => a\n" * 5_000, "((((" * 20_000, "<a " * 20_000, "x: {" * 10_000], ids=lambda t: t[:8])
def test_scanner_takes_linear_time(text):
    import time

    began = time.time()
    list(chunking._typescript(text, True))
    assert time.time() - began < 10


def _hits(spark, n=6):
    rows = [(f"c{k}", f"f{k}.ts", k, k, "function", f"n{k}", "x" * k, 1.0 - k / 10, k + 1, "graph") for k in range(n)]
    return spark.createDataFrame(rows, "id string, filepath string, start_line int, end_line int, node_type string, name string, content string, score double, rank int, stage string")


@pytest.mark.parametrize(("case", "error"), [("raises", "no weights"), ("load", "ZeroDivisionError"), ("slow", "no answer"), ("short", "1 scores for")])
def test_a_model_that_fails_in_a_task_leaves_the_first_k(spark, case, error):
    def load():
        import time

        def raises(query, passages):
            raise ValueError("no weights")

        def slow(query, passages):
            time.sleep(20)
            return [0.0] * len(passages)

        return {"raises": lambda: raises, "load": lambda: 1 / 0, "slow": lambda: slow, "short": lambda: lambda q, p: [1.0]}[case]()

    hits = _hits(spark).coalesce(1)
    scorer = retrieval.model_scorer(load, limit_s=1.0)
    assert all(error in r.error and r.rerank_score is None for r in scorer("q", hits).collect())
    got = retrieval.rerank_by(hits, scorer, "q", 3).orderBy("rank").collect()
    assert [(r.id, r.score, r.stage) for r in got] == [("c0", 1.0, "reranked"), ("c1", 0.9, "reranked"), ("c2", 0.8, "reranked")]


def test_a_model_in_the_tasks_ranks(spark):
    hits = _hits(spark)
    scorer = retrieval.model_scorer(lambda: lambda q, p: [float(x.count(q)) for x in p])
    got = retrieval.rerank_by(hits, scorer, "x", 2).orderBy("rank").collect()
    assert [(r.id, r.score, r["rank"]) for r in got] == [("c5", 5.0, 1), ("c4", 4.0, 2)]
    assert [r.id for r in retrieval.rerank_by(hits.limit(2), scorer, "x", 2).orderBy("rank").collect()] == ["c0", "c1"]
    assert "c3.ts" not in scorer("x", hits.limit(0)).collect()


def test_search_function_of_sql(spark):
    store = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.6, 0.8]), ("d", [0.3, 0.953939]), ("e", [0.0, 0.0]), ("f", None)], "id string, embedding array<float>")
    vector.register_search(spark, store)
    asked = lambda more="": [r.id for r in spark.sql(f"SELECT * FROM search_chunks(array(1D, 0D){more}) ORDER BY similarity DESC, id").collect()]
    assert asked() in (["a", "b", "c"], ["a", "b", "c", "d"]) and asked(", 1") == ["a"] and asked(", 10, 0.5D") == ["a", "b", "c"] and asked(", min_similarity => -1D") == ["a", "b", "c", "d", "e"] and asked(", match_count => 0") == []


def test_hops_broadcast_by_counted_rows(spark, monkeypatch):
    """Many files in few bytes of Parquet: more than the bound are not broadcast, whatever the threshold for bytes."""
    monkeypatch.setattr(graph, "BROADCAST_FILES", 1000)
    edges = spark.range(40_000).select(F.lit("hub").alias("src"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("dst"))
    confs = {"spark.sql.maxBroadcastTableSize": "4m", "spark.sql.autoBroadcastJoinThreshold": "10m"}
    old = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        got = graph.hops(edges, spark.createDataFrame([("hub",)], "filepath string")).groupBy("hop").count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {r.hop: r["count"] for r in got} == {0: 1, 1: 40_000}


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_hops_of_a_graph(spark, threshold):
    """Chains, cycles, a hub, null ends and repeated edges, against a loop."""
    import random
    from collections import defaultdict

    rnd = random.Random(4)
    pairs = [(f"c{k}", f"c{k + 1}") for k in range(5)] + [("c5", "c0"), ("c2", "c2"), ("c3", None), (None, "c9"), ("far", "away")]
    pairs += [("hub", f"h{k}") for k in range(300)] + [(f"h{rnd.randrange(300)}", f"t{rnd.randrange(40)}") for _ in range(60)] + [("c4", "hub")] * 3
    edges = spark.createDataFrame(pairs, "src string, dst string")
    start = spark.createDataFrame([("c0",), ("c0",), (None,), ("lonely",)], "filepath string")

    def loop(most, ways):
        out = defaultdict(set)
        for a, b in pairs:
            if a and b:
                for x, y in ((a, b), (b, a))[ways]:
                    out[x].add(y)
        hop = {"c0": 0, "lonely": 0}
        front = set(hop)
        while front and (most is None or max(hop[f] for f in front) < most):
            front = {y for x in front for y in out[x] if y not in hop}
            hop |= {y: max(hop.values()) + 1 for y in front}
        return hop

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        for most, imports, dependents, ways in ((None, True, True, slice(0, 2)), (2, True, True, slice(0, 2)), (None, True, False, slice(0, 1)), (3, False, True, slice(1, 2))):
            got = graph.hops(edges, start, most, imports, dependents).collect()
            assert {r.filepath: r.hop for r in got} == loop(most, ways) and len(got) == len(loop(most, ways))
        assert graph.hops(edges, start, 0).count() == 2 and graph.hops(edges, start, None, False, False).count() == 2
        assert graph.hops(edges, start.limit(0)).count() == 0 and graph.hops(edges.limit(0), start).count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("neighbours_")]


def test_edges_are_dealt_once_by_file(spark):
    """One shuffle by the importing file after the join, none for the aggregations and the order; paths normalise as a loop does."""
    import re

    from lodestone.functions.paths import normal

    texts = ["import { a } from './p1';\nimport b, { c } from './p2';\nimport './p3';\nimport {  } from './p3';\nconst x = require('./sub/../p1'); import('./p2');", "import * as p from '../p1.ts';"]
    files = spark.createDataFrame([("m.ts", texts[0]), ("sub/n.ts", texts[1]), *((f"p{k}.ts", "") for k in range(1, 4)), ("p1.js", "")], "filepath string, content string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = graph.edges(files)
        plan = edges._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 4, plan
        assert sorted(map(tuple, edges.collect())) == [("m.ts", "p1.ts", 1), ("m.ts", "p2.ts", 2), ("sub/n.ts", "p1.ts", 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

    def loop(path):
        out = []
        for s in path.split("/"):
            if s == "..":
                out = out[:-1]
            elif s not in ("", "."):
                out.append(s)
        return "/".join(out)

    paths = ["", "/", ".", "..", "./a", "/./a", "a//b/.", "a/./b/", "a/b..", "..a/b", ".a/.b", "...", "a/../b", "../../a/b/..", "//a///b//", "./", "a/.\n", "a/\n", "a/..b/./c"]
    assert [tuple(r) for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", normal(F.col("p"))).collect()] == [(p, loop(p)) for p in paths]
