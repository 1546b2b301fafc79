"""Tools over the tables, and a driver-side loop that lets a model call them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_READ, MAX_STEPS, LOG = 500, 10, 500


def read_file(files: DataFrame, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    """(line, text) of a range of at most 500 lines; `..` segments are taken out of the path."""
    clean = "/".join(s for s in path.split("/") if s not in ("", ".", ".."))
    last = min(end if end is not None else start + MAX_READ - 1, start + MAX_READ - 1)
    rows = files.where(F.col("filepath") == clean).select(F.posexplode(F.split("content", "\n")).alias("line", "text"))
    return rows.withColumn("line", F.col("line") + 1).where(F.col("line").between(start, last)).orderBy("line")


def list_directory(files: DataFrame, folder: str = "", depth: int = 1, children: int = 20) -> DataFrame:
    """(name, is_folder, child): entries of a folder, folders first; with depth 2 up to 20 children of each."""
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    rows = files.where(F.col("filepath").startswith(prefix)).select(F.split(F.expr(f"substr(filepath, {len(prefix) + 1})"), "/").alias("p"))
    rows = rows.select(F.get("p", F.lit(0)).alias("name"), (F.size("p") > 1).alias("is_folder"), F.get("p", F.lit(1)).alias("child")).where(~F.col("name").isin("node_modules", ".git", "dist"))
    # a folder may have any number of children: only the first of each are gathered
    first = Window.partitionBy("name", "is_folder").orderBy(F.col("child").asc_nulls_last())
    few = rows.distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max(1, children if depth > 1 else 1))
    kept = F.array_sort(F.collect_list("child")) if depth > 1 else F.array().cast("array<string>")
    out = few.groupBy("name", "is_folder").agg((kept if depth > 1 else F.first(kept)).alias("children"))
    return out.orderBy(F.desc("is_folder"), "name")


def find_symbol(chunks: DataFrame, symbol: str, n: int = 5) -> DataFrame:
    """Chunks whose name holds the symbol or whose content defines it, with an excerpt."""
    low = symbol.lower()
    heads = [f"{h} {low}" for h in ("function", "class", "interface", "type", "const", "def", "func", "fn")]
    rule = F.contains(F.lower("name"), F.lit(low))
    for h in heads:
        rule = rule | F.contains(F.lower("content"), F.lit(h))
    return chunks.where(rule).orderBy("filepath", "start_line").limit(n).withColumn("excerpt", F.substring("content", 1, 500))


def file_dependencies(edges: DataFrame, path: str, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(imports, importers) of a file by its graph edges."""
    return edges.where(F.col("src") == path).select("dst"), edges.where(F.col("dst") == path).select("src").distinct().orderBy("src").limit(n)


SEARCH_K, RERANK_K, EXPANDED = 15, 10, 10


def search_code(search: Callable[[str, dict], DataFrame], query: str, top_k: int = 5) -> str:
    """The tool's text for `search` (query, options): ten numbered chunks at most; an error is its text."""
    given = {"top_k": min(top_k, SEARCH_K), "rerank_top_k": min(top_k, RERANK_K), "reranker": "llm", "max_hops": 1, "max_expanded_chunks": EXPANDED}
    try:
        rows = search(query, given).orderBy("rank").collect()  # RERANK_K rows at most
    except Exception as e:  # a tool's error is its answer
        return f"Error searching code: {e}"
    if not rows:
        return "No results found for this query. Try rephrasing or being more specific."
    shown = []
    for k, r in enumerate(rows, 1):
        at = f"line {r.start_line}" if r.start_line == r.end_line else f"lines {r.start_line}-{r.end_line}"
        shown.append(f"[{k}] {r.filepath} ({at})\nType: {r.node_type} | Name: {r.name}\nScore: {r.score:.3f}\n\n```{r.language}\n{r.content}\n```")
    return f"Found {len(rows)} relevant code chunks:\n\n" + "\n\n---\n\n".join(shown)


def tools(files: DataFrame, chunks: DataFrame, edges: DataFrame, search: Callable[[str, dict], DataFrame]) -> dict[str, Callable[..., str]]:
    """The registry for `loop`: each tool over the tables, as text of bounded length."""

    def read(path: str, start: int = 1, end: int | None = None) -> str:
        return "\n".join(f"{r.line}: {r.text}" for r in read_file(files, path, start, end).collect()) or f"File not found: {path}"

    def folder(path: str = "", depth: int = 1) -> str:
        rows = list_directory(files, path, depth).limit(MAX_READ).collect()
        return "\n".join(f"{r.name}/" * r.is_folder or r.name for r in rows) or f"Directory not found: {path}"

    def dependencies(path: str) -> str:
        used, users = file_dependencies(edges, path)
        return "Imports: " + ", ".join(r.dst for r in used.limit(MAX_READ).collect()) + "\nImported by: " + ", ".join(r.src for r in users.collect())

    def symbol(name: str) -> str:
        return "\n\n".join(f"{r.filepath}:{r.start_line}\n{r.excerpt}" for r in find_symbol(chunks, name).collect()) or f"Symbol not found: {name}"

    return {
        "search_code": lambda query, top_k=5: search_code(search, query, top_k),
        "read_file": read,
        "list_directory": folder,
        "get_file_dependencies": dependencies,
        "find_symbol": symbol,
    }


@dataclass
class Run:
    answer: str = ""
    steps: list[dict] = field(default_factory=list)
    input_tokens: int = 0
    output_tokens: int = 0
    searches: int = 0
    files: set[str] = field(default_factory=set)


def loop(model: Callable[[list[dict]], dict], tools: dict[str, Callable[..., str]], query: str, max_steps: int = MAX_STEPS) -> Run:
    """Let `model` answer or call tools until it answers; after max_steps it is asked for an answer.

    model: messages -> {"text"} or {"tool", "input"}, with "input_tokens" and "output_tokens".
    """
    run, messages = Run(), [{"role": "user", "content": query}]
    for step in range(max_steps + 1):
        if step == max_steps:
            messages.append({"role": "user", "content": "Answer now with what you know."})
        said = model(messages)
        run.input_tokens += said.get("input_tokens", 0)
        run.output_tokens += said.get("output_tokens", 0)
        if "tool" not in said or step == max_steps:
            run.answer = said.get("text", "")
            return run
        name, given = said["tool"], said.get("input", {})
        try:
            out = tools[name](**given) if name in tools else f"unknown tool {name}"
        except Exception as e:  # a tool's error is its answer
            out = f"error: {e}"
        run.searches += name == "search_code"
        run.files |= {given["path"]} if "path" in given else set()
        run.steps.append({"tool": name, "input": given, "output": str(out)[:LOG]})
        messages += [{"role": "assistant", "tool": name, "input": given}, {"role": "tool", "content": out}]
    return run
