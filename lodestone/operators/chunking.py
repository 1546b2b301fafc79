"""Syntax-aligned chunks of source files: a scanner that masks strings and comments and matches braces.

Python files go through the standard parser.  One file in, any number of chunks out, in batches.
"""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import EXTENSIONS, trim
from ..schema import CHUNK

MAX_CHARS, CUT = 2500, "\n// ... truncated"
_WORD = r"[A-Za-z_$][\w$]*"
_TOKENS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_GO_TOKENS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'|`[^`]*`", re.S)
_RUST_TOKENS = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S)
_STATEMENT = r"(?:^|(?<=[;{}\n]))[ \t]*"
_TS = re.compile(
    _STATEMENT + rf"(?P<export>export\s+(?:default\s+)?)?(?P<declare>declare\s+)?(?:"
    rf"(?P<clause>(?<=export )(?:type\s+)?\{{[^}}]*\}})|(?:async\s+)?function\b(?P<star>\s*\*)?\s*(?P<function>{_WORD})?|(?P<abstract>abstract\s+)?class\s+(?P<class>{_WORD})|interface\s+(?P<interface>{_WORD})"
    rf"|type\s+(?P<type>{_WORD})\s*(?=[=<])|(?P<let>const|let)\s+(?!enum\b)(?P<variable>{_WORD}|(?=[\[{{]))|(?P<other>(?<=export )(?:const\s+)?(?:enum|namespace|module)\s+{_WORD}))",
    re.M,
)
_METHOD = re.compile(rf"(?:^|(?<=[;{{}}\n,]))[ \t]*(?P<head>(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?(?P<name>#?{_WORD})\s*(?:<[^>{{(]*>\s*)?)\(", re.M)
_BODY = re.compile(r"\s*(?::\s*(?:[^;={}()]|=>|\{[^{}]*\}|\([^()]*\))*?)?\{")
_ARROW = re.compile(r"\s*(?::[^;={}()]*?)?=>")
_PLAIN_ARROW = re.compile(rf"(?<![\w$.])(?:async\s+)?{_WORD}\s*=>")
_LEAD = re.compile(r"(?:\basync\b\s*)?(?:<[^<>=;(){}]*>\s*)?\Z")
_GO = re.compile(r"^func\s+(?P<receiver>\([^)]*\)\s*)?(?P<function>\w+)|^type\s+(?P<type>\w+)|^type\s*\(", re.M)
_RUST = re.compile(
    r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|extern)\s+)*(?:fn\s+(?P<function>\w+)|struct\s+(?P<struct>\w+)|enum\s+(?P<enum>\w+)|trait\s+(?P<trait>\w+)|mod\s+(?P<mod>\w+)|type\s+(?P<type>\w+)|impl\b(?:<[^{]*?>)?\s*(?P<impl>[^{;]+?)\s*(?:where[^{]*)?(?=\{))",
    re.M,
)
_KEYWORDS = {"if", "for", "while", "switch", "catch", "with", "return", "function", "await", "typeof", "super"}
_CODE = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|(?P<open>[`{])|(?P<close>\})|(?P<slash>/)|(?P<tag><(?=[A-Za-z>]))|(?P<word>[\w$]+)|(?P<space>\s+)|.", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?P<end>`|\$\{|\Z)", re.S)
_TAG = re.compile(r"<[A-Za-z][\w.:-]*(?=[\s/>])(?!\s+extends\b)|<(?=>)")
_IN_TAG = re.compile(r"(?:[^{}\"'/>]|\"[^\"]*\"|'[^']*'|/(?!>))*(?P<end>/>|>|\{|\Z)", re.S)
_IN_ELEMENT = re.compile(r"[^<{]*(?P<end></[\w.:-]*\s*>|<|\{|\Z)", re.S)
#: Words after which an expression begins, so that a slash is not a division.
_BEFORE_EXPRESSION = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "do", "else", "instanceof", "yield", "await"}


def _masked_script(text: str, jsx: bool) -> str:
    """The text with strings, comments, regular expressions, template text and markup as blanks, of equal length.

    A stack holds what is open: a brace, a template, a tag or an element.  One pass; code inside
    `${...}` and `{...}` of markup stays, with its braces.
    """
    out, at, stack, last = [], 0, ["{"], ""  # last: the token before, for slashes and tags
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    while at < len(text):
        state = stack[-1]
        if state == "{":
            m = _CODE.match(text, at)
            token, kind = m[0], m.lastgroup
            starts = not last or last in _BEFORE_EXPRESSION or not (last[-1].isalnum() or last[-1] in "_$)]\"'`")
            if kind == "slash" and starts and (r := _REGEX.match(text, at)):
                out.append(blank(r[0]))
                at, last = r.end(), "'"
                continue
            if kind == "tag" and jsx and starts and (t := _TAG.match(text, at)):
                out.append(blank(t[0]))
                stack.append("tag")
                at = t.end()
                continue
            if kind == "open":
                stack.append(token)
                out.append("{" if token == "{" else " ")
            elif kind == "close":
                if len(stack) > 1:
                    stack.pop()
                out.append("}")
            elif token[0] in "\"'" or token.startswith(("//", "/*")):
                out.append(blank(token))
            else:
                out.append(token)
            if kind != "space" and not token.startswith(("//", "/*")):
                last = token
            at = m.end()
            continue
        m = {"`": _TEMPLATE, "tag": _IN_TAG, "element": _IN_ELEMENT}[state].match(text, at)
        end = m["end"]
        out.append(blank(m[0][: len(m[0]) - len(end)]))
        at, last = m.end(), "("
        if end in ("{", "${"):
            out.append(" " * (len(end) - 1) + "{")
            stack.append("{")
            continue
        out.append(blank(end))
        if end == "<":  # a child element or a fragment
            stack.append("tag")
        elif end == ">" and state == "tag":
            stack[-1] = "element"
        else:
            stack.pop()
            last = "'"
    return "".join(out)


def _brackets(masked: str) -> tuple[dict[int, int], dict[int, int]]:
    """By position of an opening bracket that of its closing one, and that of the bracket around it."""
    pairs, around, stack = {}, {}, []
    for m in re.finditer(r"[(\[{}\])]", masked):
        if m[0] in "([{":
            around[m.start()] = stack[-1] if stack else -1
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    return pairs, around


def detect(path: str) -> str | None:
    low = path.lower()
    return next((k for k, own in EXTENSIONS.items() if low.endswith(own)), None)


def _masked(text: str, rule: re.Pattern) -> str:
    """The text with comments and the insides of strings as blanks, of equal length."""
    return rule.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _close(masked: str, at: int) -> int:
    """After the brace that closes the one at `at`; the end where none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(masked)


_STEPS = re.compile(r"[(\[{]|[)\]}]|;|\n\s*")
_GOES_ON = re.compile(r"[.?:|&=+\-*/,)\]}]")


def _end_of(masked: str, at: int, pairs: dict[int, int] | None = None) -> int:
    """After the statement that goes on at `at`: its semicolon, or line end, outside of all brackets."""
    pairs = _brackets(masked)[0] if pairs is None else pairs
    pos = at
    while m := _STEPS.search(masked, pos):
        pos = m.end()
        if m[0] in "([{":
            if m.start() not in pairs:
                return len(masked)
            pos = pairs[m.start()] + 1
        elif m[0] in ")]}":
            return m.start()
        elif m[0] == ";":
            return m.end()
        else:
            k = m.start() - 1
            while k >= at and masked[k] in " \t\r":
                k -= 1
            if not _GOES_ON.match(masked, m.end()) and not (k >= at and (masked[k] in "=(,|&:?+" or masked[k - 1 : k + 1] == "=>")):
                return m.start()
    return len(masked)


def _arrows(masked: str, pairs: dict[int, int], around: dict[int, int], classes: set[int]) -> list[tuple[int, int]]:
    """(start, place of the body) of arrow functions; function types, which stand where types do, are none."""
    found = []
    for a, b in pairs.items():
        if masked[a] == "(" and (m := _ARROW.match(masked, b + 1)):
            lead = _LEAD.search(masked, max(0, a - 200), a)
            found.append((lead.start() if lead else a, m.end(), a))
    plain = [m for m in _PLAIN_ARROW.finditer(masked) if masked[max(0, m.start() - 1) : m.start()] not in (")", ":")]
    outer_of = around | _outer([m.start() for m in plain], pairs, around, len(masked))
    found += [(m.start(), m.end(), m.start()) for m in plain]
    out = []
    for start, body, key in found:
        k = start - 1
        while k >= 0 and masked[k].isspace():
            k -= 1
        prev, outer = masked[k] if k >= 0 else "", outer_of.get(key, -1)
        if prev == ":":
            if outer < 0 or masked[outer] != "{" or outer in classes or not _is_object(masked, outer, around):
                continue
        elif prev in "|&<" and prev and masked[k - 1] != prev:
            continue
        out.append((start, body))
    return out


def _is_object(masked: str, brace: int, around: dict[int, int]) -> bool:
    """Whether a brace opens an object and not a block or a type: by what stands before it, up to the first that is no colon."""
    while True:
        k = brace - 1
        while k >= 0 and masked[k].isspace():
            k -= 1
        if k < 0 or masked[k] != ":":
            return k >= 0 and (masked[k] in "=(,[?|&!" or masked[max(0, k - 5) : k + 1] == "return")
        brace = around.get(brace, -1)
        if brace < 0 or masked[brace] != "{":
            return False  # an annotation


def _outer(places: list[int], pairs: dict[int, int], around: dict[int, int], end: int) -> dict[int, int]:
    """By place the bracket around it, in one sweep over sorted places."""
    opens, k, stack, out = sorted(around), 0, [], {}
    for at in places:
        while k < len(opens) and opens[k] < at:
            while stack and pairs.get(stack[-1], end) < opens[k]:
                stack.pop()
            stack.append(opens[k])
            k += 1
        while stack and pairs.get(stack[-1], end) < at:
            stack.pop()
        out[at] = stack[-1] if stack else -1
    return out


def _typescript(text: str, jsx: bool = False) -> Iterator[tuple[int, int, str, str, list[str]]]:
    """(start, end, node type, name, exports) of chunks in document order; linear in the text.

    Exported declarations and variables that hold functions are one chunk, nothing inside is; all
    other functions, arrow functions, methods and classes are chunks, and so is what they hold.
    """
    masked = _masked_script(text, jsx)
    pairs, around = _brackets(masked)
    heads = [(m.end() - len(m[0].lstrip()), 0, m) for m in _TS.finditer(masked)]
    classes = {brace for _, _, m in heads if m["class"] and (brace := masked.find("{", m.end())) >= 0}
    heads += [(m.start("head"), 1, m) for m in _METHOD.finditer(masked) if m["name"] not in _KEYWORDS]
    arrows = _arrows(masked, pairs, around, classes)
    heads += [(start, 2, body) for start, body in arrows]
    heads.sort(key=lambda h: h[:2])
    inner = sorted([start for start, _ in arrows] + [m.start() for m in re.finditer(r"\bfunction\b", masked)])
    holds = lambda a, b: bisect_left(inner, b) > bisect_left(inner, a)
    outer = _outer([h[0] for h in heads], pairs, around, len(masked))
    ends: dict[int, int] = {}  # by the bracket around it the end of the variable statement that was looked at last

    def statement(begin: int, at: int) -> int:
        if begin >= ends.get(outer[begin], 0):
            ends[outer[begin]] = _end_of(masked, at, pairs)
        return ends[outer[begin]]

    past = 0  # nothing before this is looked into
    for begin, kind, m in heads:
        if begin < past:
            continue
        if kind == 2:
            brace = re.compile(r"\s*").match(masked, m).end()
            end = pairs[brace] + 1 if masked[brace : brace + 1] == "{" and brace in pairs else _end_of_expression(masked, m, pairs)
            given = re.compile(r"export\s+default\s+\Z").search(masked, max(0, begin - 40), begin)
            yield begin, end, "function", "anonymous", ["anonymous"] if given else []
            continue
        if kind == 1:
            close = pairs.get(m.end() - 1)
            if close is not None and (body := _BODY.match(masked, close + 1)):
                yield begin, pairs.get(body.end() - 1, len(masked) - 1) + 1, "function", m["name"], []
            continue
        exported = bool(m["export"])
        if m["clause"]:
            past = _end_of(masked, m.end(), pairs)
            names = [re.split(r"\s+as\s+", s.strip())[0] for s in m["clause"][m["clause"].index("{") + 1 : -1].split(",") if s.strip()]
            yield begin, past, "other", ", ".join(names), []
        elif m["other"]:
            past = _end_of(masked, m.end(), pairs)
        elif m["let"]:
            end = statement(begin, m.end())
            name = m["variable"] or text[m.end() : pairs.get(m.end(), m.end()) + 1]
            if m["declare"] and exported:
                past = end
            elif not m["declare"] and (exported or holds(m.end(), end)):
                past = end
                yield begin, end, "function", name, [name] if exported else []
        elif m["type"] or m["interface"]:
            brace = masked.find("{", m.end())
            past = pairs.get(brace, len(masked) - 1) + 1 if m["interface"] else _end_of(masked, m.end(), pairs)
            if not (m["declare"] and exported):
                yield begin, past, "type" if m["type"] else "interface", m["type"] or m["interface"], [m["type"] or m["interface"]] if exported else []
        elif m["class"]:
            brace = masked.find("{", m.end())
            end = pairs.get(brace, len(masked) - 1) + 1
            if not m["abstract"] and not (m["declare"] and exported):
                yield begin, end, "class", m["class"], [m["class"]] if exported else []
            past = end if exported else m.end()
        else:
            at = masked.find("(", m.end())
            body = _BODY.match(masked, pairs[at] + 1) if at in pairs else None
            end = pairs.get(body.end() - 1, len(masked) - 1) + 1 if body else _end_of(masked, m.end(), pairs)
            name = m["function"] or "anonymous"
            if body and not m["star"] and (m["function"] or exported):
                yield begin, end, "function", name, [name] if exported else []
            past = end if exported else m.end()


def _end_of_expression(masked: str, at: int, pairs: dict[int, int]) -> int:
    """After the expression at `at`: before a comma, a closing bracket, or the end of its statement."""
    pos = at
    rule = re.compile(r"[(\[{]|[)\]},;]|\n\s*")
    while m := rule.search(masked, pos):
        pos = m.end()
        if m[0] in "([{":
            if m.start() not in pairs:
                return len(masked)
            pos = pairs[m.start()] + 1
        elif m[0] in ")]},;":
            return m.start()
        elif masked[at : m.start()].strip() and not _GOES_ON.match(masked, m.end()) and masked[m.start() - 1] not in "=(,|&:?+>":
            return m.start()
    return len(masked)


def _go(text: str) -> Iterator[tuple]:
    masked = _masked(text, _GO_TOKENS)
    for m in _GO.finditer(masked):
        if m["function"]:
            brace = masked.find("{", m.end())
            end = _close(masked, brace) if brace >= 0 else _end_of(masked, m.end())
            yield m.start(), end, "function", m["function"], []
        elif m["type"]:
            end = _end_of(masked, m.end())
            yield m.start(), end, "type", m["type"], []
            yield m.start() + 5, end, "struct", m["type"], []
        else:
            end = _end_of(masked, m.end() - 1)
            specs = [(m.end() + s.start(1), s[1]) for s in re.finditer(r"^\s*(\w+)\s+(?=\S)", masked[m.end() : end], re.M)]
            yield m.start(), end, "type", specs[0][1] if specs else "anonymous", []
            for at, name in specs:
                yield at, _end_of(masked, at), "struct", name, []


def _rust(text: str) -> Iterator[tuple]:
    kinds = {"function": "function", "struct": "struct", "enum": "type", "trait": "interface", "mod": "module", "type": "type", "impl": "class"}
    masked = _masked(text, _RUST_TOKENS)
    for m in _RUST.finditer(masked):
        kind = m.lastgroup
        name = m[kind].strip()
        if kind == "impl":
            name = "impl " + re.split(r"\bfor\s+", name)[-1].strip()
        brace, stop = masked.find("{", m.end()), masked.find(";", m.end())
        end = _close(masked, brace) if brace >= 0 and not 0 <= stop < brace else stop + 1 if stop >= 0 else len(masked)
        yield m.end() - len(m[0].lstrip()), end, kinds[kind], name, []


def _python(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(first line, last line, node type, name), with decorators' lines; nested definitions after their parent."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    todo: list[ast.AST] = [tree]
    while todo:
        node = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            yield first, node.end_lineno or node.lineno, "class" if isinstance(node, ast.ClassDef) else "function", node.name
        todo += reversed(list(ast.iter_child_nodes(node)))


def import_paths(text: str, language: str) -> list[str]:
    """Modules that a file imports, in order."""
    if language == "typescript":
        return [m[1] for m in re.finditer(r"^\s*import\b[^'\";]*['\"]([^'\"]+)['\"]", text, re.M)]
    if language == "python":
        return [m[1] or m[2] for m in re.finditer(r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", text, re.M)]
    if language == "go":
        body = "".join(m[0] for m in re.finditer(r"^import\s*(?:\([^)]*\)|[^\n]*)", text, re.M))
        return re.findall(r"\"([^\"]+)\"", body)
    return [m[1].strip() for m in re.finditer(r"^\s*(?:pub\s+)?use\s+([^;]+);", text, re.M)]


#: Names of the language's own types.
_OWN_TYPES = "any|bigint|boolean|never|null|number|object|string|symbol|undefined|unknown|void"
_TYPES = re.compile(rf"\b(?:class|interface|type|enum)\s+([A-Za-z_$]\w*)|(?:[:|&]|\b(?:extends|implements|as|is|keyof)\b|=>)\s*(?:readonly\s+)?([A-Z]\w*|(?:{_OWN_TYPES})\b)|<([\w$\s,.|&<>\[\]]*)>|\bimplements\b([\w$\s,.]+)")


def type_references(code: str) -> list[str]:
    """Distinct names of types in document order: declared ones, annotations, type arguments, extends and implements."""
    out = []
    for m in _TYPES.finditer(_masked(code, _TOKENS)):
        listed = m[3] or m[4]
        out += re.findall(rf"\b(?:[A-Z]\w*|(?:{_OWN_TYPES}))\b", listed) if listed else [m[1] or m[2]] if m[1] or m[2] else []
    return list(dict.fromkeys(out))


def parse(path: str, text: str) -> list[tuple]:
    """Chunks of one file as rows of the chunk schema; none for other languages and unreadable files."""
    language = detect(path)
    if not language or not text:
        return []
    if language == "python":
        spans = [(a, b, kind, name, []) for a, b, kind, name in _python(text)]
    else:
        found = _typescript(text, path.endswith((".tsx", ".jsx"))) if language == "typescript" else {"go": _go, "rust": _rust}[language](text)
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        line = lambda at: bisect_right(starts, at)
        spans = []
        for a, b, kind, name, out in found:
            while b - 1 > a and text[b - 1].isspace():
                b -= 1
            spans.append((line(a), line(max(a, b - 1)), kind, name, out))
    rows, source, used = [], text.split("\n"), import_paths(text, language)
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    for a, b, kind, name, out in spans:
        content = "\n".join(source[a - 1 : b])
        sha = hashlib.sha256(f"{path}:{a}:{content}".encode()).hexdigest()[:12]
        rows.append((f"{stem}-{sha}", content, path, a, b, kind, name, language, used, out, [] if kind == "other" else type_references(content)))
    return rows


def chunks(files: DataFrame) -> DataFrame:
    """The chunk rows of all files."""
    names = [c.split()[0] for c in re.split(r", (?=\w+ )", CHUNK)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, c in zip(frame["filepath"], frame["content"], strict=True) for r in parse(p, c or "")]
            yield pd.DataFrame(rows, columns=names)

    return files.select("filepath", "content").mapInPandas(run, CHUNK)


@F.udtf(returnType=CHUNK)
class ParseFile:
    """The chunks of one file, as a table function: `FROM files, LATERAL parse_file(filepath, content)`."""

    def eval(self, filepath: str, content: str) -> Iterator[tuple]:
        yield from parse(filepath or "", content or "")


def register(spark: SparkSession) -> None:
    """Make `parse_file` known to the session's SQL."""
    spark.udtf.register("parse_file", ParseFile)


def content_hash_id(path: Column, line: Column, content: Column) -> Column:
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(stem, F.lit("-"), F.substring(F.sha2(F.concat_ws(":", path, line.cast("string"), content), 256), 1, 12))


def line_range_id(path: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", path, start, end)


def slice_lines(content: Column, start: Column, end: Column) -> Column:
    return F.array_join(F.slice(F.split(content, "\n"), start, end - start + 1), "\n")


def only_comments(content: Column) -> Column:
    """Whether every line is blank or begins like a comment."""
    return F.forall(F.split(content, "\n"), lambda s: trim(s).rlike(r"^(//|/\*|\*|#|$)"))


def validate(content: Column) -> Column:
    """Why a chunk is invalid (empty, only comments, too short, in that order); null if valid."""
    own = trim(content)
    return F.when(content.isNull() | (own == ""), "empty").when(only_comments(content), "only comments").when(F.length(own) < 10, "too short")


def truncate(content: Column, limit: int = MAX_CHARS) -> Column:
    return F.when(F.length(content) > limit, F.concat(F.substring(content, 1, limit), F.lit(CUT))).otherwise(content)
