"""Secret scans: pattern spans, and a guess-cost dynamic programme over credential-context values.

`guess_cost` is the least log10 number of guesses over all segmentations of a value into dictionary
words, dates, repeats, keyboard walks and brute-force characters.  A value that follows a credential
name (or stands as the password of a URL) and costs `min_cost` or more is a span of kind `guess`,
unless a pattern span covers it wholly.  An authentication scheme before the value is not part of it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import id_text, slices
from .textcore import buffers

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_SCHEME = r"(?:bearer|basic|digest|token|negotiate|hmac)"
#: Names of credentials, then a separator, perhaps a scheme, and a value; the password of a URL; a bearer's token.
CONTEXT = re.compile(
    r"(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?|bearer)"
    r"[\"']?\x20*(?:[:=]|=>)\x20*[\"']?"
    rf"(?ai:{_SCHEME}[\x20\t]+)?(?!(?ai:{_SCHEME})(?:[\s\"'<>,;]|$))([^\s\"'<>,;]{{6,}})"
    r"|://[^\s/:@]+:([^\s/@]{6,})@"
    r"|(?<![A-Za-z])(?ai:bearer)[\x20\t]+([^\s\"'<>,;]{6,})"
)
#: log10 of the guesses from which a credential value counts as a secret.
MIN_COST = 8.0
#: Common parts of passwords, most frequent first.
WORDS = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login hello secret abc princess football baseball "
    "shadow sunshine iloveyou trustno superman batman access flower love michael jordan hunter summer winter spring autumn "
    "pass test user guest root default example sample changeme temp demo token key value none null true false the and for "
    "you with this that from have your are was not but all can one out day get has him his how man new now old see two way "
    "who boy did its let put say she too use dad mom cat dog god sex money magic ginger pepper cookie cheese computer "
    "internet server service private public system office company school student teacher orange purple yellow silver "
    "golden black white green blue red star moon sun fire water earth wind king queen"
).split()
#: Words of a corpus that `corpus_words` gives at most, and the documents that must have one.
MOST_WORDS, WORD_DOCS = 50_000, 10
_KEYS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
_LEET = str.maketrans("4301$57@!", "aeoissta" + "i")
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")


def _adjacent() -> dict[str, str]:
    """Keys beside each key, from the rows' positions; a row stands half a key right of the one above."""
    at = {c: (x + y / 2, y) for y, row in enumerate(_KEYS) for x, c in enumerate(row) if c != " "}
    return {c: "".join(d for d, (u, v) in at.items() if d != c and abs(u - x) <= 1 and abs(v - y) <= 1) for c, (x, y) in at.items()}


NEAR = _adjacent()
#: Characters of a repeated unit, and of a word or date, at most; costs of a date, of a walk's first key and of a turn.
MOST_UNIT, LONGEST = 8, 32
_DATE_COST, _KEYS_COST, _TURN = math.log10(365 * 120), math.log10(len(NEAR)), math.log10(5)


def _case_cost(word: str) -> float:
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    if upper == len(word) or (upper == 1 and word[0].isupper()):
        return math.log10(2)
    return math.log10(sum(math.comb(len(word), k) for k in range(1, min(upper, len(word) - upper) + 1)) + 1)


class Dictionary(dict):
    """Ranks by word; `prefixes` holds all beginnings of words, so that a lookup stops early."""

    def __init__(self, words: Sequence[str]):
        super().__init__({w.lower(): k + 1 for k, w in reversed(list(enumerate(words))) if len(w) <= LONGEST})
        self.prefixes = {w[:k] for w in self for k in range(1, len(w) + 1)}


class _Starts:
    """Starts i of a growing token, whose cost at its end j is base + log10((j - i) / unit).

    Of two starts the older one gains with j, so one that an older start beats is dropped for good.
    """

    __slots__ = ("held", "shortest", "unit")

    def __init__(self, unit: int, shortest: int):
        self.unit, self.shortest, self.held = unit, shortest, []

    def add(self, i: int, base: float) -> None:
        self.held.append((i, base))

    def least(self, j: int) -> float:
        """The least cost at j over starts that are `shortest` away at least."""
        out, held, unit, shortest = math.inf, self.held, self.unit, self.shortest
        if len(held) == 1:
            i, base = held[0]
            return base + math.log10((j - i) / unit) if j - i >= shortest else out
        keep = []
        for i, base in held:
            if j - i < shortest:
                keep.append((i, base))
            elif (cost := base + math.log10((j - i) / unit)) < out:
                out = cost
                keep.append((i, base))
        self.held = keep
        return out


def guess_cost(value: str, ranks: Dictionary | None = None, enough: float = math.inf) -> float:
    """The least log10 guesses over all segmentations; 0 for the empty value.

    Linear in the value's length.  A result of `enough` or more may be a lower bound, from the place
    where every segmentation has reached `enough`.
    """
    ranks = _RANKS if ranks is None else ranks
    n, low = len(value), value.lower()
    if len(low) != n:  # a few characters grow in lower case
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in value)
    alphabet = sum(size for rx, size in ((r"[a-z]", 26), (r"[A-Z]", 26), (r"\d", 10), (r"[^a-zA-Z\d]", 33)) if re.search(rx, value))
    per_char, plain, prefixes = math.log10(max(alphabet, 10)), low.translate(_LEET), ranks.prefixes
    same_text = plain == low
    best = [0.0] + [math.inf] * n
    repeats = {u: [_Starts(u, 2 * u) for _ in range(u)] for u in range(1, MOST_UNIT + 1)}
    run = [0] * (MOST_UNIT + 1)  # characters before j that equal those a unit earlier
    walk, turns, walked, step = _Starts(1, 3), 0, 0, None  # keys walked so far, and turns of the walk up to j
    for j in range(n + 1):
        if j:
            here = min(best[j], best[j - 1] + per_char)
            char = value[j - 1]
            for u in range(1, min(MOST_UNIT, j - 1) + 1):  # repeats of short units
                if value[j - 1 - u] != char:
                    run[u] = 0
                    continue
                run[u] += 1
                if run[u] >= u and (u == 1 or run[1] < 2 * u):  # equal characters are repeats of one
                    starts = repeats[u][j % u]
                    if run[u] < 2 * u or u > 1 and starts.held and starts.held[-1][0] < j - run[u] - u:
                        starts.held = [x for x in starts.held if x[0] >= j - run[u] - u]
                    i = j - 2 * u
                    if not starts.held or starts.held[-1][0] < i:
                        starts.add(i, best[i] + u * per_char)
                    here = min(here, starts.least(j))
            if j > 1 and (near := NEAR.get(low[j - 2])) and (new := near.find(low[j - 1])) >= 0:
                turns += new != step
                step, walked = new, walked + 1
                # a walk from i turns once at its first step, then as the walk does from there
                walk.add(j - 2, best[j - 2] - (turns - 1) * _TURN)
                if walked >= 2:
                    here = min(here, walk.least(j) + _KEYS_COST + turns * _TURN)
            else:
                walk.held, walked, step = [], 0, None
            best[j] = here
            if j % 64 == 0 and enough < math.inf:
                ahead = min(best[max(0, j - 2 * MOST_UNIT - 1) : j + 1 + LONGEST])
                if min([ahead, *(x[1] for s in (walk, *(s for r in repeats.values() for s in r)) for x in s.held)]) >= enough:
                    return enough
        here = best[j]
        for text, extra in ((low, 0.0),) if same_text else ((low, 0.0), (plain, math.log10(2))):
            k = j + 1  # words, with case and substitutions
            while k <= n and (part := text[j:k]) in prefixes:
                if k - j > 1 and (rank := ranks.get(part)) is not None:
                    best[k] = min(best[k], here + math.log10(rank + 1) + _case_cost(value[j:k]) + extra)
                k += 1
        if j < n and "0" <= value[j] <= "3" and (m := _DATE.match(value, j)):
            best[m.end()] = min(best[m.end()], here + _DATE_COST)
    return best[n]


_RANKS = Dictionary(WORDS)


def base_spans(text: str, hex_run: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern spans; failing matches consume text like others."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hex_run:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def guessed_spans(text: str, cost, min_cost: float, base: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Credential-context values that no pattern span covers wholly and that cost `min_cost` guesses or more."""
    if ":" not in text and "=" not in text and "bearer" not in text.lower():
        return []
    out = []
    for m in CONTEXT.finditer(text):
        a, b = m.span(m.lastindex)
        if not any(s <= a and b <= e for s, _, e in base) and cost(text[a:b]) >= min_cost:
            out.append((a, 3, b))
    return out


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = MOST_WORDS, least: int = WORD_DOCS) -> list[str]:
    """The built-in words, then those of letters only that most documents have: a dictionary for `guess_cost`.

    Words stand between white space, perhaps with punctuation behind; parts of values do not count.
    """
    found = F.array_distinct(F.split(F.lower(F.col(f"`{text_col}`").cast("string")), r"[.,;:!?]*\s+"))
    words = docs.select(F.explode(found).alias("w")).where(F.length("w").between(2, 24)).groupBy("w").agg(F.count("*").alias("n"))
    words = words.where((F.col("n") >= least) & F.col("w").rlike(r"^\p{L}+$")).orderBy(F.desc("n"), "w").limit(most)
    return [*WORDS, *(r.w for r in words.select("w").collect())]  # `most` rows at most


def _hex_rows(col: pa.Array) -> np.ndarray:
    """Rows with a run of 24 or more hex digits, from the bytes."""
    data, ends = buffers(col)
    if not len(data):
        return np.zeros(len(col), bool)
    no = np.ones(256, bool)
    no[[*range(48, 58), *range(97, 103)]] = False
    stops = np.concatenate([[-1], np.flatnonzero(no[data]), [len(data)]])
    out = np.zeros(len(col), bool)
    for k in np.flatnonzero(np.diff(stops) > 24):  # a run over two rows only over-reports
        first, last = np.searchsorted(ends, [stops[k] + 1, stops[k + 1] - 1], "right") - 1
        out[first : last + 1] = True
    return out


def secret_spans(
    docs: DataFrame, min_cost: float = MIN_COST, words: Sequence[str] | None = None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), redact: str | None = None
) -> DataFrame:
    """Per row of `docs`: doc_id, spans (array of kind, start, end in code points, end exclusive), `keep` columns, and with `redact` the text whose spans are replaced by it.

    words: dictionary of `guess_cost`, most frequent first (default: the built-in list).  Null and
    empty texts have no spans; repeated rows give repeated rows; a null id stays null; no rows give
    none; columns other than `keep` are not read, whatever their names.  One narrow pass, no shuffle.
    """
    ranks = Dictionary(words) if words is not None else _RANKS
    kept = [f"k{k}" for k in range(len(keep))]
    base = id_text(docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), *(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True))), "i", "t", *kept)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = "doc_id long, spans array<struct<kind:string,start:int,end:int>>" + ", text string" * (redact is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = lru_cache(1 << 14)(lambda v: guess_cost(v, ranks, min_cost))
        for part in slices(batches, "text"):
            spans, texts = [], part.column(1).to_pylist()
            for text, has_hex in zip(texts, _hex_rows(part.column(1)), strict=True):
                found = base_spans(text, bool(has_hex))
                spans.append(sorted(found + guessed_spans(text, cost, min_cost, found)))
            cols = [part.column(0), pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in s] for s in spans], kind)]
            if redact is not None:
                cols.append(pa.array([redacted(t, s, redact) for t, s in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*cols, *part.columns[2:]], ["doc_id", "spans"] + ["text"] * (redact is not None) + kept)

    for c, k in zip(keep, kept, strict=True):
        schema += f", {k} {docs.schema[c].dataType.simpleString()}"
    out = base.mapInArrow(run, schema)
    return out.select(*out.columns[: len(out.columns) - len(kept)], *(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)))


def redacted(text: str, spans: Sequence[tuple[int, int, int]], mark: str) -> str:
    """The text with every maximal union of spans replaced by `mark`."""
    if not spans:
        return text
    out, at, stop = [], 0, -1
    for a, _, b in spans:
        if a > stop:
            out += [text[at:a], mark]
            stop = b
        stop = max(stop, b)
        at = stop
    return "".join([*out, text[at:]])


def digest(spans: DataFrame) -> DataFrame:
    """The digest columns of `secret_spans`: counts by kind, the pattern spans' sha256, all spans as text."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(
        "doc_id",
        *(count(k) for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "guess"), label), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
        count("guess"),
    )
