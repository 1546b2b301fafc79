"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Pattern spans (`email`, `ip`, `card`, `phone`, each with its check) always stand.  Candidates are the
pattern matches, those that fail their check, and looser shapes: written-out addresses, local
telephone numbers, names, identity numbers.  Each labeler (a pattern with a check, a looser shape, a
gazetteer, words before the span, words that speak against it, what touches it) votes yes, no or not
at all.  The votes of all candidates of all documents are counted by type; expectation-maximisation
over these counts estimates how often each labeler votes what on true and on false candidates, and
so each vote's posterior.  A logistic classifier of the span's own features is then trained on these
posteriors, again from counts of all candidates, and adds the candidates that it gives `least` or more.

Texts are read once; what leaves that pass is a table of spans.  Vote counts (3**6 a type) and
feature counts (2**12 a type) are all that reaches the driver, at every size of the corpus.

Null and empty texts have no spans.  Null ids and repeated rows are answered row by row.  Spans that
tie in start and kind are one span; an added span that a pattern span of any kind overlaps is left
out.  An empty table gives no rows and trains nothing.  Other columns are not read, but for `keep`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import id_text, slices, stored

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "name", "id")
NO_VOTE, NO, YES = 0, 1, 2
#: What checks are believed to vote (nothing, no, yes) on false and on true candidates before any data; it weighs as much as the data.
CHECK_PRIOR = np.array([[0.45, 0.5, 0.05], [0.3, 0.01, 0.69]])
LABELERS = ("check", "shape", "gazetteer", "cue", "counter", "touch")
#: Number of feature bits, characters of context that are looked at, and the probability that adds a span.
BITS, NEAR, LEAST = 12, 48, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A lookbehind after the first character lets the search skip to it.
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\x20?[\[({]?\x20?(?:at|AT|@)\x20?[\])}]?\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[({]?\x20?(?:dot|DOT|\.)\x20?[\])}]?\x20?[A-Za-z0-9-]{2,63}){1,4}(?![A-Za-z0-9])")
_NUMBER = re.compile(r"[0-9(](?<![0-9+(].)[0-9]{1,5}+\)?(?:[\x20./-]\(?[0-9]{2,5}\)?){1,5}(?![0-9])")
_ID = re.compile(r"[A-Z0-9](?<![A-Za-z0-9-].)(?:(?<=[0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}|(?<=[A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9-])")
_NAME = re.compile(r"[^\W\d_a-z](?<!\w\w)[^\W\d_]{1,20}(?:\x20[^\W\d_a-z][^\W\d_]{1,20}){1,3}(?!\w)")
_WORDS = re.compile(r"[^\W\d_]+")

#: Frequent given names, mail hosts' endings, dialling codes of countries, issuers' first digits.
GIVEN = frozenset(
    "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen anna peter paul maria "
    "hans klaus jürgen wolfgang uwe günter monika ursula petra sabine renate jean pierre marie jacques françois nathalie isabelle sophie camille juan josé carlos luis "
    "antonio manuel carmen ana laura lucía pablo javier ivan olga natalia mohammed ahmed fatima wei li ming yuki kenji priya raj".split()
)
ENDINGS = frozenset("com org net edu gov io de fr es uk it nl eu info".split())
DIALLED = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "90", "91")
#: Words before a span that speak for a type, and those that speak against any.
CUES = {
    "email": frozenset("email mail e-mail write contact reply courriel correo".split()),
    "ip": frozenset("ip host address client server from login adresse dirección".split()),
    "card": frozenset("card visa mastercard amex credit debit payment paid karte carte tarjeta".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax whatsapp dial telefon téléphone teléfono ruf".split()),
    "name": frozenset("mr mrs ms dr prof name named called contact dear signed herr frau monsieur madame señor señora".split()),
    "id": frozenset("ssn iban social passport identity account tax licence license konto cuenta compte".split()),
}
AGAINST = frozenset("order invoice version isbn issn section chapter page figure table item model serial ref ticket build release lot sku row line".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def pattern_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, passes) of the leftmost non-overlapping matches of each base pattern, by kind, then start."""
    out, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end(), True))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    if "." in text:
        out += [(1, m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))) for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m[0])
            if len(d) >= 13:
                out.append((2, m.start(), m.end(), len(d) <= 19 and luhn(d)))
    if "+" in text:
        out += [(3, m.start(), m.end(), 9 <= len(_digits(m[0])) <= 15) for m in _PHONE.finditer(text)]
    return out


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _kind_check(kind: int, span: str, passes: bool | None) -> int:
    """The labeler of patterns with a check."""
    if passes is not None:
        return YES if passes else NO
    if kind == 5:
        if "-" in span:
            return NO if span[:3] in ("000", "666") or span[0] == "9" or span[4:6] == "00" or span[7:] == "0000" else NO_VOTE
        return YES if _iban(span) else NO
    return NO_VOTE


def _shape(kind: int, span: str) -> int:
    """The labeler of usual shapes."""
    if kind == 0:
        return YES if re.search(r"[\w.]@(?:[\w-]+\.)+[A-Za-z]{2,}$|\b(?:at|AT)\b.*\b(?:dot|DOT)\b", span) else NO
    if kind == 1:
        return NO if any(len(p) > 1 and p[0] == "0" for p in span.split(".")) else YES
    if kind == 2:
        groups = [len(g) for g in re.split(r"[\x20-]", span)]
        return YES if groups in ([4, 4, 4, 4], [4, 6, 5]) else NO_VOTE if len(groups) == 1 else NO
    if kind == 3:
        n = len(_digits(span))
        usual = re.fullmatch(r"(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}(?:[\x20.-][0-9]{2,4}){0,3}", span)
        return NO if not 7 <= n <= 15 else YES if usual else NO_VOTE
    return NO_VOTE


def _gazetteer(kind: int, span: str) -> int:
    if kind == 0:
        return YES if span.rsplit(".", 1)[-1].rsplit(" ", 1)[-1].lower() in ENDINGS else NO_VOTE
    if kind == 1:
        return NO if span.startswith(("0.", "127.", "255.", "1.2.3.")) else NO_VOTE
    if kind == 2:
        return YES if span[0] in "3456" else NO
    if kind == 3:
        return (YES if span[1:].lstrip("( ").startswith(DIALLED) else NO_VOTE) if span[0] == "+" else NO_VOTE
    if kind == 4:
        return YES if any(w.lower() in GIVEN for w in span.split(" ")[:-1]) else NO
    return NO_VOTE


def _vote(text: str, kind: int, start: int, end: int, passes: bool | None, dense: bool) -> tuple[int, int]:
    """The labelers' votes and the features of a candidate, as numbers in base 3 and 2."""
    span = text[start:end]
    before, after = text[max(0, start - NEAR) : start], text[end : end + 2]
    words = [w.lower() for w in _WORDS.findall(before)][-4:]
    cue, counter = any(w in CUES[KINDS[kind]] for w in words), any(w in AGAINST for w in words)
    left, right = before[-1:], after[:1]
    glued = left.isalnum() or right.isalnum() or left in ("_", "#", "$") and bool(left) or right in ("_", "%") and bool(right)
    number_like = left in (".", ",", "-", "/") and bool(left) and before[-2:-1].isdigit() or right in (".", ",", "-", "/") and bool(right) and after[1:2].isdigit()
    votes = (
        _kind_check(kind, span, passes),
        _shape(kind, span),
        _gazetteer(kind, span),
        YES if cue else NO_VOTE,
        NO if counter else NO_VOTE,
        NO if glued or number_like else YES if dense else NO_VOTE,
    )
    code = 0
    for v in votes:
        code = 3 * code + v
    n = sum(c.isdigit() for c in span)
    features = (
        cue, counter, glued, number_like, dense, any(c in "()[]{}" for c in span), any(c in " -./" for c in span), n >= 10, n >= 13, before.endswith((": ", ":", "= ", "=", "<", "(")) or not before.strip(), _gazetteer(kind, span) == YES, _shape(kind, span) == YES,
    )
    return code, sum(int(bool(f)) << k for k, f in enumerate(features))


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, bool, int, int]]]:
    """The pattern spans (kind, start, end), and all candidates (kind, start, end, is a pattern span, votes, features)."""
    matches = pattern_matches(text)
    base = [m[:3] for m in matches if m[3]]
    found = {(k, a): (k, a, b, p) for k, a, b, p in matches}

    def more(kind: int, m: re.Match) -> None:
        found.setdefault((kind, m.start()), (kind, m.start(), m.end(), None))

    if "@" in text or " at " in text or "(at)" in text or "[at]" in text or " AT " in text:
        for m in _SPELLED.finditer(text):
            if re.search(r"(?:\b|[\])}])(?:dot|DOT)\b|[\[({]", m[0]):  # else it is prose or a plain address
                more(0, m)
    for m in _NUMBER.finditer(text):
        if 7 <= len(_digits(m[0])) <= 12:
            more(3, m)
    for m in _ID.finditer(text):
        more(5, m)
    for m in _NAME.finditer(text):
        words = m[0].lower().split(" ")
        ahead = _WORDS.findall(text[max(0, m.start() - 12) : m.start()])
        if any(w in GIVEN for w in words[:-1]) or words[0] in CUES["name"] or ahead and ahead[-1].lower() in CUES["name"]:
            more(4, m)
    spans = sorted(found.values(), key=lambda c: (c[1], c[0]))
    out = []
    for i, (k, a, b, p) in enumerate(spans):
        dense = any(o[0] != k and (o[1] >= b or o[2] <= a) and o[1] - b < 80 and a - o[2] < 80 for o in spans[max(0, i - 2) : i + 3])
        out.append((k, a, b, bool(p), *_vote(text, k, a, b, p, dense)))
    return base, out


class Votes:
    """Two-class model of one type's votes, conditionally independent given the class."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, rounds: int = 100):
        m = len(LABELERS)
        votes = np.stack([codes // 3 ** (m - 1 - k) % 3 for k in range(m)], 1)
        # to begin with a yes speaks for the span as much as a no against it
        lean = (votes == YES).sum(1) - (votes == NO).sum(1) + ((votes[:, 0] == YES) * 1.0 - (votes[:, 0] == NO))
        post = 1 / (1 + np.exp(-1.5 * lean + 0.75))
        for _ in range(rounds):
            w = np.stack([counts * (1 - post), counts * post])  # class by pattern
            prior = np.log((w.sum(1) + 1) / (w.sum() + 2))
            seen = np.array([[[w[c][votes[:, k] == v].sum() for v in range(3)] for k in range(m)] for c in range(2)]) + 1
            seen[:, 0] += w.sum(1)[:, None] * CHECK_PRIOR
            self.share = seen / seen.sum(2, keepdims=True)
            like = np.stack([prior[c] + sum(np.log(self.share[c, k, votes[:, k]]) for k in range(m)) for c in range(2)])
            new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
            done = np.abs(new - post).max(initial=0) < 1e-9
            post = new
            if done:
                break
        self.posterior = dict(zip(codes.tolist(), post.tolist(), strict=True))


def fit_logistic(bits: np.ndarray, yes: np.ndarray, no: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps over counted feature patterns with soft labels."""
    x = np.column_stack([*((bits >> k) & 1 for k in range(BITS)), np.ones(len(bits))]).astype(float)
    w, penalty = np.zeros(BITS + 1), ridge * np.diag([1.0] * BITS + [0.01])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        n = yes + no
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + penalty, x.T @ (yes - n * p) - penalty @ w)
        w += step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _spans_table(docs: DataFrame, id_col: str, text_col: str, keep: Sequence[str]) -> DataFrame:
    """One row a document: doc_id, base (kind, start, end), found (candidates), and the kept columns as k0, k1, ..."""
    kept = [f"k{k}" for k in range(len(keep))]
    rows = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), *(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)))
    base_type = pa.list_(pa.struct([("kind", pa.int8()), ("start", pa.int32()), ("end", pa.int32())]))
    found_type = pa.list_(pa.struct([("kind", pa.int8()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.int16()), ("features", pa.int16())]))
    schema = "doc_id long, base array<struct<kind:tinyint,start:int,end:int>>, found array<struct<kind:tinyint,start:int,end:int,base:boolean,votes:smallint,features:smallint>>"
    for c, k in zip(keep, kept, strict=True):
        schema += f", {k} {docs.schema[c].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "base", "votes", "features")
        for part in slices(batches, "text"):
            got = [candidates(t) for t in part.column(1).to_pylist()]
            base = pa.array([[dict(zip(names, s, strict=False)) for s in b] for b, _ in got], base_type)
            found = pa.array([[dict(zip(names, s, strict=True)) for s in f] for _, f in got], found_type)
            yield pa.RecordBatch.from_arrays([part.column(0), base, found, *part.columns[2:]], ["doc_id", "base", "found", *kept])

    return id_text(rows, "i", "t", *kept).mapInArrow(run, schema)


def train(found: DataFrame) -> tuple[dict[int, Votes], dict[int, np.ndarray]]:
    """By type the model of its votes and the classifier's probability for each pattern of features, from counts over all candidates."""
    each = found.select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.features")
    counted = each.groupBy("kind", "votes", "features").agg(F.count("*").alias("n"))
    counted = stored(counted, "votes")
    models: dict[int, Votes] = {}
    rows = counted.groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect()  # 3**6 a type at most
    for kind in {r.kind for r in rows}:
        own = [r for r in rows if r.kind == kind]
        models[kind] = Votes(np.array([r.votes for r in own], np.int64), np.array([r.n for r in own], float))
    likely = [(k, v, p) for k, m in models.items() for v, p in m.posterior.items()]
    soft = counted.join(F.broadcast(found.sparkSession.createDataFrame(likely, "kind tinyint, votes smallint, p double")), ["kind", "votes"])
    sums = soft.groupBy("kind", "features").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no")).orderBy("kind", "features").collect()  # 2**12 a type at most
    chance: dict[int, np.ndarray] = {}
    for kind in models:
        own = [r for r in sums if r.kind == kind]
        w = fit_logistic(np.array([r.features for r in own], np.int64), np.array([r.yes for r in own]), np.array([r.no for r in own]))
        every = np.arange(1 << BITS)
        x = np.column_stack([*((every >> k) & 1 for k in range(BITS)), np.ones(len(every))])
        chance[kind] = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return models, chance


def added_spans(base: Sequence[tuple[int, int, int]], found: Sequence[tuple[int, int, int, bool, int, int]], chance: dict[int, np.ndarray], least: float) -> list[tuple[int, int, int]]:
    """The candidates that the classifier accepts and no pattern span overlaps; of overlapping ones of a type the first stays.

    A candidate whose check says no stays out whatever its context is.
    """
    held, last, out = sorted((a, b) for _, a, b in base), {}, []
    top = 3 ** (len(LABELERS) - 1)
    starts = [a for a, _ in held]
    reach = np.maximum.accumulate([b for _, b in held]).tolist()
    for k, a, b, is_base, votes, bits in found:
        if is_base or votes // top == NO or chance[k][bits] < least or a < last.get(k, 0):
            continue
        i = int(np.searchsorted(starts, b))  # pattern spans that start before this one ends
        if i and reach[i - 1] > a:
            continue
        last[k] = b
        out.append((k, a, b))
    return out


def personal_spans(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Per row of `docs`: doc_id, base and spans (arrays of kind, start, end in code points, end exclusive; by kind, then start) and the `keep` columns."""
    found = stored(_spans_table(docs, id_col, text_col, keep), "found")
    _, chance = train(found)
    kept = [f"k{k}" for k in range(len(keep))]
    one = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            base, spans = [], []
            for b, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                b = [tuple(s.values()) for s in b]
                base.append(told(b))
                spans.append(told(sorted({*b, *added_spans(b, [tuple(s.values()) for s in f], chance, least)})))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, one), pa.array(spans, one), *batch.columns[3:]], ["doc_id", "base", "spans", *kept])

    kind = "array<struct<kind:string,start:int,end:int>>"
    schema = f"doc_id long, base {kind}, spans {kind}" + "".join(f", {k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(keep, kept, strict=True))
    out = found.mapInArrow(run, schema)
    return out.select("doc_id", "base", "spans", *(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)))


def digest(spans: DataFrame) -> DataFrame:
    """The digest columns of `personal_spans`: pattern spans by kind, their sha256, all spans as text, added spans."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(F.array_join(F.transform("base", label), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )
