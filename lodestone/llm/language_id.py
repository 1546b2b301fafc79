"""Language ID by Bayesian evidence fusion over web pages.

Four kinds of evidence are fused: the text's likelihood under hashed byte-trigram models of each
language, the language that the markup declares, the address suffix, and host priors that are
smoothed hierarchically (host, registered domain, suffix, all).  The text models are counted over all
labelled documents; the likelihoods of declarations and suffixes and the priors are grouped
aggregations of the pages' own text posteriors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import id_text, slices, stored
from .textcore import _LOWER, buffers

BITS = 14
#: Distinct labels of labelled text at most: their models are gathered on the driver (16,384 numbers each).
MAX_LANGUAGES = 512
#: Trigrams overlap and repeat: the text's log likelihood counts as this share, of this many trigrams at most.
TEMPER, TEXT_GRAMS = 0.25, 400
#: Pseudo-counts with which each level of the host hierarchy leans on the level above it.
LEAN = 5.0
#: Hosts up to which their table is broadcast; beyond, a join salted by SALTS.
BROADCAST_HOSTS, SALTS = 50_000, 16

_HIDDEN = re.compile(r"<(script|style|noscript)\b|<!--", re.I)
_END = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "noscript")} | {"": re.compile("-->")}
_TAG = re.compile(r"<[^>]*>")
_HEAD = re.compile(r"<(html|meta)\b([^<>]*)", re.I)
_LANG = re.compile(r"\b(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.I)
_CONTENT = re.compile(r"\bcontent\s*=\s*[\"']?\s*([A-Za-z]{2,8})", re.I)
_HOST = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def page_text(html: str) -> str:
    """The visible text of a page, in one pass: scripts, styles and comments that end, then tags that end."""
    out, at, endless = [], 0, set()
    for m in _HIDDEN.finditer(html):
        kind = (m[1] or "").lower()
        if m.start() < at or kind in endless:
            continue
        end = _END[kind].search(html, m.end())
        if not end:
            endless.add(kind)
            continue
        out.append(html[at : m.start()])
        at = end.end()
    shown = " ".join([*out, html[at:]])
    last = shown.rfind(">") + 1  # no tag ends behind it
    return _TAG.sub(" ", shown[:last]) + shown[last:]


def declared_language(html: str) -> str:
    """Primary subtag of the markup's language, of the page or else of its meta tags; empty if none."""
    meta = ""
    for m in _HEAD.finditer(html):
        if m[1].lower() == "html":
            if found := _LANG.search(m[2]):
                return found[1].lower()
        elif not meta and "content-language" in m[2].lower() and (found := _CONTENT.search(m[2])):
            meta = found[1].lower()
    return meta


def host_levels(url: str) -> tuple[str, str, str]:
    """(host without www, last two labels, suffix: a two-letter last label, else empty)."""
    m = _HOST.match(url or "")
    host = m.group(1).lower().strip(".") if m else ""
    host = host.removeprefix("www.")
    labels = host.split(".")
    last = labels[-1]
    return host, ".".join(labels[-2:]), last if len(last) == 2 and last.isalpha() else ""


def _trigrams(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams (A-Z lower-cased) of all rows, and the rows' offsets."""
    data, ends = buffers(col)
    b = _LOWER[data].astype(np.uint32)
    many = np.maximum(np.diff(ends) - 2, 0)
    row = np.repeat(np.arange(len(many)), many)
    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + ends[row]
    code = b[place] << np.uint32(16) | b[place + 1] << np.uint32(8) | b[place + 2]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64), np.concatenate([[0], np.cumsum(many)])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of the 1 << BITS trigram hashes, from all labelled documents.

    Null and empty languages are left out; the result's size is that of the label set alone, and more than
    MAX_LANGUAGES labels are an error.
    """
    base = id_text(docs.select(F.lit(0).alias("i"), F.col(f"`{text_col}`").alias("t"), F.lower(F.col(f"`{lang_col}`").cast("string")).alias("lang")), "i", "t", "lang").where("lang <> ''")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            gram, at = _trigrams(part.column(1))
            langs = part.column(2).to_pylist()
            which = np.repeat(np.array([langs.index(x) for x in langs]), np.diff(at))
            for k in np.unique(which):
                n = np.bincount(gram[which == k], minlength=1 << BITS)
                total[langs[k]] = total[langs[k]] + n if langs[k] in total else n
        for lang, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some), pa.array(n[some])], ["lang", "gram", "n"])

    if base.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"labelled text has more than {MAX_LANGUAGES} languages")
    rows = base.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    coded = rows.column("lang").combine_chunks().dictionary_encode()
    found = coded.dictionary.to_pylist()
    langs = sorted(found)
    table = np.full((len(langs), 1 << BITS), 0.5)
    place = np.array([langs.index(x) for x in found], np.int64)
    table[place[coded.indices.to_numpy(zero_copy_only=False)], rows.column("gram").to_numpy()] += rows.column("n").to_numpy()
    return langs, np.log(table / table.sum(axis=1, keepdims=True))


def _evidence(pages: DataFrame, langs: list[str], log_p: np.ndarray, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, host, domain, suffix, declared, ll): ll is the tempered text log likelihood by language."""
    shared = pages.sparkSession.sparkContext.broadcast(log_p.astype(np.float32).T.copy())
    base = id_text(pages.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{html_col}`").alias("t"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url")), "i", "t", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, "text"):
            html = part.column(1).to_pylist()
            gram, at = _trigrams(pa.array(map(page_text, html), pa.string()))
            n = np.diff(at)
            total = np.concatenate([np.zeros((1, len(langs))), np.cumsum(model[gram], axis=0, dtype=np.float64)])
            scale = TEMPER * np.minimum(n, TEXT_GRAMS) / np.maximum(n, 1)
            ll = (total[at[1:]] - total[at[:-1]]) * scale[:, None]
            declared = [x if (x := declared_language(h)) in langs else "other" if x else "" for h in html]
            hosts = [host_levels(u) for u in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array([h[k] for h in hosts], pa.string()) for k in range(3)), pa.array(declared, pa.string()), pa.array(ll.tolist(), pa.list_(pa.float64()))],
                ["page_id", "host", "domain", "suffix", "declared", "ll"],
            )

    return base.mapInArrow(run, "page_id long, host string, domain string, suffix string, declared string, ll array<double>")


def _normal(scores):
    """Probabilities from log scores (an array column)."""
    top = F.array_max(scores)
    weights = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, documents: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: page_id, lang, posterior, text_lang, declared, host.

    documents: (text, lang) of labelled text.  A page without text, declaration and host has the overall
    prior's language; null html and url are empty; null ids are answered like others; repeated rows each
    count; no pages give no rows; without any labelled text lang and posterior are null.  Ties go to
    the first language by name.  Other columns are not read.
    """
    langs, log_p = train(documents)
    if not langs:
        return pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"), F.lit("").alias("host"))
    size = len(langs)
    own = stored(_evidence(pages, langs, log_p, id_col, url_col, html_col).withColumn("text_p", _normal(F.col("ll"))), "pages")
    sums = [F.sum(F.element_at("text_p", k + 1)).alias(f"s{k}") for k in range(size)]
    hosts = stored(own.groupBy("host", "domain", "suffix").agg(*sums), "hosts")
    merged = [F.sum(f"s{k}").alias(f"s{k}") for k in range(size)]
    vector = lambda p: F.array(*(F.col(f"{p}{k}") for k in range(size)))
    domains = hosts.groupBy("domain", "suffix").agg(*merged)
    suffixes = stored(domains.groupBy("suffix").agg(*merged), "suffixes")  # 677 rows at most
    everything = suffixes.agg(*merged).first()
    total = [float(x or 0) for x in everything]
    prior = [(x + 1) / (sum(total) + size) for x in total]
    lean = lambda counts, above: F.transform(F.zip_with(counts, above, lambda c, p: c + LEAN * p), lambda x: x / (F.aggregate(counts, F.lit(0.0), lambda a, b: a + b) + LEAN))
    suffix_prior = suffixes.select("suffix", lean(vector("s"), F.array(*map(F.lit, prior))).alias("suffix_prior"))
    domain_prior = domains.join(F.broadcast(suffix_prior), "suffix").select("domain", "suffix", lean(vector("s"), F.col("suffix_prior")).alias("domain_prior"))
    host_table = stored(hosts.select("host", "domain", "suffix", vector("s").alias("host_counts")).join(domain_prior, ["domain", "suffix"]).select("host", "domain_prior", "host_counts"), "host_table")
    # likelihoods of a declaration and of a suffix given the language, over the pages' text posteriors
    said = {r[0]: list(r[1:]) for r in own.groupBy("declared").agg(*sums).collect()}  # languages + 2 rows
    ended = {r["suffix"]: [float(r[f"s{k}"]) for k in range(size)] for r in suffixes.collect()}

    def log_likelihood(seen: dict[str, list[float]]):
        seen = seen or {"": [0.0] * size}  # an empty map has no type
        out = [F.lit(x) for name, counts in seen.items() for x in (name, F.array(*(F.lit(float(np.log((c + 0.5) / (t + 0.5 * (len(seen) + 1))))) for c, t in zip(counts, total, strict=True))))]
        return F.create_map(*out)

    if host_table.count() <= BROADCAST_HOSTS:
        placed = own.join(F.broadcast(host_table), "host", "left")
    else:  # one host may have a third of all pages
        salted = host_table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = own.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    # a page's own text is no evidence twice: its posterior leaves its host's counts
    others = F.zip_with("host_counts", "text_p", lambda c, p: F.greatest(c - p, F.lit(0.0)))
    fused = F.zip_with("ll", F.transform(lean(others, F.col("domain_prior")), lambda p: F.log(p)), lambda a, b: a + b)
    for column, seen in (("declared", said), ("suffix", ended)):
        fused = F.zip_with(fused, F.element_at(log_likelihood(seen), F.col(column)), lambda a, b: a + b)
    names = F.array(*map(F.lit, langs))
    best = lambda p: F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    out = placed.withColumn("p", _normal(fused))
    return out.select("page_id", best(F.col("p")).alias("lang"), F.array_max("p").alias("posterior"), best(F.col("text_p")).alias("text_lang"), "declared", "host")
