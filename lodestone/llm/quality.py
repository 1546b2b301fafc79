"""Quality classifier: interpolated modified Kneser-Ney n-gram perplexity with language quantiles.

Counts of character n-grams (order 4) are gathered over all trusted documents of each language; the
lower orders are continuation counts.  Discounts, back-off weights and probabilities come from joins
of the count tables on context and suffix keys.  Each document then has a perplexity under its own
language's model and is kept up to a threshold that its language's trusted quantiles set.  Repetition
is easy to predict: a document with too few distinct n-grams for its language goes as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import id_text, slices, stored
from .textcore import buffers

ORDER, BITS = 4, 13
#: Languages with trusted text at most: what a 63-bit key leaves beside ORDER characters, and no number for none.
MAX_LANGUAGES = (1 << 63 - ORDER * BITS) - 1
#: Rows of the model up to which workers get it whole (16 bytes each); beyond, sharded joins bring each shard its own part.
WHOLE_MODEL_ROWS = 4_000_000
#: Trusted ids up to which they are broadcast (8 bytes each); a shuffle join beyond.
BROADCAST_IDS = 2_000_000
#: Bytes of text of a shard in the sharded way.
SHARD_BYTES = 16 << 20
#: Threshold: median + SPREAD * (upper quantile - median) of the trusted log perplexities, and as much below for variety.
UPPER, SPREAD, VARIETY_SPREAD = 0.95, 4.0, 4.0
#: Characters of median perplexity that are added to each document, so that short ones don't swing.
PRIOR_CHARS = 64
#: Characters of a window whose distinct n-grams are counted: few of them mean repetition, which perplexity cannot see.
WINDOW = 256


def _grams(col: pa.Array, langs: list[str | None], numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each character, its n-gram key (number of the language, then ORDER characters) and the rows' offsets.

    Characters have 13 bits: code points up to U+0FFF are classes of their own, those beyond (ideographs,
    Hangul, emoji) fold onto 4,096 further classes, some to a class.  White space is one class, digits
    another; each row begins after ORDER - 1 blanks.  Languages without trusted text have the number 0.
    """
    data, ends = buffers(col)
    head = (data & 0xC0) != 0x80
    points = np.frombuffer(bytes(data).decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(head)])[ends]
    points[(points >= 48) & (points <= 57)] = 48
    points[(points >= 9) & (points <= 13)] = 32
    half = 1 << BITS - 1
    points = np.where(points >= half, half + points % half, points)
    n, rows = len(points), np.diff(at)
    tag = np.repeat(np.array([numbers.get(x or "", 0) for x in langs], np.int64), rows)
    since = np.arange(n) - np.repeat(at[:-1], rows)
    key = tag
    for back in range(ORDER - 1, -1, -1):
        shifted = np.concatenate([np.full(back, 32, np.int64), points[: n - back]]) if n else points
        key = key << BITS | np.where(since >= back, shifted[:n], 32)
    return key, at


def _count_grams(numbers: dict[str, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            key, back = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(back, np.concatenate(counts)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(total)], ["gram", "n"])

        for part in slices(batches, "text"):
            key, _ = _grams(part.column(1), part.column(2).to_pylist(), numbers)
            key, n = np.unique(key, return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > 4_000_000:
                yield flush()
                keys, counts, held = [], [], 0
        if keys:
            yield flush()

    return run


def _suffix(order: int):
    """The key of the last `order` characters; the language stays in front."""
    lang = F.shiftright("gram", BITS * (order + 1))
    return F.shiftleft(lang, BITS * order).bitwiseOR(F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1)))


def train(counts: DataFrame) -> dict[str, DataFrame]:
    """From counts (gram, n) of ORDER characters: tables p1..pN (gram, p) and g1..g(N-1) (gram, weight).

    p holds interpolated probabilities of the seen grams, g the back-off weight of each seen context.
    """
    levels = {ORDER: stored(counts, "grams")}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: kinds of characters in front
        levels[order] = stored(levels[order + 1].groupBy(_suffix(order).alias("gram")).agg(F.count("*").alias("n")), f"grams{order}")
    tables: dict[str, DataFrame] = {}
    for order in range(1, ORDER + 1):
        own = levels[order].withColumn("lang", F.shiftright("gram", BITS * order)).withColumn("context", F.shiftright("gram", BITS))
        ones = own.groupBy("lang").agg(*(F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)))
        y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
        ratio = lambda k: F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1.0))
        # within (0, k), also where counts of counts are degenerate
        discounts = ones.select("lang", *(F.greatest(F.lit(0.1 * k), F.least(F.lit(k - 0.1), k - (k + 1) * y * ratio(k))).alias(f"d{k}") for k in (1, 2, 3)))
        took = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        own = own.join(F.broadcast(discounts), "lang").withColumn("took", took)  # MAX_LANGUAGES rows at most
        context = own.groupBy("context").agg(F.sum("n").alias("total"), F.sum("took").alias("freed"))
        tables[f"g{order - 1}"] = context.select(F.col("context").alias("gram"), (F.col("freed") / F.col("total")).alias("weight"))
        own = own.join(context, "context").withColumn("top", (F.col("n") - F.col("took")) / F.col("total"))
        weight = F.col("freed") / F.col("total")
        if order == 1:  # below the single characters: uniform over the code space
            tables["p1"] = stored(own.select("gram", (F.col("top") + weight / (1 << BITS)).alias("p")), "p1")
        else:
            lower = tables[f"p{order - 1}"].select(F.col("gram").alias("suffix"), F.col("p").alias("under"))
            own = own.withColumn("suffix", _suffix(order - 1))
            tables[f"p{order}"] = stored(own.join(lower, "suffix").select("gram", (F.col("top") + weight * F.col("under")).alias("p")), f"p{order}")
    for k in range(ORDER):
        tables[f"g{k}"] = stored(tables[f"g{k}"], f"g{k}")
    return tables


class _Lookup:
    """Values by 64-bit key: open addressing in numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits, np.float64)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            who = left[free][first]
            self.keys[slot], self.values[slot] = keys[who], values[who]
            waits = self.keys[at] != keys[left]
            left, at = left[waits], (at[waits] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)."""
        at = self._home(keys)
        seen = self.keys[at]
        found, value = seen == keys, self.values[at]
        left = np.flatnonzero(~found & (seen >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at]
            hit = seen == keys[left]
            found[left[hit]], value[left[hit]] = True, self.values[at[hit]]
            go = ~hit & (seen >= 0)
            left, at = left[go], at[go]
        return value, found


class Model:
    """Log probabilities by n-gram key, from the tables of `train` as arrays."""

    def __init__(self, arrays: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.tables = {k: _Lookup(*v) for k, v in arrays.items()}

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """Backs off from the longest seen gram with the weights of the seen contexts above it."""
        out, scale = np.empty(len(keys)), np.zeros(len(keys))
        left, own = np.arange(len(keys)), keys
        for order in range(ORDER, 0, -1):
            p, found = self.tables[f"p{order}"].get(own)
            out[left[found]] = np.log(p[found]) + scale[left[found]]
            left, own = left[~found], own[~found]
            weight, seen = self.tables[f"g{order - 1}"].get(own >> BITS)
            scale[left[seen]] += np.log(weight[seen])
            size = order - 1
            own = (own >> BITS * order) << BITS * size | own & ((1 << BITS * size) - 1)
        out[left] = scale[left] - BITS * np.log(2)
        return out


def _losses(log_p: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(log_p)])
    return total[at[:-1]] - total[at[1:]]


def _kinds(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row: the distinct n-grams of its windows, summed."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    window = np.cumsum((np.arange(len(key)) - at[row]) % WINDOW == 0)
    by = np.lexsort((key, window))
    new = np.ones(len(by), bool)
    new[1:] = (key[by][1:] != key[by][:-1]) | (window[by][1:] != window[by][:-1])
    return np.bincount(row[by[new]], minlength=len(at) - 1)


def _score_whole(docs: DataFrame, tables: dict[str, DataFrame], numbers: dict[str, int]) -> DataFrame:
    arrays = {}
    for name, t in tables.items():
        got = t.toArrow()
        arrays[name] = (got.column(0).to_numpy(), got.column(1).to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(arrays)
    made: dict[int, Model] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = made.setdefault(0, None) or made.update({0: Model(shared.value)}) or made[0]
        for part in slices(batches, "text"):
            key, at = _grams(part.column(1), part.column(2).to_pylist(), numbers)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(at)), pa.array(_losses(model.log_p(key), at)), pa.array(_kinds(key, at), pa.int64())], ["doc_id", "lang", "n", "loss", "kinds"])

    return docs.mapInArrow(run, "doc_id long, lang string, n long, loss double, kinds long")


def _score_sharded(docs: DataFrame, tables: dict[str, DataFrame], numbers: dict[str, int]) -> DataFrame:
    """Documents and the log probabilities of their distinct grams meet in shards of bounded size."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, int(size // SHARD_BYTES))
    # without a key of its own, an id that many rows share would make a large shard
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            key, at = _grams(part.column(1), part.column(2).to_pylist(), numbers)
            kinds, which = np.unique(key, return_inverse=True)
            pairs = np.unique(np.repeat(part.column(3).to_numpy(zero_copy_only=False).astype(np.int64), np.diff(at)) * max(1, len(kinds)) + which)
            yield pa.RecordBatch.from_arrays([pa.array((pairs // max(1, len(kinds))).astype(np.int32)), pa.array(kinds[pairs % max(1, len(kinds))])], ["shard", "gram"])

    asked = stored(dealt.mapInArrow(wanted, "shard int, gram long").distinct(), "asked")
    grams = asked.select("gram").distinct()
    own, scale, found = grams.withColumn("key", F.col("gram")), F.lit(0.0), F.lit(None).cast("double")
    for order in range(ORDER, 0, -1):
        own = own.join(tables[f"p{order}"].select(F.col("gram").alias("key"), F.log("p").alias(f"lp{order}")), "key", "left")
        own = own.withColumn("above", F.shiftright("key", BITS))
        own = own.join(tables[f"g{order - 1}"].select(F.col("gram").alias("above"), F.log("weight").alias(f"lw{order}")), "above", "left")
        rest = F.shiftleft(F.shiftright("key", BITS * order), BITS * (order - 1)).bitwiseOR(F.col("key").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1)))
        found = F.coalesce(found, F.col(f"lp{order}") + scale)
        scale = scale + F.coalesce(F.col(f"lw{order}"), F.lit(0.0))
        own = own.withColumn("key", rest)
    known = own.select("gram", F.coalesce(found, scale - float(BITS * np.log(2))).alias("lp"))
    brought = asked.join(known, "gram").select("shard", "gram", "lp")

    def run(left, right):
        order = np.argsort(right["gram"].to_numpy(), kind="stable")
        grams, lp = right["gram"].to_numpy()[order], right["lp"].to_numpy()[order]
        out = []
        for a in range(0, len(left), 512):
            rows = left.iloc[a : a + 512]
            key, at = _grams(pa.array(rows["text"], pa.string()), [x if isinstance(x, str) else None for x in rows["lang"]], numbers)
            loss = _losses(lp[np.searchsorted(grams, key)] if len(key) else np.zeros(0), at)
            out.append(rows[["doc_id", "lang"]].assign(n=np.diff(at), loss=loss, kinds=_kinds(key, at)))
        import pandas as pd

        return pd.concat(out) if out else left[["doc_id", "lang"]].assign(n=0, loss=0.0, kinds=0)

    return dealt.groupBy("shard").cogroup(brought.groupBy("shard")).applyInPandas(run, "doc_id long, lang string, n long, loss double, kinds long")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id").where("doc_id is not null").distinct()


def classify(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    whole_model_rows: int = WHOLE_MODEL_ROWS,
    upper: float = UPPER,
    spread: float = SPREAD,
) -> DataFrame:
    """One row per row of `docs`: doc_id, lang, n_chars, perplexity, settled, threshold, keep.

    trusted: one column of ids.  perplexity is the text's own; settled is that of the text with
    PRIOR_CHARS characters of its language's median perplexity added, which threshold holds for.
    Null and empty texts have no perplexity and are not kept; a language without trusted text has no
    threshold, and its documents are kept; a null language is the empty one; repeated rows count and are
    scored each; null ids are scored like others and never trusted; no rows give none; extra columns are
    ignored whatever their names.  More than MAX_LANGUAGES languages with trusted text are an error.
    """
    base = id_text(docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("lang")), "i", "t", "lang")
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    good = base.join(ids, "doc_id", "left_semi")
    named = [r[0] for r in good.select(F.coalesce("lang", F.lit(""))).distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(named) > MAX_LANGUAGES:
        raise ValueError(f"trusted text has more than {MAX_LANGUAGES} languages")
    numbers = {x: k + 1 for k, x in enumerate(sorted(named))}
    tables = train(good.mapInArrow(_count_grams(numbers), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    rows = sum(t.count() for t in tables.values())
    scores = stored((_score_whole if rows <= whole_model_rows else _score_sharded)(base, tables, numbers), "scores")
    language = F.coalesce("lang", F.lit(""))
    mean = F.col("loss") / F.col("n")
    seen = scores.where("n > 0").join(ids, "doc_id", "left_semi").groupBy(language.alias("of")).agg(F.percentile_approx(mean, 0.5, 100_000).alias("mid"))
    scores = scores.withColumn("of", language).join(F.broadcast(seen), "of", "left")  # a row for each language
    settled = (F.col("loss") + PRIOR_CHARS * F.coalesce("mid", mean)) / (F.col("n") + PRIOR_CHARS)
    scores = scores.withColumn("score", F.when(F.col("n") > 0, settled))
    scores = scores.withColumn("variety", F.when(F.col("n") > 0, F.col("kinds") / F.col("n")))
    quantiles = [F.percentile_approx("score", upper, 100_000).alias("high"), F.percentile_approx("variety", 0.5, 100_000).alias("v_mid"), F.percentile_approx("variety", 1 - upper, 100_000).alias("v_low")]
    high = scores.where("n > 0").join(ids, "doc_id", "left_semi").groupBy("of").agg(*quantiles)
    scores = scores.join(F.broadcast(high), "of", "left")
    limit = F.col("mid") + spread * F.greatest(F.col("high") - F.col("mid"), F.lit(0.01))
    least = F.col("v_mid") - VARIETY_SPREAD * F.greatest(F.col("v_mid") - F.col("v_low"), F.lit(0.01))
    kept = (F.col("score") <= limit) & (F.col("variety") >= least)
    return scores.select(
        "doc_id",
        "lang",
        F.col("n").alias("n_chars"),
        F.when(F.col("n") > 0, F.exp(mean)).alias("perplexity"),
        F.exp("score").alias("settled"),
        F.exp(limit).alias("threshold"),
        F.coalesce((F.col("n") > 0) & F.coalesce(kept, F.lit(True)), F.lit(False)).alias("keep"),
    )
