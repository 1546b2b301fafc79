"""Suffix-array dedup over run-length indexes: marks every byte under a string that also starts earlier.

A string of `length` bytes is routed by the least hash of its 32-byte grams, which equal strings share.
Consecutive strings with the same least hash form a phrase.  Equal phrases are one entry of a
dictionary, whose later occurrences are wholly repeated: most repeats of a corpus are settled there, by
hash.  Where different phrases share a key, their bytes meet in a shard, and the shard is indexed: a
Burrows-Wheeler transform in the order of `length`-byte contexts (ties by place), compressed to runs, with
the match length to the row above sampled where a run begins.  Inside a run a match grows by one byte to
the left, so the samples, streamed right to left, give the matching statistics of all other positions;
matches of `length` have an earlier start and are marked.  A key whose phrases outgrow a shard is split:
its strings are routed one by one by their own hashes, and only the first of each stays.  On the way to the
dictionary a task deals the phrases of a key by their own bytes where it holds many of them, and leaves a
mark at the key, so that no task receives all phrases under one gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import id_text, slices, stored
from .textcore import _LUT, _power, buffers, mix64

LENGTH, GRAM = 100, 32
#: Strings of a phrase at most, so that texts of one letter make many phrases.
MOST_STRINGS = 1024
#: Phrases that a task holds before it passes them on.
HELD = 3_000_000
#: Bytes of phrases in a shard, about.
SHARD_BYTES = 1 << 20
#: Bytes of the phrases under one key from which its strings are routed one by one.
HOT_BYTES = 1 << 20
#: Different phrases of one key that reach its own task: this number over all tasks, and from one task at least the second.
KEY_ROWS, LEAST_KEY_ROWS = 8192, 16
#: Bits of a place in a slice of texts, whose offsets Arrow keeps in 31.
PLACE_BITS = 31
#: Ids up to which a table of ids is broadcast (16 bytes each, thrice), and keys.
BROADCAST_IDS = 1_000_000
_LAST = (1 << 63) - 1
_KEY = np.dtype([("m", "<u8"), ("c", "<u8"), ("d", "<i8"), ("t", "<i8"), ("s", "<i8"), ("n", "<i4"), ("r", "u1")])


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each position on."""
    v = data.astype(np.uint64)
    for step in (1, 2, 4):
        v = v[:-step] | v[step:] << np.uint64(8 * step)
    n = len(v) - 24
    h = np.zeros(n, np.uint64)
    for k, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)):
        h ^= v[8 * k : 8 * k + n] * np.uint64(factor)
        h = (h << np.uint64(29) | h >> np.uint64(35)) * np.uint64(0x9FB21C651E98DF25)
    return mix64(h)


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    size = 1
    out = h
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(h) - w + 1], out[w - size : w - size + len(h) - w + 1]) if w > size else out


def phrases(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of all rows: (row, start in the row, strings, key, hash of the bytes, whether the least gram repeats) of each phrase."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    h = _gram_hashes(data)
    # hashes are compared by their upper bits, alike for slices of any size; equal ones by place
    low = np.uint64((1 << PLACE_BITS) - 1)
    at = np.arange(len(h), dtype=np.uint64)
    left = (_sliding_min(h & ~low | at, length - GRAM + 1) & low).astype(np.int64)
    right = (low - (_sliding_min(h & ~low | (low - at), length - GRAM + 1) & low)).astype(np.int64)
    key = h[left]
    many = np.maximum(np.diff(ends) - length + 1, 0)
    row = np.repeat(np.arange(len(many)), many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    place = at + ends[row]
    own = key[place]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] == 0)
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(own)))
    if count.size and count.max() > MOST_STRINGS:  # cut by multiples of a fixed step from the phrase's start
        parts = -(-count // MOST_STRINGS)
        which = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        heads = np.repeat(heads, parts) + which * MOST_STRINGS
        count = np.minimum(np.repeat(count, parts) - which * MOST_STRINGS, MOST_STRINGS)
    start = place[heads]
    again = right[start + count - 1] != left[start]
    up, down = _power(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LUT[data] * up[: len(data)])])
    size = count + length - 1
    text = mix64((total[start + size] - total[start]) * down[start] + size.astype(np.uint64))
    return row[heads], at[heads], count, own[heads], text, again


def _string_hashes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the `length` bytes from each position on."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    up, down = _power(len(data) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LUT[data] * up[: len(data)])])
    one = mix64((total[length:] - total[:n]) * down[:n])
    grams, two = _gram_hashes(data), np.zeros(n, np.uint64)
    for at in {*range(0, length - GRAM + 1, GRAM), length - GRAM}:
        two = mix64(two * np.uint64(0x9E3779B97F4A7C15) + grams[at : at + n] * np.uint64(2 * at + 1))
    return one, two


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of phrases, in the order of `length`-byte contexts.

    Rows are the strings of the phrases, ordered by their bytes, then by `order` and position.  A run is a
    stretch of rows with one preceding byte whose left neighbours follow each other as well.  Kept are the
    runs' first rows and the samples (position, match length with the row above) of the strings that no
    run's inner row leads to: those left of a run's first row and those that end a phrase.  Match lengths
    are compared for these positions only.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: np.ndarray, length: int = LENGTH):
        self.length = length
        self.strings = sizes - length + 1
        self.first = np.cumsum(self.strings) - self.strings  # number of each phrase's first string
        phrase = np.repeat(np.arange(len(starts)), self.strings)
        inside = np.arange(len(phrase)) - self.first[phrase]
        place = starts[phrase] + inside
        levels = self._levels(data, length)
        rank = self._context_ranks(levels, place, length)
        by = np.lexsort((inside, order[phrase], rank))
        byte = np.where(inside > 0, data[np.maximum(place - 1, 0)].astype(np.int16), -1)[by]
        row = np.empty(len(by), np.int64)
        row[by] = np.arange(len(by))
        inner = np.flatnonzero((byte[1:] == byte[:-1]) & (byte[1:] >= 0)) + 1
        # LF keeps the order of rows with one preceding byte, unless contexts that end at `length` bytes tie on the left
        inner = inner[row[by[inner] - 1] == row[by[inner - 1] - 1] + 1]
        first = np.ones(len(by), bool)
        first[inner] = False
        self.runs = np.flatnonzero(first)
        led = np.zeros(len(by), bool)
        led[by[inner] - 1] = True
        self.sampled = np.flatnonzero(~led)
        at = row[self.sampled]
        self.samples = np.where(at > 0, self._common(data, levels, place[by[at]], place[by[np.maximum(at - 1, 0)]], length), 0)

    @staticmethod
    def _levels(data: np.ndarray, length: int) -> dict[int, np.ndarray]:
        """Ranks of the 8, 16, ... bytes from each place on, by doubling."""
        padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
        v = padded.astype(np.uint64)
        for step in (1, 2, 4):
            v = v[:-step] << np.uint64(8 * step) | v[step:]
        n, size = len(data), 8
        out = {8: np.unique(v[:n], return_inverse=True)[1].astype(np.int64)}
        while size * 2 <= length:
            rank = out[size]
            ahead = np.concatenate([rank[size:], np.zeros(size, np.int64)])[:n]
            out[size * 2] = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
            size *= 2
        return out

    @staticmethod
    def _context_ranks(levels: dict[int, np.ndarray], place: np.ndarray, length: int) -> np.ndarray:
        size = max(levels)
        rank = levels[size]
        return np.unique(rank[place] * (len(rank) + 1) + rank[place + length - size], return_inverse=True)[1].astype(np.int64)

    @staticmethod
    def _common(data: np.ndarray, levels: dict[int, np.ndarray], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Bytes that the strings at places a and b share, `length` at most."""
        same, n = np.zeros(len(a), np.int64), len(data)
        for size in (max(levels), *sorted(levels, reverse=True)):
            rank = levels[size]
            fits = same + size <= length
            x, y = np.minimum(a + same, n - 1), np.minimum(b + same, n - 1)
            same += np.where(fits & (rank[x] == rank[y]), size, 0)
        for _ in range(8):
            x, y = np.minimum(a + same, n - 1), np.minimum(b + same, n - 1)
            same += (same < length) & (data[x] == data[y])
        return same

    def matching_statistics(self) -> np.ndarray:
        """Of each string: the bytes it shares with the row above, `length` at most, from the samples right of it."""
        at = np.arange(int(self.strings.sum()))
        next_ = np.searchsorted(self.sampled, at)  # the last string of a phrase is sampled
        return np.minimum(self.length, self.samples[next_] + self.sampled[next_] - at)

    def long_matches(self) -> np.ndarray:
        """Of each string: whether it also starts earlier, which the order puts above it."""
        return self.matching_statistics() >= self.length


def _merged(doc: np.ndarray, of: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of touching spans [a, b) of each text `of` of each document."""
    if not len(doc):
        return doc, of, a, b
    by = np.lexsort((a, of, doc))
    doc, of, a, b = doc[by], of[by], a[by], b[by]
    group = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (of[1:] != of[:-1]))])
    wide = int(b.max()) + 1
    high = np.maximum.accumulate(b + group * wide) - group * wide
    new = np.ones(len(doc), bool)
    new[1:] = (group[1:] != group[:-1]) | (a[1:] > high[:-1])
    heads = np.flatnonzero(new)
    return doc[heads], of[heads], a[heads], high[np.append(heads[1:], len(doc)) - 1]


def _pack(bin_: int, *columns: np.ndarray) -> pa.RecordBatch:
    raw = b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return pa.RecordBatch.from_arrays([pa.array([bin_], pa.int32()), pa.array([len(columns[0])], pa.int32()), pa.array([raw], pa.binary())], ["bin", "rows", "packed"])


def _unpack(n: int, raw: bytes, kind: np.dtype) -> np.ndarray:
    out, at = np.zeros(n, kind), 0
    for c in kind.names:
        size = kind[c].itemsize * n
        out[c] = np.frombuffer(raw, kind[c], n, at)
        at += size
    return out


def _first_of_each(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key, bytes' hash and place, each place once; which of them are the first of their bytes."""
    rows = rows[np.lexsort((rows["s"], rows["t"], rows["d"], rows["c"], rows["m"]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows["m"][1:] != rows["m"][:-1]) | (rows["c"][1:] != rows["c"][:-1])
    again = np.zeros(len(rows), bool)  # an equal row's phrase is the same occurrence, not a later one
    again[1:] = ~first[1:] & (rows["d"][1:] == rows["d"][:-1]) & (rows["t"][1:] == rows["t"][:-1]) & (rows["s"][1:] == rows["s"][:-1])
    return rows[~again], first[~again]


def _text_key():
    """What tells the texts of one id apart: a hash of 62 bits; those of null ids come after all others."""
    return F.shiftrightunsigned(F.xxhash64("text"), 2) + F.when(F.col("doc_id").isNull(), F.lit(1 << 62)).otherwise(F.lit(0))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, of, start, end): byte spans under strings of `length` that also start earlier.  docs: doc_id, of, text.

    doc_id and of are not null and name a text; equal rows are one.
    """
    spark = docs.sparkSession
    # as many as read the texts at least, so that a task's phrases follow from a split's size
    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    bins, many = 4 * tasks, max(LEAST_KEY_ROWS, KEY_ROWS // tasks)
    span = np.dtype([("d", "<i8"), ("t", "<i8"), ("s", "<i8"), ("e", "<i8")])

    def settle(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Spans of later occurrences, and the first of each by bin.

        More than `many` phrases of a key go to bins from `bins` on, by their bytes; a row without
        strings marks the key in its own bin.
        """
        rows, first = _first_of_each(np.concatenate(held))
        later = rows[~first]
        d, t, s, e = _merged(later["d"], later["t"], later["s"], later["s"] + later["n"] + length - 1)
        if len(d):
            yield _pack(-1, d, t, s, e)
        rows = rows[first]
        heads = np.flatnonzero(np.append(True, rows["m"][1:] != rows["m"][:-1]))
        count = np.diff(np.append(heads, len(rows)))
        spread = np.repeat(count > many, count)
        marks = np.zeros(int((count > many).sum()), _KEY)
        marks["m"] = rows["m"][heads[count > many]]
        rows, spread = np.concatenate([rows, marks]), np.append(spread, np.zeros(len(marks), bool))
        where = (np.where(spread, rows["c"], rows["m"]) >> np.uint64(20)).astype(np.int64) % bins + bins * spread
        by = np.argsort(where, kind="stable")
        edges = np.searchsorted(where[by], np.arange(2 * bins + 1))
        for b in np.flatnonzero(np.diff(edges)):
            part = rows[by[edges[b] : edges[b + 1]]]
            yield _pack(int(b), *(part[c] for c in _KEY.names))

    def occurrences(found: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for got in found:
            held.append(got)
            if sum(map(len, held)) > HELD:
                yield from settle(held)
                held.clear()
        if held:
            yield from settle(held)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for part in slices(batches, "text"):
                data, ends = buffers(part.column(2))
                row, start, count, key, text, again = phrases(data, ends, length)
                if len(row):
                    got = np.zeros(len(row), _KEY)
                    got["m"], got["c"], got["s"], got["n"], got["r"] = key, text, start, count, again
                    got["d"], got["t"] = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in (0, 1))
                    yield got

        yield from occurrences(found())

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The strings of the cuts, each a phrase of its own under its own hash."""

        def found() -> Iterator[np.ndarray]:
            for part in slices(batches, "text"):
                data, ends = buffers(part.column(2))
                m, c = _string_hashes(data, length)
                ids, ofs = (part.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                for r, cuts in enumerate(part.column(3).to_pylist()):
                    for x in cuts:
                        at = np.arange(x["start"], x["end"] - length + 1)
                        got = np.zeros(len(at), _KEY)
                        got["m"], got["c"], got["s"], got["n"] = m[ends[r] + at], c[ends[r] + at], at, 1
                        got["d"], got["t"] = ids[r], ofs[r]
                        yield got

        yield from occurrences(found())

    def dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def rows_of(d, t, s, e, m):
            return pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(s), pa.array(e), pa.array(m) if m is not None else pa.nulls(len(d), pa.int64())], ["doc_id", "of", "start", "end", "key"])

        for batch in batches:
            for b, n, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if b < 0:
                    got = _unpack(n, raw, span)
                    yield rows_of(got["d"], got["t"], got["s"], got["e"], None)
                else:
                    held.setdefault(b, []).append(_unpack(n, raw, _KEY))
        for b in list(held):
            rows = np.concatenate(held.pop(b))
            marked = np.unique(rows["m"][rows["n"] == 0])
            rows = rows[rows["n"] > 0]
            if not len(rows):
                continue
            rows, first = _first_of_each(rows)
            later = rows[~first]
            if len(later):
                yield rows_of(*_merged(later["d"], later["t"], later["s"], later["s"] + later["n"] + length - 1), None)
            rows = rows[first]
            same = rows["m"][1:] == rows["m"][:-1]
            # shared by other bytes, here or (marked) elsewhere, or perhaps repeating inside itself
            shared = np.append(False, same) | np.append(same, False) if b < bins else True
            rows = rows[shared | np.isin(rows["m"], marked) | (rows["r"] > 0)]
            if len(rows):
                yield rows_of(rows["d"], rows["t"], rows["s"], rows["s"] + rows["n"] + length - 1, rows["m"].astype(np.int64))

    kind = "bin int, rows int, packed binary"

    def firsts(packed: DataFrame, name: str) -> DataFrame:
        # spans that are settled already go anywhere
        dealt = packed.repartition(tasks, F.when(F.col("bin") < 0, F.xxhash64("packed")).otherwise(F.col("bin").cast("long")))
        return stored(dealt.mapInArrow(dictionary, "doc_id long, of long, start long, end long, key long"), name)

    def with_cuts(open_: DataFrame) -> DataFrame:
        """The texts of open phrases with their cuts: a list of one text's own phrases."""
        wanted = open_.groupBy("doc_id", "of").agg(F.collect_list(F.struct("start", "end", "key")).alias("cuts"))
        texts, ids = docs.select("doc_id", "of", "text"), open_.select("doc_id", "of").distinct()
        if ids.count() <= BROADCAST_IDS:
            texts = texts.join(F.broadcast(ids), ["doc_id", "of"], "left_semi")
        return texts.join(wanted, ["doc_id", "of"]).select("doc_id", "of", "text", "cuts")

    found = firsts(docs.mapInArrow(keys, kind), "phrases")
    settled, open_ = found.where("key is null").drop("key"), found.where("key is not null")
    hot = stored(open_.groupBy("key").agg(F.sum(F.col("end") - F.col("start")).alias("bytes")).where(F.col("bytes") > HOT_BYTES).select("key"), "hot")
    if n_hot := hot.count():
        few = F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot
        own = firsts(with_cuts(open_.join(few, "key", "left_semi")).mapInArrow(strings, kind), "strings")
        settled, open_ = settled.union(own.where("key is null").drop("key")), open_.join(few, "key", "left_anti").select(*open_.columns)
    size = open_.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    if not size:
        return settled
    shards = max(1, int(size // SHARD_BYTES))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for part in slices(batches, "text"):
            out: list[tuple] = []
            for doc, of, text, cuts in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                if (doc, of) == last:  # an equal row
                    continue
                last, raw = (doc, of), text.encode()
                out += [((x["key"] >> 13) % shards, doc, of, x["start"], raw[x["start"] : x["end"]]) for x in cuts if x["end"] <= len(raw)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["shard", "doc_id", "of", "start", "bytes"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for s, *row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                held.setdefault(s, []).append(row)
        for s in list(held):
            rows = list({tuple(r[:3]): r for r in sorted(held.pop(s), key=lambda r: r[:3])}.values())
            sizes = np.array([len(r[3]) for r in rows], np.int64)
            ids, ofs, starts = (np.array([r[c] for r in rows], np.int64) for c in (0, 1, 2))
            own = RunIndex(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), np.cumsum(sizes) - sizes, sizes, np.arange(len(rows)), length)
            hit = np.flatnonzero(own.long_matches())
            phrase = np.searchsorted(own.first, hit, "right") - 1
            at = starts[phrase] + hit - own.first[phrase]
            d, t, a, b = _merged(ids[phrase], ofs[phrase], at, at + length)
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(a), pa.array(b)], ["doc_id", "of", "start", "end"])

    cuts = with_cuts(open_).mapInArrow(cut, "shard int, doc_id long, of long, start long, bytes binary")
    return settled.union(cuts.repartition(min(shards, 4 * tasks), "shard").mapInArrow(index, "doc_id long, of long, start long, end long"))


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), digests: bool = False
) -> DataFrame:
    """Remove each byte under a string of `length` bytes that also starts earlier (smaller id, or same id and smaller start).

    Per row of `docs`: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), then kept_sha256 with
    `digests` or the kept text (broken characters at cuts go), then the `keep` columns.  Strings are
    judged on the input.  Null and empty texts lose nothing; rows with one id and text are one and have
    one result.  Different texts of one id follow each other in the order of a hash, each by its starts;
    null ids come last in order, each text of its own.
    """
    kept = [f"k{k}" for k in range(len(keep))]
    source = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), *(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)))
    base = id_text(source, "i", "t", *kept)
    keyed = base.select(F.coalesce("doc_id", F.lit(_LAST)).alias("at"), _text_key().alias("of"), "doc_id", "text", *kept)
    spans = stored(repeated_spans(keyed.select(F.col("at").alias("doc_id"), "of", "text"), length), "spans").withColumnRenamed("doc_id", "at")
    lists = spans.groupBy("at", "of").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    ids = spans.select("at", "of").distinct()
    if ids.count() <= BROADCAST_IDS:  # rows without spans need no shuffle
        with_ = keyed.join(F.broadcast(ids), ["at", "of"], "left_semi").join(lists, ["at", "of"])
        none = F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
        judged = with_.union(keyed.join(F.broadcast(ids), ["at", "of"], "left_anti").withColumn("spans", none))
    else:
        judged = keyed.join(lists, ["at", "of"], "left")
    judged = judged.select("doc_id", "text", "spans", *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for text, cuts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                raw, at, runs, left = text.encode(), 0, 0, []
                for a, b in sorted((x["start"], x["end"]) for x in cuts or ()):
                    if a > at or not runs:
                        runs += 1
                        left.append(raw[at:a])
                    at = max(at, b)
                left.append(raw[at:])
                now = b"".join(left)
                rows.append((len(raw), len(raw) - len(now), runs, hashlib.sha256(now).hexdigest() if digests else now.decode("utf-8", "ignore")))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(types)), *part.columns[3:]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digests else "text", *kept])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digests else "text string")
    for c, k in zip(keep, kept, strict=True):
        schema += f", {k} {docs.schema[c].dataType.simpleString()}"
    out = judged.mapInArrow(run, schema)
    return out.select(*out.columns[:5], *(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)))
