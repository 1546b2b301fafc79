"""N-gram Jaccard join with adaptive multi-match prefixes.

Every text is its set of distinct five-word shingles; equal sets are one node.  Links come in two ways,
both verified exactly: two star rounds link the members of posting lists to one well-connected member
each (no multi-match test there), so that a group of copies costs its size; then all pairs of different
components that pass the multi-match test are candidates.

All sets are sorted by one global order, rare shingles first; a pair that needs the overlap o must share l
shingles within the first |x| - o + l of either set (its pair prefix).  Each document chooses its own l: a
longer prefix costs more index entries and leaves fewer candidates, by the estimated lengths of its posting
lists.  An entry holds its place in the order, so an entry meets only partners whose size puts it into both
pair prefixes: in a group of near copies, the common shingles of a member with many own ones meet nobody.

Order and estimates come from one sketch of document frequencies over all sets; whatever its error,
every set has the same order, so no link is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .spark import id_text, slices, stored
from .textcore import distinct_shingles, mix64

NUMERATOR, DENOMINATOR = 3, 4
SHINGLE = 5
#: Multi-matches that are considered.  A passage of a few words that texts share gives several adjacent
#: shingles at once: only a longer multi-match tells such pairs from near copies.
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16)
#: The cost of a verification in index entries.
VERIFY_COST = 40.0
#: Counters of the frequency sketch: a fixed size for any corpus beyond 2**24 * 32 shingles.
SKETCH_BITS = (12, 24)
#: Estimated frequency from which a shingle's entries skip the packing by bins, which must hold a bin.
HEAVY = 4096
#: Shared shingles of a document that propose a link in a star round.
STAR_KEYS = 4
#: Ids up to which a table of ids is broadcast (8 bytes each, thrice).
BROADCAST_IDS = 1_000_000
_ENTRY = np.dtype([("t", "<u8"), ("v", "<i8"), ("n", "<i4"), ("p", "<i4"), ("l", "u1")])


def overlap_needed(n: int) -> int:
    """Least overlap that any set must have with one of n shingles to link with it."""
    return -(-NUMERATOR * n // DENOMINATOR)


def _set_keys(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Two order-free 64-bit sums that name a set."""
    one = [int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in sets]
    two = [int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0 for s in sets]
    return one, two


def sets(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k1, k2) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            own = distinct_shingles(part.column(1), SHINGLE)
            one, two = _set_keys(own)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in own], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["doc_id", "n", "k1", "k2"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long")


def _log_class(count: np.ndarray) -> np.ndarray:
    """Frequency classes in eighths of a doubling, which fit a byte."""
    return np.minimum(255, np.round(8 * np.log2(count.astype(np.float64) + 1))).astype(np.uint8)


def frequency_sketch(nodes: DataFrame, bits: int) -> np.ndarray:
    """Classes of the summed counts of 1 << bits hashed counters over all sets."""
    chunk = 1 << max(0, bits - 6)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        for part in slices(batches, "text"):
            found = np.concatenate(distinct_shingles(part.column(1), SHINGLE))
            total += np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.int32)
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % 32
        for k in range(0, 1 << bits, chunk):
            piece = total[k : k + chunk]
            if piece.any():
                kind = np.uint8 if piece.max() < 256 else np.int32
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([salt], pa.int32()), pa.array([bytes([kind is np.uint8]) + zlib.compress(piece.astype(kind).tobytes(), 1)], pa.binary())], ["at", "salt", "counts"])

    def unpack(raw: bytes) -> np.ndarray:
        return np.frombuffer(zlib.decompress(raw[1:]), np.uint8 if raw[0] else np.int32 if raw[0] == 0 else np.int64).astype(np.int64)

    def add(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in groups:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                piece = unpack(raw)
                held[k] = held[k] + piece if k in held else piece
        for k, piece in held.items():
            piece = np.minimum(piece, 2**31 - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([0], pa.int32()), pa.array([b"\0" + zlib.compress(piece.tobytes(), 1)], pa.binary())], ["at", "salt", "counts"])

    kind = "at long, salt int, counts binary"
    partial = nodes.mapInArrow(count, kind).repartition("at", "salt").mapInArrow(add, kind)
    out = np.zeros(1 << bits, np.uint8)
    for k, _, raw in partial.repartition("at").mapInArrow(add, kind).toLocalIterator():
        out[k : k + chunk] = _log_class(unpack(bytes(raw)))
    return out


def choose_matches(order_frequency: np.ndarray, n: int) -> int:
    """The multi-match l of least estimated cost for a set of n shingles with these list lengths, in order.

    Costs are those of partners of like size, whose pair prefix has n - o + l shingles for the overlap o.
    """
    overlap = -(-2 * NUMERATOR * n // (NUMERATOR + DENOMINATOR))
    lengths = np.cumsum(np.maximum(order_frequency[: n - overlap + MATCHES[-1]], 0))
    able = [m for m in MATCHES if m <= overlap_needed(n)]
    cost = [lengths[min(n - overlap + m, len(lengths)) - 1] * (1 + VERIFY_COST / m) for m in able]
    return able[int(np.argmin(cost))]


def postings(nodes: DataFrame, sketch: np.ndarray, bits: int, total: int = 0) -> DataFrame:
    """Entries (token, node, n, p, l) of the shingles that more than one node may have in its prefix; p: place in the set's order."""
    shared = nodes.sparkSession.sparkContext.broadcast(sketch)  # 1 << bits bytes
    # what unrelated shingles add to a counter: the median of all counters, empty ones too, as frequent shingles fill few
    noise = 2 ** (float(np.median(sketch)) / 8) - 1

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for part in slices(batches, "text"):
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for node, own in zip(part.column(0).to_pylist(), distinct_shingles(part.column(1), SHINGLE), strict=True):
                n = len(own)
                if not n:
                    continue
                level = table[(own >> np.uint64(64 - bits)).astype(np.int64)]
                first = np.lexsort((own, level))[: n - overlap_needed(n) + MATCHES[-1]]
                estimate = np.exp2(level[first] / 8.0) - 1
                matches = choose_matches(estimate - noise, n)
                take = n - overlap_needed(n) + matches
                took = len(first[:take])
                for c, x in zip(cols, (own[first[:take]], np.full(took, node, np.int64), np.full(took, n, np.int32), np.arange(took, dtype=np.int32), np.full(took, matches, np.uint8), estimate[:take] >= HEAVY + noise), strict=True):
                    c.append(x)
            if not cols[0]:
                continue
            token, node, n, place, matches, heavy = map(np.concatenate, cols)
            raw = np.zeros(len(token), _ENTRY)
            raw["t"], raw["v"], raw["n"], raw["p"], raw["l"] = token, node, n, place, matches
            for bin_, rows in _by_bin(token[~heavy], bins, raw[~heavy]):
                yield _packed(bin_, rows)
            for k in range(0, int(heavy.sum()), 1 << 15):  # as they are: their lists have no bound
                yield _packed(-1, raw[heavy][k : k + (1 << 15)])

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if b < 0:
                    yield _rows(_unpack(raw))
                else:
                    held.setdefault(b, []).append(raw)
        for parts in held.values():
            rows = np.concatenate([_unpack(x) for x in parts])
            rows = rows[np.argsort(rows["t"], kind="stable")]
            same = rows["t"][1:] == rows["t"][:-1]
            twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            if twice.any():
                yield _rows(rows[twice])

    spark = nodes.sparkSession
    # a third of all shingles stand in prefixes: a task holds about a million entries
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 3_000_000)
    bins = max(8, tasks) * 4
    packed = nodes.mapInArrow(entries, "bin int, salt int, entries binary")
    dealt = packed.repartition(tasks, F.when(F.col("bin") >= 0, F.col("bin")).otherwise(-1 - F.col("salt")))
    return dealt.mapInArrow(repeated, "token long, node long, n int, p int, l int")


def _by_bin(token: np.ndarray, bins: int, raw: np.ndarray):
    where = ((token * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % bins
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(bins + 1))
    for b in range(bins):
        if edges[b] < edges[b + 1]:
            yield b, raw[order[edges[b] : edges[b + 1]]]


def _packed(bin_: int, rows: np.ndarray) -> pa.RecordBatch:
    columns = np.concatenate([np.ascontiguousarray(rows[c]).view(np.uint8) for c in rows.dtype.names])
    salt = zlib.crc32(columns[:64].tobytes()) % 997
    return pa.RecordBatch.from_arrays([pa.array([bin_], pa.int32()), pa.array([salt], pa.int32()), pa.array([columns.tobytes()], pa.binary())], ["bin", "salt", "entries"])


def _unpack(raw: bytes) -> np.ndarray:
    n, at = len(raw) // _ENTRY.itemsize, 0
    out = np.zeros(n, _ENTRY)
    for c in out.dtype.names:
        size = out.dtype[c].itemsize * n
        out[c] = np.frombuffer(raw[at : at + size], out.dtype[c])
        at += size
    return out


def _rows(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows["t"].astype(np.int64)), *(pa.array(rows[c].astype(k)) for c, k in (("v", np.int64), ("n", np.int32), ("p", np.int32), ("l", np.int32)))], ["token", "node", "n", "p", "l"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (u, v), those whose exact Jaccard similarity reaches the threshold; texts: (node, text)."""
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v").toDF("node")).distinct()
    if ends.count() <= BROADCAST_IDS:
        ends = F.broadcast(ends)
    own = stored(texts.join(ends, "node", "left_semi"), "ends")
    both = pairs.join(own.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    both = both.join(own.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u").select("u", "v", "text_u", "text_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                kinds = [part.column(c).dictionary_encode() for c in (2, 3)]
                found = [distinct_shingles(d.dictionary.cast(pa.string()), SHINGLE) for d in kinds]
                at = [d.indices.to_pylist() for d in kinds]
                keep = []
                for i, j in zip(*at, strict=True):
                    a, b = found[0][i], found[1][j]
                    common = len(a) + len(b) - len(np.union1d(a, b))
                    keep.append(DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common) and common > 0)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(keep)), part.column(1).filter(pa.array(keep))], ["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def _in_pair_prefix(n: str, place: str, other, matches):
    """Whether a shingle's place in a set of n is within the prefix that must hold `matches` shingles shared with a set of `other`.

    The first l shared shingles of a link with the overlap o stand at places below n - o + l of either set.
    """
    needed = F.expr(f"{NUMERATOR}L") * (F.col(n).cast("long") + other)
    # in integers: place < n - ceil(needed / 7) + matches
    return needed <= (F.col(n) - F.col(place) + matches - 1).cast("long") * (NUMERATOR + DENOMINATOR)


def _size_fits(a: str, b: str):
    low, high = F.least(a, b), F.greatest(a, b)
    return DENOMINATOR * low.cast("long") >= NUMERATOR * high.cast("long")


def links(entries: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Verified links (u, v) that join all components of the similarity graph, and their components."""
    # a prefix shingle without other entries may still stand behind another node's prefix: it proves nothing of a node alone
    spread = stored(entries.groupBy("node").agg((F.count("*") / F.max("n")).alias("share"), F.max("n").alias("size")), "spread")
    edges, comp = None, None
    for turn in range(2):
        pick = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("token", F.lit(turn)), "token"))
        keys = entries.select("token", "node", pick.alias("k")).where(F.col("k") <= STAR_KEYS).drop("k").join(spread, "node")
        if comp is not None:
            keys = keys.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        else:
            keys = keys.withColumn("component", F.col("node"))
        # the member with most shared shingles; the second time the least one
        best = F.max_by(F.struct("node", "size", "component"), F.struct("share", -F.col("node"))) if turn == 0 else F.min_by(F.struct("node", "size", "component"), F.struct("node"))
        centre = keys.groupBy("token").agg(best.alias("c"))
        star = keys.join(centre, "token").where((F.col("node") != F.col("c.node")) & (F.col("component") != F.col("c.component")) & _size_fits("size", "c.size"))
        star = stored(star.select(F.least("node", "c.node").alias("u"), F.greatest("node", "c.node").alias("v")).distinct(), "star")
        new = stored(verified(star, texts), "links")
        edges = new if edges is None else edges.union(new)
        comp = stored(components(edges), "comp")
    # what is left: pairs of different components, of which one is not its list's largest
    size = comp.groupBy("component").agg(F.count("*").alias("weight"))
    placed = entries.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")).join(size, "component", "left").fillna(1, ["weight"])
    # the earliest of l shared shingles stands where the rest can hold the overlap, whatever the partner: its list's smallest set needs least
    least = placed.groupBy("token").agg(F.min("n").alias("least_n"))
    open_ = placed.join(least, "token").where(_in_pair_prefix("n", "p", F.greatest("least_n", F.ceil(F.lit(NUMERATOR) * F.col("n") / DENOMINATOR)), F.col("l")))
    open_ = stored(open_.drop("least_n"), "open")
    lists = open_.groupBy("token").agg(F.max_by("component", F.struct("weight", "component")).alias("major"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    placed = stored(open_.join(lists.select("token", "major"), "token").select("token", "node", "n", "p", "l", "component", (F.col("component") == F.col("major")).alias("is_major")), "placed")
    a = placed.where("not is_major").select("token", *(F.col(c).alias(f"a_{c}") for c in ("node", "n", "p", "l", "component")))
    b = placed.select("token", *(F.col(c).alias(f"b_{c}") for c in ("node", "n", "p", "l", "component", "is_major")))
    matches = F.least("a_l", "b_l")
    fits = _size_fits("a_n", "b_n") & _in_pair_prefix("a_n", "a_p", F.col("b_n"), matches) & _in_pair_prefix("b_n", "b_p", F.col("a_n"), matches)
    met = a.join(b, "token").where((F.col("a_component") != F.col("b_component")) & fits & (F.col("b_is_major") | (F.col("a_node") < F.col("b_node"))))
    found = met.groupBy(F.least("a_node", "b_node").alias("u"), F.greatest("a_node", "b_node").alias("v")).agg(F.count("*").alias("shared"), F.min(matches).alias("needed"))
    rest = stored(found.where("shared >= needed").select("u", "v"), "candidates")
    new = stored(verified(rest, texts), "links")
    if new.isEmpty():
        return edges, comp
    edges = edges.union(new)
    return edges, stored(components(edges), "comp")


def similarity_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, n_copies (rows with an equal set).

    Words are runs without ASCII white space, A-Z lower-cased; fewer than five make one shingle.  Texts
    without words and null texts link with nothing.  Rows with the same id count as one document; a
    null id has no component and gives no links.  Any extra columns are ignored.
    """
    base = id_text(docs, id_col, text_col)
    own = stored(sets(base), "sets")
    total = own.agg(F.sum("n")).first()[0] or 0
    kinds = own.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_copies"))
    kinds = stored(kinds, "kinds")
    firsts = kinds.select(F.col("node").alias("doc_id")).distinct()
    if firsts.count() <= BROADCAST_IDS:
        firsts = F.broadcast(firsts)
    nodes = base.join(firsts, "doc_id", "left_semi").select("doc_id", "text")
    bits = int(np.clip(int(max(total, 1) // 32).bit_length(), *SKETCH_BITS))
    entries = stored(postings(nodes, frequency_sketch(nodes, bits), bits, total).distinct(), "postings")
    _, comp = links(entries, nodes.select(F.col("doc_id").alias("node"), "text"))
    # an id with several texts is one document: its sets' nodes are joined
    several = own.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count_distinct("k1", "k2").alias("kinds")).where("kinds > 1")
    named = own.join(kinds.withColumnRenamed("n", "m"), ["k1", "k2"], "left").where("m is null or m = n").drop("m")
    if not several.isEmpty():
        ties = named.join(several, "doc_id").where("node is not null").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
        comp = components(comp.select(F.col("node").alias("u"), F.col("component").alias("v")).union(ties))
    out = named.join(comp, "node", "left")
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(linked, F.coalesce("component", "node")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, F.col("n_copies")).otherwise(F.lit(1)).cast("long").alias("n_copies"),
    )
