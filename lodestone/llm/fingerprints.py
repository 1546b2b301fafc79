"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch holds the k smallest distinct 48-bit hashes of a text's five-word shingles.  Sketches of
parts merge to the sketch of the whole; two of them estimate resemblance, containment and the number
of distinct shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import id_text, slices
from .textcore import shingle_hashes

K = 128
_BITS = 48
#: Documents of a range of ids at which the next document is looked up, about.
RANGE_ROWS = 4000
#: Ranges at most: that many ids come to the driver.
MAX_RANGES = 10_000
_LOW = -(1 << 63)


def sketches(col: pa.Array, k: int = K) -> list[np.ndarray]:
    """The sketch of each row."""
    h, ends = shingle_hashes(col)
    h = (h >> np.uint64(64 - _BITS)).astype(np.int64)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        own = h[a:b]
        if b - a > 4 * k:  # repeats are rare enough that 2k smallest mostly hold k distinct ones
            few = np.unique(np.partition(own, 2 * k)[: 2 * k])
            if len(few) >= k:
                out.append(few[:k])
                continue
        out.append(np.unique(own)[:k])
    return out


def merge(parts: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of what the parts were made of."""
    return np.unique(np.concatenate(parts or [np.zeros(0, np.int64)]))[:k]


def _smallest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, int, int]:
    """Of the k smallest hashes of the union: their number, and how many are in both, in a, in b."""
    if len(a) == len(b) and np.array_equal(a, b):
        return len(a), len(a), len(a), len(a)
    both = np.concatenate([a, b])
    both.sort()
    twice = np.flatnonzero(both[1:] == both[:-1])
    size = min(k, len(both) - len(twice))
    distinct = np.delete(both, twice + 1)[:size]
    last = distinct[-1] if size else -1
    return size, int(np.searchsorted(both[twice], last, "right")), int(np.searchsorted(a, last, "right")), int(np.searchsorted(b, last, "right"))


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; 1 where both are empty, exact below k distinct shingles."""
    size, both, _, _ = _smallest(a, b, k)
    return both / size if size else 1.0


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 where a is empty."""
    _, both, in_a, _ = _smallest(a, b, k)
    return both / in_a if in_a else float(not len(a))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / (1 << _BITS))


def to_text(sketch: np.ndarray) -> str:
    """Twelve hex digits a hash, ascending."""
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def from_text(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], axis=1).copy().view(">u8").ravel().astype(np.int64)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint, n_distinct (estimate).  One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            own = sketches(part.column(1), k)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(to_text, own), pa.string()), pa.array([distinct_count(x, k) for x in own])], ["doc_id", "fingerprint", "n_distinct"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string, n_distinct double")


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    Edited: the last half of the code points replaced by the first as many of the next document by
    ascending id (ties by text; after the last, the first).  Null texts are empty; a null id sorts
    first; with a single row it is its own next.  Documents are dealt by ranges of ids that come from
    quantiles; each range also gets the first document of the next one, so no task sees all rows.
    """
    base = id_text(docs, id_col, text_col)
    n = base.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    shares = [i / ranges for i in range(1, ranges)]
    key = F.coalesce("doc_id", F.lit(_LOW))
    low, cuts = base.select(F.min(key), F.percentile_approx(key, shares or [0.5], 10 * MAX_RANGES)).first()
    bounds = np.array(sorted({low if low is not None else _LOW, *((cuts or []) if shares else [])}), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(_LOW).to_numpy(zero_copy_only=False)
            where = np.searchsorted(bounds, ids, "right") - 1
            heads = np.flatnonzero(bounds[where] == ids)  # these also end the range before
            back = np.where(where[heads] == 0, len(bounds) - 1, where[heads] - 1)
            rows = pa.array(np.concatenate([np.arange(len(ids)), heads]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.concatenate([where, back]).astype(np.int32)), pa.array(np.concatenate([np.zeros(len(ids), bool), np.ones(len(heads), bool)]))],
                ["doc_id", "text", "bucket", "halo"],
            )

    dealt = base.mapInArrow(deal, "doc_id long, text string, bucket int, halo boolean")
    dealt = dealt.repartition(len(bounds), "bucket").sortWithinPartitions("bucket", "halo", "doc_id", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, until its next one comes
        for part in slices(batches, "text"):
            own = sketches(part.column(1), k)
            rows = [*zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), own, strict=True)]
            rows = rows if held is None else [held, *rows]
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:], strict=False) if not a[3] and a[2] == b[2]]
            if not pairs:
                continue
            edited = []
            for a, b in pairs:
                half = len(a[1]) // 2
                edited.append(a[1][: len(a[1]) - half] + b[1][:half])
            changed = sketches(pa.array(edited, pa.string()), k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                    pa.array([to_text(a[4]) for a, _ in pairs], pa.string()),
                    pa.array(map(to_text, changed), pa.string()),
                    pa.array([resemblance(a[4], c, k) for (a, _), c in zip(pairs, changed, strict=True)], pa.float64()),
                    pa.array([resemblance(a[4], b[4], k) for a, b in pairs], pa.float64()),
                    pa.array([distinct_count(a[4], k) for a, _ in pairs], pa.float64()),
                    pa.array([containment(c, a[4], k) for (a, _), c in zip(pairs, changed, strict=True)], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_distinct", "edited_within"],
            )

    return dealt.mapInArrow(
        compare,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, edited_within double",
    )
