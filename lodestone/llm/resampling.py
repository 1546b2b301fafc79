"""Importance resampling towards a target distribution of hashed word features.

Features are runs of 1 to `most` consecutive words of a text in lower case (A-Z only), joined by one
space; a feature's bucket is the crc32 of its bytes modulo `buckets`.  The corpus is written once as
packed streams of 16-bit buckets with the documents' ends in them.  Counts come from sorting each
stream and adding the lengths of equal runs; later the buckets' gains are gathered along the same
streams and added document by document.  Texts are read once, and no stage sees them again.

A document's score is its weight (sum of gains) plus Gumbel noise that depends on the seed and its id
only; the highest `percent` % of the documents with `least_words` words are drawn.

Null and empty texts have no features: weight 0, not eligible.  A null id hashes as the empty string
and comes last among ties.  Repeated rows are judged each; equal rows hold neighbouring ranks.  An
empty corpus gives no rows; an empty target gives every bucket t = 0.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import id_text, slices, stored
from .textcore import buffers

BUCKETS, MOST_WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of a text that are cut into words at a time, and features that a worker remembers.
PIECE, REMEMBERED = 1 << 20, 1 << 18
_WORD, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")


class _Bucket(dict):
    """Buckets by feature; short features are remembered up to a fixed number."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(self) < REMEMBERED and len(feature) <= 64:
            self[feature] = found
        return found


def bucket_stream(text: bytes, bucket: _Bucket, most: int) -> tuple[np.ndarray, int]:
    """The buckets of all features of a text, and its number of words; long texts go by pieces that end between words."""
    parts, before, at, n_words = [], [], 0, 0
    while at < len(text):
        to = at + PIECE
        if to < len(text):
            gap = _GAP.search(text, to)
            to = gap.start() if gap else len(text)
        words = _WORD.findall(text[at:to].lower())
        at = to
        n_words += len(words)
        parts.append(np.fromiter(map(bucket.__getitem__, words), np.uint16, len(words)))
        if most > 1 and words:
            both = before + words
            for k in range(2, most + 1):
                run = both[max(0, len(before) - k + 1) :]
                parts.append(np.fromiter((bucket[b" ".join(run[i : i + k])] for i in range(len(run) - k + 1)), np.uint16))
            before = both[-(most - 1) :]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint16)), n_words


STREAMS = "ids array<long>, ends array<long>, words array<long>, stream binary"


def bucket_streams(docs: DataFrame, buckets: int = BUCKETS, most: int = MOST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each slice of about 1 MB of text: ids, each document's end in the stream, its words, the packed stream."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket has 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Bucket(buckets)
        for part in slices(batches, "text"):
            data, ends = buffers(part.column(1))
            view = memoryview(data)
            got = [bucket_stream(bytes(view[a:b]), bucket, most) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            sizes = np.cumsum([len(s) for s, _ in got], dtype=np.int64)
            packed = np.concatenate([s for s, _ in got]).astype("<u2").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([[n for _, n in got]], pa.list_(pa.int64())), pa.array([packed], pa.binary())],
                ["ids", "ends", "words", "stream"],
            )

    return id_text(docs, id_col, text_col).mapInArrow(run, STREAMS)


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket: streams are sorted and run-length encoded in their tasks, the runs added up by key.

    A task hands on one row for each bucket at most, and so does the sum: `buckets` rows reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                line = np.sort(np.frombuffer(packed.as_buffer(), "<u2"))
                if len(line):
                    first = np.concatenate([[0], np.flatnonzero(np.diff(line)) + 1])
                    total[line[first]] += np.diff(np.append(first, len(line)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in streams.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the smoothed source share) by bucket, in doubles."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """floor(1000 x standard Gumbel noise), from the first 32 bits of a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(streams: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """Per document: doc_id, n_features, n_words, weight, score; gains are gathered along the streams and added by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, ends, words, packed in zip(*batch.columns, strict=True):
                ends = ends.values.to_numpy(zero_copy_only=False).astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                along = np.append(gains[np.frombuffer(packed.as_buffer(), "<u2")], 0)  # the 0 gives a start at the end a place
                weight = np.where(ends > starts, np.add.reduceat(along, starts), 0)
                noise = np.array([gumbel(i, seed) for i in ids.values.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(ends - starts), words.values, pa.array(weight, pa.int64()), pa.array(weight + noise, pa.int64())], ["doc_id", "n_features", "n_words", "weight", "score"])

    return streams.mapInArrow(run, "doc_id long, n_features long, n_words long, weight long, score long")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition with their place in it."""
    at = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at + 1, at + 1 + batch.num_rows))], [*batch.schema.names, "place"])
        at += batch.num_rows


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, most: int = MOST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text"
) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (1, 2, ... of the drawn; null otherwise), n_words, drawn.

    Ranks come from a range partitioning by score: each part is numbered in its own task and the parts'
    sizes are added up, so that no task sees more than its range and the driver one number a part.
    """
    spark = docs.sparkSession
    streams = stored(bucket_streams(docs, buckets, most, id_col, text_col), "streams")
    aim = bucket_streams(target.select(F.lit(0).alias("doc_id"), F.col(f"`{target_text}`").alias("text")), buckets, most)
    gains = bucket_gains(bucket_counts(streams, buckets), bucket_counts(aim, buckets))
    scored = stored(weights(streams, gains, seed).withColumn("late", F.col("n_words") < least_words), "scored")
    order = [F.asc("late"), F.desc("score"), F.asc_nulls_last("doc_id")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = stored(ranged.mapInArrow(_numbered, "doc_id long, n_features long, n_words long, weight long, score long, late boolean, part int, place long"), "placed")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if(~F.col("late")).alias("n_eligible")).orderBy("part").collect()  # `parts` rows
    draw = sum(r.n_eligible for r in sizes) * percent // 100
    before, starts = 0, []
    for r in sizes:
        starts.append((r.part, before))
        before += r.n
    rank = F.col("place") + F.col("before")
    out = placed.join(F.broadcast(spark.createDataFrame(starts, "part int, before long")), "part")
    drawn = ~F.col("late") & (rank <= F.lit(draw))
    return out.select("doc_id", "n_features", "weight", "score", F.when(drawn, rank).alias("rank"), "n_words", drawn.alias("drawn"))
