"""Session helpers: Arrow mapping in bounded slices, tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are handled at a time inside a task; one longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch on its way to a Python worker; Spark's own limit of 64 MB is held by JVM and worker at once, for each task.
BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where the session names none and runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Batches of BATCH_BYTES, or one row, for what the session runs from now on; a limit of its own stays."""
    if spark.conf.get(_BATCH_LIMIT, None) is None:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends there.

    The files outlive a lost executor; they are removed when the process ends or by `release`.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def marked() -> int:
    """A mark for `release`: tables written from now on."""
    return len(_scratch)


def release(since: int = 0, keep: DataFrame | None = None) -> None:
    """Remove the tables written by `stored` after a mark, but for those that `keep` reads; frames that read them end with it."""
    kept = set(keep.inputFiles()) if keep is not None else set()
    held = _scratch[since:]
    del _scratch[since:]
    for spark, path in held:
        if any(path.rsplit("/", 1)[1] in f for f in kept):
            _scratch.append((spark, path))
            continue
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone when the process ends
            return


def offsets(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary column's rows, of either width."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    return np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)


atexit.register(release)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice have `limit` bytes, or it is one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = offsets(col)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def id_text(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only what an operator reads, nulls as empty texts, so that other columns can't clash."""
    bounded_batches(df.sparkSession)
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *(F.col(f"`{c}`") for c in more),
    )


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)
