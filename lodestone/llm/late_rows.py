"""A table of days in sorted Parquet files, and the overwrite of those days that late rows touch.

A layout holds the latest version of each key.  Each day's rows, sorted by time and key, are cut into
files of a fixed number of rows: `day=<days since 1970>/file_no=<from 0>/part-*`; rows without a time
have day -1.  `overwrite` takes rows that came late: a version that arrived after the stored one
replaces it, wherever that lies.  Days in which a row comes or goes are written anew beside the layout
and then swapped in by renames; files of other days are never opened for writing.

Within a day rows are dealt by fixed time slices.  Stored rows and the day's outgoing keys and
incoming rows meet slice by slice, each slice is merged in order, and prefix sums over the slices'
counts say where every row's file begins, so that no task sees a day.  A slice with more than
`most_rows` rows is cut further at instants, and a single instant at ranges of keys.

Versions are compared by arrival (null: before all), then by the other columns in their order, so
that ties and repeated rows have one winner whichever way they come.  Null keys are one key.  An
empty table gives a layout without files.  Column names that clash with the operator's own (they
begin with `_late_`) or with its folders (`day`, `file_no`) are refused.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spark import shared_dir, stored

DAY_US = 86_400_000_000
#: Seconds of a time slice, and rows of a slice from which it is cut further.
SLICE_S, MOST_ROWS = 3600, 1 << 16
_PIECE = ["_late_day", "_late_slice", "_late_sub", "_late_ids"]


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp in UTC, with or without a zone, whatever the session's zone is."""
    c = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        second = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
        return F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * DAY_US + F.hour(c).cast("long") * 3_600_000_000 + F.minute(c).cast("long") * 60_000_000 + second
    return F.unix_micros(c.cast("timestamp"))


def day_of(us: Column) -> Column:
    return F.coalesce((us - F.pmod(us, F.lit(DAY_US))) / DAY_US, F.lit(-1)).cast("long")


class Layout:
    """Where a layout lies and how it is cut."""

    def __init__(self, path: str, schema: T.StructType, key: str, time: str, arrived: str, rows_per_file: int, slice_s: int = SLICE_S, most_rows: int = MOST_ROWS):
        if clash := [c for c in schema.names if c.startswith("_late_") or c in ("day", "file_no")]:
            raise ValueError(f"column names of the layout's own: {clash}")
        self.path, self.schema, self.key, self.time, self.arrived = path, schema, key, time, arrived
        self.rows_per_file, self.slice_s, self.most_rows = rows_per_file, slice_s, most_rows

    def files(self, spark: SparkSession) -> DataFrame:
        """The stored rows with day, file_no and the reader's metadata."""
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField("day", T.LongType()), T.StructField("file_no", T.LongType())])).parquet(self.path)


def _cols(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def latest(rows: DataFrame, at: Layout) -> DataFrame:
    """The latest version of each key; a hot key is reduced in the tasks that read it."""
    others = [c for c in at.schema.names if c not in (at.key, at.arrived)]
    best = F.max(F.struct(*_cols([at.arrived, *others]))).alias("_late_best")
    found = rows.groupBy(F.col(f"`{at.key}`").alias("_late_key")).agg(best)
    return found.select(*(F.col("_late_key").alias(c) if c == at.key else F.col(f"_late_best.`{c}`").alias(c) for c in at.schema.names))


def _version(at: Layout, prefix: str = "") -> Column:
    others = [c for c in at.schema.names if c not in (at.key, at.arrived)]
    return F.struct(*(F.col(f"{prefix}`{c}`") for c in [at.arrived, *others]))


def _sliced(df: DataFrame, at: Layout) -> DataFrame:
    us = micros(df, at.time)
    timed = df.withColumn("_late_us", us).withColumn("_late_day", day_of(F.col("_late_us")))
    return timed.withColumn("_late_slice", F.coalesce((F.pmod("_late_us", F.lit(DAY_US)) / (at.slice_s * 1_000_000)).cast("int"), F.lit(0)))


def _pieces(sides: list[DataFrame], at: Layout) -> list[DataFrame]:
    """The sides with the same two numbers of a piece inside the slice; (slice, sub, ids) sorts as (time, key) does.

    Only the slices with more than `most_rows` rows are looked at again: instants are gathered up to
    that number, and an instant with more is cut at ranges of its keys.  The table of instants meets
    the rows in a join on salted instants, so that a hot one is spread over many tasks.
    """
    slice_cols, key = ["_late_day", "_late_slice"], F.col(f"`{at.key}`")
    keys = sides[0].select(*slice_cols, "_late_us", key.alias("_late_key"))
    for s in sides[1:]:
        keys = keys.unionByName(s.select(*slice_cols, "_late_us", key.alias("_late_key")))
    hot = stored(keys.groupBy(*slice_cols).count().where(F.col("count") > at.most_rows).drop("count"), "hot")
    if hot.isEmpty():
        return [s.withColumns({"_late_sub": F.lit(0).cast("long"), "_late_ids": F.lit(0).cast("long")}) for s in sides]
    salts = 32
    spread = lambda df: df.withColumn("_late_salt", F.pmod(F.xxhash64("_late_us", "_late_key"), F.lit(salts)).cast("int"))
    salted = hot.withColumn("_late_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    instants = spread(keys).join(salted, [*slice_cols, "_late_salt"], "left_semi").groupBy(*slice_cols, "_late_us")
    instants = instants.agg(F.count("*").alias("n"), F.min("_late_key").alias("low"), F.max("_late_key").alias("high"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*slice_cols).orderBy(F.asc_nulls_first("_late_us")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heavy = F.col("n") > at.most_rows
    wide = (F.col("high") - F.col("low")) / F.ceil(F.col("n") / at.most_rows)
    cuts = instants.select(
        *slice_cols, "_late_us", (F.floor(before / at.most_rows) * 2 + heavy.cast("int")).cast("long").alias("_late_sub"), F.when(heavy, F.col("low")).alias("_late_low"), F.greatest(F.lit(1), F.floor(wide) + 1).cast("long").alias("_late_wide")
    )
    cuts = stored(cuts, "cuts").withColumn("_late_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = []
    for s in sides:
        named = spread(s.withColumn("_late_key", key)).alias("r")
        on = F.expr("r._late_day = c._late_day and r._late_slice = c._late_slice and r._late_us <=> c._late_us and r._late_salt = c._late_salt")
        ids = F.when(F.col("_late_low").isNotNull(), F.floor((key - F.col("_late_low")) / F.col("_late_wide")) + 1)
        got = named.join(cuts.alias("c"), on, "left")
        out.append(got.select(*(F.col(f"r.`{c}`") for c in s.columns), F.coalesce("_late_sub", F.lit(0)).cast("long").alias("_late_sub"), F.coalesce(ids, F.lit(0)).cast("long").alias("_late_ids")))
    return out


def _merged(kept: DataFrame, changes: DataFrame, at: Layout) -> DataFrame:
    """Per slice: stored rows without the outgoing keys, merged in order with the incoming rows; `_late_place` counts from 0."""
    names, key, time = at.schema.names, at.key, at.time
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in at.schema.fields), *(kept.schema[c] for c in _PIECE), T.StructField("_late_place", T.LongType())])

    def merge(group: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        goes = right.filter(right["_late_goes"])[key]
        stays = left.select(names).filter(pc.invert(pc.is_in(left[key], value_set=goes.combine_chunks()))) if len(goes) and len(left) else left.select(names)
        comes = right.filter(pc.invert(right["_late_goes"])).select(names)
        rows = pa.concat_tables([stays, comes.cast(stays.schema)])
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(time, "ascending"), (key, "ascending")], null_placement="at_start"))
        more = {c: pa.array([v.as_py()] * len(rows), v.type) for c, v in zip(_PIECE, group, strict=True)}
        return pa.table([*rows.columns, *more.values(), pa.array(np.arange(len(rows)))], [*names, *more, "_late_place"])

    return kept.groupBy(*_PIECE).cogroup(changes.groupBy(*_PIECE)).applyInArrow(merge, schema)


def _write(rows: DataFrame, at: Layout, path: str) -> None:
    """Merged slices into files: counts of slices, summed up by day and then by slice, place each row in its day."""
    day, part = Window.partitionBy("_late_day").orderBy("_late_slice"), Window.partitionBy("_late_day", "_late_slice").orderBy("_late_sub", "_late_ids")
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n_pieces = rows.groupBy(*_PIECE).agg(F.count("*").alias("n"))
    n_slices = n_pieces.groupBy("_late_day", "_late_slice").agg(F.sum("n").alias("n"))
    starts = n_pieces.withColumn("_late_in", ahead(part)).join(n_slices.withColumn("_late_at", ahead(day)).drop("n"), ["_late_day", "_late_slice"])
    starts = starts.select(*_PIECE, (F.col("_late_in") + F.col("_late_at")).alias("_late_start"))
    placed = rows.join(starts, _PIECE).select(*_cols(at.schema.names), F.col("_late_day").alias("day"), F.expr(f"(_late_start + _late_place) div {at.rows_per_file}").alias("file_no"))
    dealt = placed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "day", "file_no")
    order = [F.col("day"), F.col("file_no"), F.asc_nulls_first(f"`{at.time}`"), F.asc_nulls_first(f"`{at.key}`")]
    dealt.sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).partitionBy("day", "file_no").parquet(path)


def _swap(spark: SparkSession, at: Layout, staged: str, days: list[int]) -> None:
    """Each touched day's folder goes out and its new one, if there is one, comes in; then the old ones are removed."""
    jvm = spark.sparkContext._jvm
    path = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join(p))
    fs = path(at.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = f"{at.path}.old-{uuid.uuid4().hex}"
    fs.mkdirs(path(old))
    for day in days:
        live, new = path(at.path, f"day={day}"), path(staged, f"day={day}")
        if fs.exists(live) and not fs.rename(live, path(old, f"day={day}")):
            raise OSError(f"could not move {live}")
        if fs.exists(new) and not fs.rename(new, live):
            raise OSError(f"could not move {new}")
    fs.delete(path(staged), True)
    fs.delete(path(old), True)


def overwrite(spark: SparkSession, at: Layout, incoming: DataFrame, new: bool = False) -> DataFrame:
    """Bring rows into the layout (new: there is none yet); returns the touched days as a table of `day`.

    The list of touched days, one number a calendar day, is all that reaches the driver.
    """
    names, key = at.schema.names, at.key
    rows = latest(incoming, at)
    if new:
        met = rows.select(*_cols(names), F.lit(None).cast("struct<day:long>").alias("_late_old"), F.lit(False).alias("_late_found"))
    else:
        held = at.files(spark).select(F.col(f"`{key}`").alias("_late_key"), F.lit(True).alias("_late_found"), F.struct(*_cols(names)).alias("_late_old"))
        met = rows.join(held, F.col(f"`{key}`").eqNullSafe(F.col("_late_key")), "left").where(F.col("_late_found").isNull() | (_version(at) > _version(at, "_late_old.")))
        met = met.select(*_cols(names), "_late_old", F.coalesce("_late_found", F.lit(False)).alias("_late_found"))
    met = stored(met, "met")
    comes = met.select(*_cols(names), F.lit(False).alias("_late_goes"))
    if not new:
        comes = comes.unionByName(met.where("_late_found").select(*(F.col(f"_late_old.`{c}`").alias(c) for c in names), F.lit(True).alias("_late_goes")))
    changes = _sliced(comes, at)
    touched = stored(changes.select(F.col("_late_day").alias("day")).distinct(), "days")
    days = sorted(r.day for r in touched.collect())
    kept = incoming.sparkSession.createDataFrame([], at.schema) if new else at.files(spark).where(F.col("day").isin(days)).select(*_cols(names))
    pieces = _pieces([_sliced(kept, at), changes], at)
    merged = stored(_merged(pieces[0].drop("_late_us"), pieces[1].drop("_late_us"), at), "merged")
    if new:
        _write(merged, at, at.path)
    elif days:
        staged = f"{at.path}.new-{uuid.uuid4().hex}"
        _write(merged, at, staged)
        _swap(spark, at, staged, days)
    return touched


def file_digests(spark: SparkSession, at: Layout, touched: DataFrame, amount: str) -> DataFrame:
    """One row for each file that lies there, read in the file's own order and hashed as it streams by.

    cents sums floor(100 * amount + 0.5) (null: 0); rows_crc sums the crc32 of `key:time:arrival`, times
    in microseconds; ids_sha256 hashes the keys, joined by commas; nulls are empty.
    """
    df = at.files(spark)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    key = text(F.col(f"`{at.key}`"))
    rows = df.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), "day", "file_no", key.alias("key"),
        F.coalesce(F.floor(F.col(f"`{amount}`") * 100 + 0.5), F.lit(0)).cast("long").alias("cents"),
        F.crc32(F.concat(key, F.lit(":"), text(micros(df, at.time)), F.lit(":"), text(micros(df, at.arrived)))).alias("crc"),
    )
    schema = "day long, file_no long, n_rows long, cents long, rows_crc long, path string, ids_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, done = None, []

        def row() -> dict:
            return here | {"ids_sha256": here["ids_sha256"].hexdigest()}

        for batch in batches:
            paths = batch.column(0)
            codes = paths.dictionary_encode().indices.to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if here is None or here["path"] != part["path"][0].as_py():
                    if here is not None:
                        done.append(row())
                    here = {"path": part["path"][0].as_py(), "day": part["day"][0].as_py(), "file_no": part["file_no"][0].as_py(), "n_rows": 0, "cents": 0, "rows_crc": 0, "ids_sha256": hashlib.sha256()}
                    lead = ""
                else:
                    lead = ","
                here["ids_sha256"].update((lead + ",".join(part["key"].to_pylist())).encode())
                here["n_rows"] += part.num_rows
                here["cents"] += pc.sum(part["cents"]).as_py()
                here["rows_crc"] += pc.sum(part["crc"]).as_py()
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, _DIGEST)
                done = []
        if here is not None:
            done.append(row())
        if done:
            yield pa.RecordBatch.from_pylist(done, _DIGEST)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = rows.repartition(parts, "path").sortWithinPartitions("path", "at").mapInArrow(run, schema)
    new = touched.select("day", F.lit(True).alias("_new"))
    return out.join(new, "day", "left").select(
        "day", "file_no", "n_rows", "cents", "rows_crc", "path", F.lit(",".join(at.schema.names)).alias("columns"), "ids_sha256", F.coalesce("_new", F.lit(False)).alias("rewritten")
    )


_DIGEST = pa.schema([("day", pa.int64()), ("file_no", pa.int64()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("path", pa.string()), ("ids_sha256", pa.string())])


def with_corrections(sales: DataFrame) -> DataFrame:
    """`sales` and the corrections to some of its rows: total + 1, up to a day later sold, some days later arrived."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    days = lambda n: F.make_dt_interval(days=n.cast("int"))
    day = day_of(micros(sales, "sold_at"))
    later = {"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(F.pmod(h, F.lit(2))), "arrived_at": F.col("arrived_at") + days(1 + F.pmod(h, F.lit(97)))}
    return sales.unionByName(sales.where((F.pmod(h, F.lit(3)) == 0) & (F.pmod(day, F.lit(4)) == 0)).withColumns(later))


def late_sales(sales: DataFrame, since: str = "2024-03-20 00:00:00", files: int = 1100) -> DataFrame:
    """The layout of the rows that arrived before `since`, overwritten by all others; one row a final file.

    Rows without an arrival are among the others.  The layout stays in a new folder of the shared one.
    """
    spark = sales.sparkSession
    path = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    at = Layout(path, T.StructType([T.StructField(f.name, f.dataType) for f in sales.schema.fields]), "sale_id", "sold_at", "arrived_at", 1 + sales.count() // files)
    rows = with_corrections(sales)
    early = F.coalesce(F.col("arrived_at") < F.lit(since).cast(sales.schema["arrived_at"].dataType), F.lit(False))
    overwrite(spark, at, rows.where(early), new=True)
    touched = overwrite(spark, at, rows.where(~early))
    return file_digests(spark, at, touched, "total")
