"""Tables that change together: rows dealt by hash of their key, and a manifest that names the current files.

A commit writes the touched buckets anew beside the old ones and then puts one small file in place,
the next manifest: readers see all tables before it or all after it.  A writer that fails on the way
leaves files that no manifest names.  Two writers that start from the same version cannot both win:
the second finds its manifest's place taken and raises `Conflict`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer committed first; read again and retry."""


@dataclass
class Table:
    """What a manifest holds of a table: its schema, key, and the folder of each bucket that has rows."""

    schema: str
    keys: list[str]
    buckets: int
    folders: dict[str, str] = field(default_factory=dict)


@dataclass
class Change:
    """Rows to put (the greatest `order` of a key wins, stored rows included) and keys to delete; `replace` drops all that was there."""

    keys: Sequence[str]
    put: DataFrame | None = None
    order: str | None = None
    delete: DataFrame | None = None
    replace: bool = False


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, at = _fs(spark, f"{root}/manifest")
    if not fs.exists(at):
        return []
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict[str, Table]]:
    """The tables of a version, by default the last; (0, none) where nothing was committed."""
    known = versions(spark, root)
    if not known:
        return 0, {}
    version = known[-1] if version is None else version
    fs, at = _fs(spark, f"{root}/manifest/{version:09d}.json")
    stream = fs.open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return version, {k: Table(**v) for k, v in json.loads(text).items()}


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame | None:
    """A table as of a version; None where it is not there."""
    table = manifest(spark, root, version)[1].get(name)
    return None if table is None else _rows(spark, root, table, list(table.folders))


def _rows(spark: SparkSession, root: str, table: Table, buckets: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(table.schema))
    paths = [f"{root}/{table.folders[b]}" for b in buckets if b in table.folders]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _bucket(keys: Sequence[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _last(rows: DataFrame, keys: Sequence[str], order: str | None) -> DataFrame:
    if order is None:
        return rows.dropDuplicates(list(keys))
    best = F.max_by(F.struct(*rows.columns), F.struct(order, F.xxhash64(*rows.columns)))  # equal orders: one winner, whichever way they come
    return rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(best.alias("_row")).select("_row.*")


def _staged(spark: SparkSession, root: str, name: str, old: Table | None, change: Change) -> Table:
    """Write the touched buckets; other buckets are not read."""
    keys = list(change.keys)
    if old is not None and old.keys != keys:
        raise ValueError(f"{name} has the key {old.keys}")
    like = change.put if change.put is not None else None
    if old is None and like is None:
        raise ValueError(f"{name} is not there")
    schema = like.schema if old is None else T.StructType.fromJson(json.loads(old.schema))
    table = Table(json.dumps(schema.jsonValue()), keys, old.buckets if old else BUCKETS, dict(old.folders) if old and not change.replace else {})
    own = change.put.select(*schema.names) if change.put is not None else spark.createDataFrame([], schema)
    own = _last(own, keys, change.order).withColumn("_bucket", _bucket(keys, table.buckets))
    gone = change.delete.select(*keys).distinct().withColumn("_bucket", _bucket(keys, table.buckets)) if change.delete is not None else None
    hit = own.select("_bucket") if gone is None else own.select("_bucket").union(gone.select("_bucket"))
    touched = sorted(r[0] for r in hit.distinct().collect())  # numbers of buckets
    held = _rows(spark, root, table, [str(b) for b in touched]).withColumn("_bucket", _bucket(keys, table.buckets))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    if gone is not None:
        held = held.alias("l").join(gone.alias("r"), same, "left_anti")
    if change.order is None:
        merged = held.alias("l").join(own.alias("r"), same, "left_anti").unionByName(own)
    else:
        merged = _last(held.unionByName(own), keys, change.order)
    folder = f"data/{name}/{uuid.uuid4().hex}"
    merged.repartition("_bucket").sortWithinPartitions("_bucket").write.partitionBy("_bucket").parquet(f"{root}/{folder}")
    fs, at = _fs(spark, f"{root}/{folder}")
    written = {s.getPath().getName().partition("=")[2] for s in fs.listStatus(at) if s.isDirectory()}
    for b in map(str, touched):
        table.folders.pop(b, None)
        if b in written:
            table.folders[b] = f"{folder}/_bucket={b}"
    return table


def commit(spark: SparkSession, root: str, changes: Mapping[str, Change], base: int | None = None) -> int:
    """Apply changes to all tables at once; returns the new version.  `base`: the version that the writer has read."""
    last, tables = manifest(spark, root)
    if base is not None and base != last:
        raise Conflict(f"version {last} is there, the writer has read {base}")
    tables = tables | {name: _staged(spark, root, name, tables.get(name), change) for name, change in changes.items()}
    fs, final = _fs(spark, f"{root}/manifest/{last + 1:09d}.json")
    _, temporary = _fs(spark, f"{root}/manifest/.{uuid.uuid4().hex}")
    stream = fs.create(temporary, False)
    try:
        stream.write(bytearray(json.dumps({k: vars(v) for k, v in tables.items()}).encode()))
    finally:
        stream.close()
    if fs.exists(final) or not fs.rename(temporary, final):
        fs.delete(temporary, False)
        raise Conflict(f"version {last + 1} was committed meanwhile")
    return last + 1


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete data folders that none of the last `keep` manifests names, and the older manifests; how many folders went."""
    known = versions(spark, root)
    used = {f for v in known[-keep:] for t in manifest(spark, root, v)[1].values() for f in t.folders.values()}
    gone = 0
    for v in known[:-keep]:
        for table in manifest(spark, root, v)[1].values():
            for f in set(table.folders.values()) - used:
                fs, at = _fs(spark, f"{root}/{f}")
                gone += bool(fs.delete(at, True))
        fs, at = _fs(spark, f"{root}/manifest/{v:09d}.json")
        fs.delete(at, False)
    return gone
