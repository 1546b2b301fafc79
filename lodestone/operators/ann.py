"""An inverted-file index: vectors in lists by their nearest centroid, of which a search reads a few.

Centroids are fitted on a bounded sample, every row is in exactly one list, and the index is a table
partitioned by list, so that a search's filter prunes the folders it reads.  Candidates are ranked by
their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nearest

#: Rows that centroids are fitted on at most, rounds of fitting, lists at most, and rows of a file of the index.
SAMPLE, ROUNDS, MOST_LISTS, FILE_ROWS = 200_000, 12, 4096, 1_000_000
#: Share of the exact answers that a search is tuned to find, and rows that this is measured on.
TARGET, TUNING_ROWS = 0.98, 500
#: The list of rows without a vector, and that of vectors of length 0.
NO_VECTOR, NO_LENGTH = -1, 0


def _n_lists(n: int) -> int:
    """The square root of the rows, within bounds."""
    return max(1, min(MOST_LISTS, round(n**0.5)))


def centroids(store: DataFrame, key: str, vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Spherical k-means: at most `lists` unit vectors, fitted on `sample` rows (about, chosen by a hash of the key)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    usable = store.where(F.exists(vector, lambda x: x != 0)).select(key, vector)
    n = usable.count()
    if not n:
        return np.zeros((0, 0))
    some = usable if n <= sample else usable.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    rows = some.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=max(2, lists or _n_lists(n)), distanceMeasure="cosine", initMode="k-means||", maxIter=ROUNDS, seed=seed).fit(rows)
    found = np.array(model.clusterCenters())
    return found / np.maximum(np.sqrt((found * found).sum(1)), 1e-300)[:, None]


def assigned(store: DataFrame, centers: np.ndarray, vector: str = "embedding", n: int = 1) -> DataFrame:
    """The rows with `_lists`, the numbers of their n nearest centroids, nearest first; ties go to the lower number."""
    given = store.sparkSession.sparkContext.broadcast(centers)  # lists x dimension
    names = store.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = given.value
        for batch in batches:
            col = batch.column(names.index(vector))
            there = np.flatnonzero(np.asarray(col.is_valid()))
            out = [[NO_VECTOR]] * batch.num_rows
            if len(there) and len(centers):
                rows = nearest.matrix(col.take(pa.array(there)), centers.shape[1])
                best = np.argsort(-(rows @ centers.T), axis=1, kind="stable")[:, :n]
                for i, own in zip(there.tolist(), best.tolist(), strict=True):
                    out[i] = own
            elif len(there):
                for i in there.tolist():
                    out[i] = [NO_LENGTH]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*names, "_lists"])

    return store.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in store.schema.fields) + ", _lists array<int>")


def indexed(store: DataFrame, centers: np.ndarray, vector: str = "embedding") -> DataFrame:
    """The rows with `list`, the one list that each is in."""
    return assigned(store, centers, vector).withColumn("list", F.element_at("_lists", 1)).drop("_lists")


def build(store: DataFrame, path: str, key: str, vector: str = "embedding", lists: int | None = None, sample: int = SAMPLE) -> None:
    """Write the index of all rows to `path`: `lists` (partitioned) and `centroids`.

    A large list is written by as many tasks as its rows ask for.
    """
    spark = store.sparkSession
    centers = centroids(store, key, vector, lists, sample)
    parts = max(1, -(-store.count() // FILE_ROWS))  # of the largest list, if it had all rows
    dealt = indexed(store, centers, vector).repartition("list", F.pmod(F.xxhash64(key), F.lit(parts))).sortWithinPartitions("list")
    dealt.write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(centers)], "number int, center array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """The indexed rows with their list, and the centroids (`MOST_LISTS` at most)."""
    centers = [r.center for r in spark.read.parquet(f"{path}/centroids").orderBy("number").collect()]
    return spark.read.parquet(f"{path}/lists"), np.array(centers) if centers else np.zeros((0, 0))


def search(index: DataFrame, centers: np.ndarray, queries: DataFrame, k: int, key: str, query_key: str, vector: str = "embedding", probes: int = 8, min_score: float | None = None) -> DataFrame:
    """(query_key, key, score, rank): the k nearest rows among the `probes` nearest lists of each query.

    With as many probes as lists the result is exact.  Of a stored index only the probed lists' folders are read.
    """
    asked = nearest.kept(queries, query_key, vector)
    chosen = assigned(asked, centers, "_vector", probes)
    n, size = asked.agg(F.count("*"), F.coalesce(F.max(F.size("_vector")), F.lit(0))).first()
    schema, names = nearest.answers(index, queries, key, query_key), [query_key, key, "score"]
    if n * size <= nearest.BROADCAST_NUMBERS:
        table = chosen.toArrow()
        lists = [[] for _ in range(max(1, len(centers)))]
        for i, own in enumerate(table.column("_lists").to_pylist()):
            for number in own:
                lists[number].append(i)
        probed = [number for number, own in enumerate(lists) if own]
        rows = nearest.kept(index.where(F.col("list").isin(probed)), key, vector, "list")
        found = nearest.handed_out(rows, table.select([query_key, "_vector"]), schema, names, k, min_score, [np.array(own, np.int64) for own in lists])
    else:
        exploded = chosen.select(query_key, "_vector", F.explode("_lists").alias("_list"))
        rows = nearest.kept(index, key, vector, F.col("list").alias("_list"))
        found = nearest.grid(rows, exploded, schema, names, k, min_score, size, key, query_key)
    return nearest.ranked(found, k, key, query_key)


def probes_for(index: DataFrame, centers: np.ndarray, key: str, vector: str = "embedding", k: int = 10, target: float = TARGET, sample: int = TUNING_ROWS) -> int:
    """The least number of probes with which `target` of the k nearest rows are found, measured on `sample` rows (about) of the index.

    One exact scan: an answer is found once its list is among those probed, so the places of the
    answers' lists in each query's order give the recall of every number of probes.
    """
    n = index.count()
    some = index.where(F.pmod(F.xxhash64(key, F.lit("tuning")), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30)))
    asked = some.select(F.col(key).alias("_asked"), F.col(vector).alias("_about"))
    exact = nearest.batch_top_k(index, asked.withColumnRenamed("_about", vector), k + 1, key, "_asked", vector)
    order = assigned(asked, centers, "_about", max(1, len(centers))).select("_asked", "_lists")
    met = exact.where(F.col("_asked") != F.col(key)).join(index.select(key, "list"), key).join(order, "_asked")
    places = met.groupBy(F.array_position("_lists", F.col("list")).alias("place")).agg(F.count("*").alias("n")).orderBy("place").collect()  # one row a place
    total, seen = sum(r.n for r in places), 0
    for r in places:
        seen += r.n
        if seen >= target * total:
            return max(1, int(r.place))
    return max(1, len(centers))


def recall(found: DataFrame, exact: DataFrame, key: str, query_key: str) -> DataFrame:
    """(queries, wanted, hits, recall): how many of the exact answers were found."""
    hits = exact.select(query_key, key).join(found.select(query_key, key, F.lit(1).alias("_hit")), [query_key, key], "left")
    out = hits.agg(F.count_distinct(query_key).alias("queries"), F.count("*").alias("wanted"), F.count("_hit").alias("hits"))
    return out.withColumn("recall", F.when(F.col("wanted") == 0, F.lit(1.0)).otherwise(F.col("hits") / F.col("wanted")))
