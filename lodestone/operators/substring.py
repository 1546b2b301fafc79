"""Substring search by an index of trigrams: postings lists are intersected by counts, candidates verified.

Both the postings and the rows lie in buckets by hash, so that a search reads the buckets of its own
trigrams and then those of its candidates.  A needle of fewer than three characters is searched by
scan.  Case is ignored; null texts match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: Three code points ahead of any place, so that one walk over a text gives all its trigrams.
_TRIGRAM = r"(?=(\P{Cs}{3}))"


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_TRIGRAM), F.lit(1)))


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def build(rows: DataFrame, path: str, key: str, texts: list[str], buckets: int = BUCKETS) -> None:
    """Write the postings (gram, key) of all given text columns and the rows to `path`.

    A common trigram has a posting for each row that has it, over as many files as tasks wrote them.
    """
    grams = F.array_distinct(F.flatten(F.array(*(trigrams(F.coalesce(F.col(t), F.lit(""))) for t in texts))))
    posted = rows.select(F.col(key).alias("key"), F.explode(grams).alias("gram")).withColumn("bucket", _bucket(F.col("gram"), buckets))
    spread = F.pmod(F.xxhash64("key"), F.lit(4))  # a bucket's files are sorted by trigram, for the statistics of their row groups
    posted.repartition("bucket", spread).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")
    held = rows.withColumn("bucket", _bucket(F.col(key), buckets))
    held.repartition("bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(key, texts, buckets)], "key string, texts array<string>, buckets int").coalesce(1).write.json(f"{path}/about")


def candidates(spark: SparkSession, path: str, needle: str) -> DataFrame | None:
    """Keys of the rows that have all trigrams of the needle; None where it is too short for the index."""
    about = spark.read.json(f"{path}/about").first()
    low = needle.lower()
    grams = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    if not grams:
        return None
    asked = spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", _bucket(F.col("gram"), about.buckets).alias("b")).collect()
    postings = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(sorted({r.b for r in asked})) & F.col("gram").isin(grams))
    held = postings.groupBy("key").agg(F.count_distinct("gram").alias("n"))  # rows may share a key
    return held.where(F.col("n") == len(grams)).select("key")


def search(spark: SparkSession, path: str, needle: str) -> DataFrame:
    """The indexed rows of which a text column holds the needle."""
    about = spark.read.json(f"{path}/about").first()
    rows = spark.read.parquet(f"{path}/rows")
    holds = F.lit(False)
    for t in about.texts:
        holds = holds | F.coalesce(F.contains(F.lower(t), F.lit(needle.lower())), F.lit(False))
    found = candidates(spark, path, needle)
    if found is None:
        return rows.where(holds).drop("bucket")
    found = found.withColumn("bucket", _bucket(F.col("key"), about.buckets)).persist()
    buckets = sorted(r.bucket for r in found.select("bucket").distinct().collect())  # numbers of buckets
    met = rows.where(F.col("bucket").isin(buckets)).join(found.drop("bucket"), F.col(about.key) == F.col("key"), "left_semi")
    return met.where(holds).drop("bucket")
