"""Evaluation of retrieval: precision, recall, reciprocal rank, pattern coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit(found: Column, expected: Column) -> Column:
    """Whether a retrieved item contains any expected part."""
    return F.exists(expected, lambda e: F.contains(found, e))


def precision(found: Column, expected: Column) -> Column:
    n = F.size(F.filter(found, lambda r: hit(r, expected)))
    return F.when(F.size(found) > 0, n / F.size(found)).otherwise(0.0)


def recall(found: Column, expected: Column) -> Column:
    n = F.size(F.filter(expected, lambda e: F.exists(found, lambda r: F.contains(r, e))))
    return F.when(F.size(expected) > 0, n / F.size(expected)).otherwise(1.0)


def reciprocal_rank(found: Column, expected: Column) -> Column:
    places = F.filter(F.transform(found, lambda r, i: F.when(hit(r, expected), i + 1)), lambda i: i.isNotNull())
    return F.when(F.size(places) > 0, 1.0 / F.array_min(places)).otherwise(0.0)


def file_names(paths: Column) -> Column:
    """Distinct base names in the order first seen."""
    return F.array_distinct(F.transform(paths, lambda p: F.element_at(F.split(p, "/"), -1)))


def score(cases: DataFrame) -> DataFrame:
    """cases (id, files, chunk_names, expected_files, expected_chunks) with precision, recall and mrr (the better of both levels)."""
    files, wanted = file_names(F.col("files")), F.col("expected_files")
    return cases.select(
        "id", precision(files, wanted).alias("precision"), recall(files, wanted).alias("recall"),
        F.greatest(reciprocal_rank(files, wanted), reciprocal_rank(F.col("chunk_names"), F.col("expected_chunks"))).alias("mrr"),
    )


def summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("cases"), *(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "mrr")), F.count_if(F.col("recall") >= 0.5).alias("passed"))


def pattern_score(answers: DataFrame, pass_at: float = 0.5) -> DataFrame:
    """answers (id, text, patterns, category, difficulty) with found, missed, score and passed; case does not count."""
    has = lambda p: F.contains(F.lower("text"), F.lower(p))
    rows = answers.withColumn("found", F.filter("patterns", has)).withColumn("missed", F.filter("patterns", lambda p: ~has(p)))
    rows = rows.withColumn("score", F.when(F.size("patterns") > 0, F.size("found") / F.size("patterns")).otherwise(0.0))
    return rows.withColumn("passed", F.col("score") >= pass_at)


def pass_rates(scored: DataFrame) -> DataFrame:
    """(category, difficulty, n, rate) by category, by difficulty and over all, in one aggregation."""
    sets = [[F.col("category")], [F.col("difficulty")], []]
    return scored.groupingSets(sets, "category", "difficulty").agg(F.count("*").alias("n"), F.avg(F.col("passed").cast("double")).alias("rate"))


def gate(rate: float, least: float = 0.6) -> None:
    if rate < least:
        raise AssertionError(f"pass rate {rate:.2f} is under {least}")
