"""Source files from a directory tree, without ignored folders and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import SUPPORTED, extension

# Folders and files that a scan leaves out.
IGNORED_FOLDERS = ("node_modules", ".git", ".next", "dist", "build", "coverage", ".turbo", ".cache", "__pycache__", "venv", ".venv", "vendor", ".idea", ".vscode", "target", "out", ".output")
IGNORED_FILES = (".DS_Store", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "go.sum")


def wanted(paths: DataFrame, extensions: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """Rows whose relative filepath is under no ignored folder, is no ignored file and has an extension, in its case."""
    parts = F.split("filepath", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return paths.where(~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_FOLDERS))) & ~F.element_at(parts, -1).isin(*IGNORED_FILES) & extension(F.col("filepath")).isin(*extensions))


def scan(spark: SparkSession, root: str, repository_id: str, extensions: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """(repository_id, filepath, content) of the wanted files below a directory, paths relative to it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    plain = root.split("://", 1)[-1].rstrip("/")
    relative = F.regexp_replace(F.regexp_extract("path", "^(?:[a-z0-9]+:)?(/.*)$", 1), "^/*" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in plain.replace("//", "/")) .replace("/", "/+").lstrip("/+") + "/+", "")
    rows = rows.select(F.lit(repository_id).alias("repository_id"), relative.alias("filepath"), "content")
    return wanted(rows, extensions).withColumn("content", F.decode("content", "UTF-8"))
