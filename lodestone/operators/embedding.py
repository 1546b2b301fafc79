"""Embedding: text templates, a deterministic offline model, and pluggable batch backends."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> function of a list of texts giving a list of vectors.
BACKENDS: dict[str, Callable[[list[str]], list[list[float]]]] = {}


def template(node_type: Column, name: Column, content: Column) -> Column:
    return F.concat(node_type, F.lit(": "), name, F.lit("\n\n"), content)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_embedding(text: Column, dims: int = 384) -> Column:
    """The bytes of the text's sha256, cycled, scaled to [-1, 1] and normalised; all in the JVM."""
    values = _let(F.sha2(text, 256), lambda h: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 * 2 - 1))
    raw = _let(values, lambda v: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.get(v, i % 32)))
    length = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x))
    return _let(raw, lambda r: _let(length(r), lambda n: F.transform(r, lambda x: x / n)))


def register(name: str, backend: Callable[[list[str]], list[list[float]]]) -> None:
    BACKENDS[name] = backend


def embed(chunks: DataFrame, backend: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 10) -> DataFrame:
    """`chunks` with an embedding column; the vectors of a batch whose call fails are null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list = []
            for at in range(0, len(frame), batch):
                part = frame[text].iloc[at : at + batch].tolist()
                try:
                    vectors += backend(part)
                except Exception:  # a remote model's failures are of any kind
                    vectors += [None] * len(part)
            yield frame.assign(embedding=vectors)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInPandas(run, f"{kinds}, embedding array<float>")


def pending(chunks: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Chunks not embedded yet: the resume filter of an interrupted run."""
    return chunks.join(done.select(key), key, "left_anti")
