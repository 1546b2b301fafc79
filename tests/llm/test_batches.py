"""Arrow batches to the Python workers are bounded by their bytes."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm.spark import id_text, stored

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def session(spark):
    return spark.newSession()  # confs of its own


def sizes(rows):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "n"])

    return [tuple(r) for r in rows.mapInArrow(run, "bytes long, n long").collect()]


def long_texts(session):
    return session.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100_000).alias("text"))


@pytest.mark.parametrize("way", ["id_text", "stored"])
def test_batches_of_long_texts_are_small(session, way):
    docs = long_texts(session)
    found = sizes(id_text(docs, "doc_id", "text") if way == "id_text" else stored(docs, "docs"))
    assert max(b for b, _ in found) < 5 << 20
    assert sum(n for _, n in found) == 200


def test_limit_of_the_session_stays(session):
    session.conf.set(LIMIT, "1m")
    assert max(b for b, _ in sizes(id_text(long_texts(session), "doc_id", "text"))) < 2 << 20
    assert session.conf.get(LIMIT) == "1m"
