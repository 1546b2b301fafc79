"""A corpus pipeline of five stages; each works on all that its predecessor kept.

quality: documents that the n-gram classifier rejects go.  near_copies: the least id of each group of
near copies stays.  repeats: bytes under 100-byte strings that also start earlier go, and documents
that lose all their text.  secrets: spans of secrets are replaced by a mark.  packing: the rest is
packed into sequences of 2048 tokens.  Null texts count as empty in every stage; an empty documents
table gives no pieces.  Rows with one id are one document, of which each text stays once; rows with a
null id are judged each and all stay.  Columns beside doc_id and text may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.jaccard_join import BROADCAST_IDS, similarity_components
from lodestone.llm.packing import pack
from lodestone.llm.quality import classify, trusted_ids
from lodestone.llm.queries import vocabulary
from lodestone.llm.repeats import remove_repeats
from lodestone.llm.secret_scan import corpus_words, secret_spans
from lodestone.llm.spark import marked, release, stored

SECRET_MARK = "[secret]"


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose key is not among `ids`; these are broadcast only up to a checked number."""
    ids = stored(ids.select(key).distinct(), "dropped")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_anti").select(*docs.columns)


def others(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c not in ("doc_id", "text")]


def free(docs: DataFrame, name: str) -> str:
    """A name that no column of `docs` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """`out` with the columns of documents in their order; n_chars follows the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by id and text, so that those with null or shared ids are judged each."""
    row = free(docs, "_row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    trusted = keyed.join(trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")), "doc_id", "left_semi").select(row)
    scores = classify(keyed, trusted, id_col=row)
    return without(keyed, scores.where("not keep").select(F.col("doc_id").alias(row)), row).drop(row)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = stored(similarity_components(docs), "groups")
    firsts = without(docs, groups.where("doc_id <> component_id"))
    repeated = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return firsts
    # rows with one id are one document: none of its texts goes, and none stays twice
    once = firsts.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return without(firsts, repeated).unionByName(once)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_repeats(docs, keep=others(docs))
    return like(docs, cut.where("n_removed = 0 or text <> ''"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return like(docs, secret_spans(docs, words=corpus_words(docs), keep=others(docs), redact=SECRET_MARK))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("secrets", secrets), ("packing", packing)]

#: SQL can express neither the n-gram model nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of `sf_dir`, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = marked()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
            release(since, docs)  # the stage's own tables, and its input
    return docs
