"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fingerprints import against_next
from .gif import store_bytes
from .jaccard_join import similarity_components
from .language_id import identify
from .late_rows import late_sales
from .packing import pack
from .personal_data import digest as personal_digest
from .personal_data import personal_spans
from .quality import classify, trusted_ids
from .repeats import remove_repeats
from .resampling import resample
from .secret_scan import corpus_words, digest, secret_spans
from .sentence_pieces import encode_decode
from .token_counts import token_counts


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), trusted_ids(table(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(secret_spans(docs, words=corpus_words(docs)))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), digests=True)


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_bytes(table(spark, sf_dir, "documents"))


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_next(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digest(personal_spans(table(spark, sf_dir, "documents")))


def op13_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_sales(table(spark, sf_dir, "sales"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_token_counts,
        op3_secret_scan,
        op4_jaccard_join,
        op5_sentence_pieces,
        op6_gif_media,
        op7_bottom_k,
        op8_language_id,
        op9_packing,
        op10_repeats,
        op11_resampling,
        op12_personal_data,
        op13_late_rows,
    )
}

#: All words, shingle sets, pairs and reachable documents, without any shortcut.
JACCARD_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), each AS (SELECT doc_id, unnest(s) AS x FROM shingles
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN shingles p ON p.doc_id = a JOIN shingles q ON q.doc_id = b WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id, doc_id AS other FROM shingles UNION SELECT edges.b, reach.other FROM reach JOIN edges ON edges.a = reach.doc_id
), copies AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN count(*) OVER (PARTITION BY md5(array_to_string(list_sort(s), chr(10)))) ELSE 1 END AS n_copies FROM shingles)
SELECT shingles.doc_id, len(s) AS n_shingles, min(other) AS component_id, any_value(n_copies) AS n_copies
FROM shingles JOIN reach ON reach.doc_id = shingles.doc_id JOIN copies ON copies.doc_id = shingles.doc_id GROUP BY shingles.doc_id, len(s)
"""

#: crc32 as a fold over the bytes of each distinct word, with its table made by eight steps a byte value.
RESAMPLING_SQL = """
WITH crc AS (SELECT list(list_reduce([v] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY v) AS t FROM range(256) r(v)
), words AS (
  SELECT false AS aim, doc_id, unnest(w) AS w FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)
  UNION ALL
  SELECT true, NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark
), hashed AS (
  SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, len(h), 2), lambda i: (strpos('0123456789ABCDEF', h[i]) - 1) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 1), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)), crc
), counts AS (
  SELECT bucket, count(*) FILTER (NOT aim) AS s, count(*) FILTER (aim) AS t FROM words JOIN hashed USING (w) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(g, 0)::BIGINT AS weight, coalesce(g, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(gain) AS g FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE NOT aim GROUP BY doc_id) USING (doc_id)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank,
  n_features AS n_words, n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) AS drawn
FROM ranked
"""

ORACLE_SQL: dict[str, str] = {"op4_jaccard_join": JACCARD_SQL, "op11_resampling": RESAMPLING_SQL}
