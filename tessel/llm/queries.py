"""The operators' registered queries: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan, mixing, mpeg_audio, near_dup, packing, suffix_dedup, token_count, topk, toxicity, url_filter

#: (host, path, action): the rules of the URL filter query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learned from labelled rows that are not held out.

    Null and empty texts have no clause and score lowest, very long ones are read whole, rows that repeat an id get a row each; without documents there are no
    rows, without labels the seeds decide.
    """
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, grammar).select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted", "clauses")


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its set of 4-word shingles and the component that links of 0.8 or more make.

    Null and empty texts have no shingles and are linked with nothing; of rows that repeat an id each gets a row, with the id's component; a null id has no
    component and is kept.
    """
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that a mix of sources weighing 1, 2, 3 in turn takes of it.

    Null and empty texts have size 0, a null source is a source of its own and last; rows with null or repeated ids are drawn each by itself.
    """
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, longest-match pieces and bytes of every document; null and empty texts have none, repeated rows are counted each."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of token sequences that hold all documents' ids, each document closed by id 2.

    A null or empty text is the closing id alone; rows with null or repeated ids are packed each by itself; a very long text fills sequences of its own.
    """
    path = tokenizer_path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), lambda: packing.WordEncoder(path, 2))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes, and what is left of them without 100-byte strings that start earlier.

    Null texts are empty, rows with a null id take no part and keep all; rows that repeat an id are one document if their texts are the same.
    """
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path and verdict by URL_RULES; null and malformed URLs have neither host nor path and get the default, repeated rows are judged alike."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest and the licence whose whole text it is; null and empty texts have neither, repeated rows are looked up each."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as MPEG audio and read back, with digests and what the parser found.

    Null and empty texts are one frame of spaces, a very long text as many frames as it takes; equal texts have equal values, also in repeated rows.
    """
    m = mpeg_audio.media(table(spark, sf_dir, "documents"), keep_media=False)
    parts = ["tag", "frames", "table_frames", "duration_num", "duration_den", "crc_checked", "crc_bad", "skipped", "seek_crc32"]
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{p}="), F.col(p).cast("string")) for p in parts])
    return m.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of each query (ids divisible by 20) with all other vectors.

    Null vectors and such with null or non-finite components take no part; vectors of different lengths raise ValueError; repeated ids are candidates each.
    """
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("id % 20 = 0"), 20)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_near_dup, op3_mixing, op4_token_counts, op5_packing, op6_suffix_dedup, op7_url_filter, op8_license_scan, op9_mpeg_audio, op10_topk)}

ORACLE_SQL = {
    "op7_url_filter": r"""
WITH p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)""",
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id != c.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 20""",
}
