"""The operators' queries over whole tables, with production parameters, and the SQL of those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, licenses, packing, permutation, pieces, quality, secrets, simhash, token_counts, topk
from .common import dealt, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(modulus: int) -> Column:
    """crc32 of the document's id as text, modulo *modulus*."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and whole texts of all documents, dealt out if they are read in fewer parts than there are cores."""
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(texts(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(texts(spark, sf_dir), keep=False)


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(texts(spark, sf_dir), tokenizer("piece_bpe_32k.model"), keep=False)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(texts(spark, sf_dir))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.fit(docs.filter(remainder(3) != 1))
    found = langid.identified(texts(spark, sf_dir), dictionaries)
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "reliable")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(remainder(4) != 2))
    found = quality.scored(texts(spark, sf_dir), model)
    return found.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(texts(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.nearest(table(spark, sf_dir, "embeddings"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(texts(spark, sf_dir), secrets.train(secrets.samples(spark)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_license_scan, op3_pieces, op4_near_duplicates, op5_exact_top_k, op6_language, op7_quality, op8_packing, op9_nearest, op10_secrets)}


ORACLES = {
    "op5_exact_top_k": """
with usable as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
asked as (select distinct on (vec_id) vec_id, v from usable where vec_id % 50 = 0 order by vec_id, v),
scored as (
    select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
    from asked q join usable c on c.vec_id <> q.vec_id and len(c.v) = len(q.v))
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
