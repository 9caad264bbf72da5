"""Operator 1: token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_count(text: Column, path: str) -> Column:
    """Tokens of each text under the vocabulary at *path*; no ids are made.

    A word's count is its initial symbols minus its merges.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from .word_bpe import load

        bpe = load(path)
        for texts in batches:
            yield pa.array([bpe.count(t.as_py()) for t in texts], pa.int64())

    return count(text)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of *docs*: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts count 0 bytes and 0 tokens; whole texts are counted whatever their length;
    repeated rows are counted each; other columns of *docs*, whatever their names, are not read; a
    null key stays null. An empty table gives an empty result.
    """
    whole = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return whole.select(key, F.octet_length("_t").cast("long").alias("n_bytes"), token_count(F.col("_t"), path).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
