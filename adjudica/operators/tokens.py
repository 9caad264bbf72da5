"""Token tables: one row per token, from the kernel's words; everything else starts from arrays within a row, so no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenized
from ..kernels.text import BASIC_SKELETONS, Config


def token_lists(docs: DataFrame, key: str, text: str, config: Config = Config(), skeletons: dict[str, str] = BASIC_SKELETONS) -> DataFrame:
    """(doc, tokens): the tokens of each row's canonical text as an array, in order; null where there is no text or it is refused."""
    return docs.select(F.col(key).alias("doc"), tokenized(F.col(text), config, skeletons).alias("tokens"))


def all_tokens(docs: DataFrame, key: str, text: str, config: Config = Config(), skeletons: dict[str, str] = BASIC_SKELETONS) -> DataFrame:
    """(doc, pos, word, start, end, span, zone, sentence, confusable, skeleton): every token of canonical texts, in protected spans too."""
    each = token_lists(docs, key, text, config, skeletons).select("doc", F.explode("tokens").alias("t"))
    return each.select("doc", "t.pos", F.col("t.text").alias("word"), "t.start", "t.end", "t.span", "t.zone", "t.sentence", "t.confusable", "t.skeleton")


def tokens(docs: DataFrame, key: str, text: str, config: Config = Config(), skeletons: dict[str, str] = BASIC_SKELETONS) -> DataFrame:
    """The free tokens that are no look-alikes (doc, sentence, pos, word), and where they come from."""
    return all_tokens(docs, key, text, config, skeletons).filter("zone is null and confusable is null").select("doc", "sentence", "pos", "word", "span")


def sentence_count(canonical: Column) -> Column:
    return F.regexp_count(canonical, F.lit("[.!?] ")) + 1
