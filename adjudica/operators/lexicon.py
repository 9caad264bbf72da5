"""Dictionary operators over tables of texts: hits, flags, typo repair, word overlap.

Words come from the kernel, which scans a text in one pass where it lies; what leaves it are hits, so there is no shuffle between
texts and hits. A lexicon is a compiled specification that goes along with the function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lexicon_lookup, repaired
from ..kernels.lexicon import MIN_REPAIR_CHARS, Lexicon
from ..kernels.text import BASIC_SKELETONS


def hits(docs: DataFrame, key: str, text: str, lexicon: Lexicon, skeletons: dict[str, str] = BASIC_SKELETONS) -> DataFrame:
    """(doc, term, tag, start, end, span, kind, edits, penalty): the hits of each text's scan from left to right; null and refused texts have none."""
    found = docs.select(F.col(key).alias("doc"), lexicon_lookup(F.col(text), lexicon, skeletons)["hits"].alias("h"))
    return found.select("doc", F.inline("h"))


def flags(docs: DataFrame, key: str, text: str, lexicon: Lexicon, skeletons: dict[str, str] = BASIC_SKELETONS) -> DataFrame:
    """(doc, term, token, span, kind): look-alikes of terms."""
    found = docs.select(F.col(key).alias("doc"), lexicon_lookup(F.col(text), lexicon, skeletons)["flags"].alias("f"))
    return found.select("doc", F.inline("f"))


def repairs(words: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(word, term, edits): each distinct word that is no term or guard, with the single-word term of the least repair cost.

    Words too short, or longer than the longest term by more than two, can't be repaired and go before the shuffle that makes the
    rest distinct; each of those is repaired once, by the terms with which it shares a deletion.
    """
    usable = words.select("word").filter((F.length("word") >= MIN_REPAIR_CHARS) & (F.length("word") <= lexicon.longest + 2)).distinct()
    return usable.withColumn("_r", repaired(F.col("word"), lexicon)).filter("_r is not null").select("word", "_r.term", "_r.edits")


def overlap(query: Column, candidate: Column) -> Column:
    """Thousandths of a candidate's words (an array of distinct ones) that a query has; 0 for an empty candidate."""
    n = F.size(candidate)
    return F.when(n > 0, F.call_function("div", F.size(F.array_intersect(query, candidate)) * 1000, n)).otherwise(0).cast("int")


def overlaps(queries: DataFrame, candidates: DataFrame, least: int = 1) -> DataFrame:
    """(doc, candidate, c): all pairs of at least *least* thousandths, of queries (doc, words) and candidates (candidate, words), arrays of distinct words.

    A pair that reaches *least* shares k = ceil(least * n / 1000) of the candidate's n words, so at least one of any n - k + 1 of them.
    Candidates are posted under the n - k + 1 of their words that the fewest queries have (words that no query has
    count as rarest), so a common word joins little; pairs that meet are then compared exactly. Counting queries by word combines map-side.
    """
    if not 1 <= least <= 1000:
        raise ValueError("least is from 1 to 1000")
    have = queries.select("doc", F.explode("words").alias("word"))
    wanted = candidates.filter(F.size("words") > 0).select("candidate", "words", F.posexplode("words").alias("_i", "word"))
    used = wanted.select("word").distinct()
    often = have.join(used, "word", "left_semi").groupBy("word").agg(F.count("*").alias("often"))
    ranked = wanted.join(often, "word", "left").groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "word"))).alias("w"))
    need = F.ceil(F.size("w") * least / F.lit(1000)).cast("int")
    posted = ranked.select("candidate", F.explode(F.slice("w", F.lit(1), F.size("w") - need + 1)).alias("x")).filter("x.often > 0").select("candidate", "x.word")
    pairs = have.join(posted, "word").select("doc", "candidate").distinct()
    both = pairs.join(candidates.select("candidate", F.col("words").alias("_c")), "candidate").join(queries.select("doc", F.col("words").alias("_q")), "doc")
    return both.select("doc", "candidate", overlap(F.col("_q"), F.col("_c")).alias("c")).filter(F.col("c") >= least)
