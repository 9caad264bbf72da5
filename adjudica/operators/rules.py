"""Cue rules over tables of texts: matches, class scores, decisions.

The kernel matches a text's rules in one pass, with questions, negation, look-alikes and repaired words; only its matches become
rows, so there is no shuffle between texts and matches, and no sentence is gathered anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rule_scores
from ..kernels.lexicon import Lexicon
from ..kernels.rules import RuleSet
from ..kernels.text import BASIC_SKELETONS
from . import decide


def scored(docs: DataFrame, key: str, text: str, rules: RuleSet, lexicon: Lexicon | None = None, skeletons: dict[str, str] = BASIC_SKELETONS) -> DataFrame:
    """(doc, scores, matches) of each text that is not refused; *scores* holds one confidence per class."""
    made = docs.select(F.col(key).alias("doc"), rule_scores(F.col(text), rules, lexicon, skeletons).alias("s"))
    return made.filter("s.scores is not null").select("doc", "s.scores", "s.matches")


def matches(docs: DataFrame, key: str, text: str, rules: RuleSet, lexicon: Lexicon | None = None, skeletons: dict[str, str] = BASIC_SKELETONS) -> DataFrame:
    """(doc, pos, rule, class, start, end, span, status, question, penalty, effective): all matches, *pos* being the place in the order of matches."""
    found = scored(docs, key, text, rules, lexicon, skeletons).select("doc", F.posexplode("matches").alias("pos", "m"))
    return found.select("doc", "pos", "m.*")


def class_scores(found: DataFrame, rules: RuleSet) -> DataFrame:
    """(doc, class, option, c) from matches: each class's score by its scorer, where it has a match; combined map-side."""
    table = found.sparkSession.createDataFrame([(c.name, i, c.scorer) for i, c in enumerate(rules.classes)], "class string, option int, scorer string")
    both = found.groupBy("doc", "class").agg(F.max("effective").alias("top"), F.sum("effective").alias("sum"))
    scores = F.when(F.col("scorer") == "max", F.col("top")).otherwise(F.least(F.lit(1000), F.col("sum")))
    # a rule set has few classes
    return both.join(F.broadcast(table), "class").select("doc", "class", "option", scores.cast("int").alias("c"))


def decisions(docs: DataFrame, key: str, text: str, rules: RuleSet, lexicon: Lexicon | None = None, profile: str = "standard", skeletons: dict[str, str] = BASIC_SKELETONS) -> DataFrame:
    """(doc, scores, answer): the gate over each text's class scores, without a shuffle."""
    return decide.decide(scored(docs, key, text, rules, lexicon, skeletons).drop("matches"), profile)
