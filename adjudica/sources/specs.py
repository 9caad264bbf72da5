"""Classifier specifications from TOML or JSON files, by any path that Spark can read."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..kernels.classifier import Classifier, lexicon_spec, rules_spec
from ..kernels.lexicon import Lexicon
from ..kernels.rules import RuleSet
from ..kernels.text import Config


def _read(spark: SparkSession, path: str) -> tuple[str, str]:
    return spark.read.text(path, wholetext=True).first()[0], "json" if path.endswith(".json") else "toml"


def load_classifier(spark: SparkSession, lexicon: str, rules: str, domain: str, question: str, config: Config = Config(), on_confusable: str = "abstain", skeletons: dict[str, str] | None = None) -> Classifier:
    """Compiled on the driver; unknown fields and whatever breaks a rule of the specification are refused."""
    return Classifier(domain, question, Lexicon(**lexicon_spec(*_read(spark, lexicon)), config=config), RuleSet(**rules_spec(*_read(spark, rules)), config=config), config, on_confusable, skeletons)
