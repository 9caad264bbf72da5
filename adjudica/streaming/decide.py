"""The classifier over streams: each message is decided by itself, so the batch expression runs unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import classified
from ..kernels.classifier import Classifier


def decide_stream(messages: DataFrame, classifier: Classifier, text: str = "text", profile: str = "standard") -> DataFrame:
    """Adds *decision* to a streaming or batch DataFrame."""
    return messages.withColumn("decision", classified(F.col(text), classifier, F.lit(profile)))


def counts_by_window(decided: DataFrame, time: str, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Decisions per window and label, with a watermark for late rows."""
    return decided.withWatermark(time, late).groupBy(F.window(time, length), F.col("decision.label").alias("label")).agg(F.count("*").alias("n"))
