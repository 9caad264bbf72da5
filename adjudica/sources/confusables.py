"""The full table of look-alikes, from the Unicode library that the JVM brings along."""

from __future__ import annotations

import unicodedata

from pyspark.sql import SparkSession


def skeletons(spark: SparkSession) -> dict[str, str]:
    """Characters and what each looks like, where that differs; taken on the driver in one call, to go along with UDFs."""
    chars = [c for c in map(chr, [*range(0x20, 0xD800), *range(0xE000, 0x20000)]) if unicodedata.category(c)[0] in "LNPS"]
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    shown = checker.getSkeleton(0, "\u0001".join(chars)).split("\u0001")
    if len(shown) != len(chars):
        raise RuntimeError("the table of look-alikes can't be read")
    return {c: s for c, s in zip(chars, shown) if unicodedata.normalize("NFD", c) != s}
