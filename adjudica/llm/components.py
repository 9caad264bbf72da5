"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, few, staged


def _starred(links: DataFrame, both: bool, rows: int) -> tuple[DataFrame, str]:
    """One step. *links*: (a, b), a > b. Large (*both*): greater neighbours of each node go to its least
    neighbour; small: a node and its lesser neighbours do.

    The minima come from a partially aggregated groupBy and are written before they are joined, so
    the join has a shuffle on either side and the adaptive planner can split the one of a hot centre.
    """
    if both:
        links = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least, path = staged(few(links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), rows), "least")
    met = links.join(least, "a")
    if both:
        made = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return made.filter("a <> b").distinct(), path


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component): the least node that each node of *links* (a, b: long, either order; about *rows*, if that is known) reaches.

    Nodes without a link to another node have no row. Every step's links are written to the shared
    folder, and steps go on until one changes nothing; nothing is gathered on the driver but a count and
    a checksum.
    """
    spark = links.sparkSession
    pairs = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, path = staged(pairs if rows is None else few(pairs, rows), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum((F.xxhash64("a", "b") % 1_000_000_007))).first()
        if mark == before or not mark[0]:
            break
        before, rows = mark, mark[0]
        large, minima = _starred(now, True, rows)
        large, between = staged(few(large, rows), "large")
        small, others = _starred(large, False, rows)
        now, later = staged(few(small, rows), "links")
        for old in (path, minima, between, others):
            discard(spark, old)
        path = later
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
