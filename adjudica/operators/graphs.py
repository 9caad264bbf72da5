"""Colour refinement of graphs held as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import graph as kernel
from ..sources.staging import discard, staged

#: Classes up to this many are broadcast when nodes learn theirs; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def adjacency(edges: DataFrame) -> DataFrame:
    """(v, u, has, label, way) from edges (a, b, label, directed): undirected ones both ways (a loop once), directed ones as out and in."""
    e = edges.select("a", "b", F.col("label").isNotNull().cast("int").alias("has"), F.coalesce("label", F.lit(0)).cast("long").alias("label"), "directed")
    there = e.select(F.col("a").alias("v"), F.col("b").alias("u"), "has", "label", F.when(F.col("directed"), kernel.OUT).otherwise(kernel.UNDIRECTED).alias("way"))
    back = e.filter("directed or a <> b").select(F.col("b").alias("v"), F.col("a").alias("u"), "has", "label", F.when(F.col("directed"), kernel.IN).otherwise(kernel.UNDIRECTED).alias("way"))
    return there.unionAll(back)


def refine(nodes: DataFrame, adjacent: DataFrame, rounds: int | None = 3) -> DataFrame:
    """(v, colour) after *rounds* rounds, or with None until a round adds no class, which takes as many rounds as there are nodes at most.

    For one large graph: a round is one join and two aggregations that combine map-side. A node's neighbours are counted by (edge
    mark, colour); each such mark with its count is hashed with SHA-256, and the hashes are summed in pieces of 32 bits. So a hub is
    never gathered, however many different marks are around it (a piece's sum holds 2**31 of them). Each round's colours are
    written to the shared folder, which cuts the lineage, and those before are deleted.
    """
    colours, path = staged(nodes.select("v", F.sha2(F.concat(F.lit("init|"), F.col("label").cast("string")), 256).alias("colour")), "colours")
    classes, limit, run = None, nodes.count() if rounds is None else rounds, 0
    while run < limit:
        if rounds is None and classes is None:
            classes = colours.select("colour").distinct().count()
        around = adjacent.join(colours.select(F.col("v").alias("u"), "colour"), "u").groupBy("v", "has", "label", "way", "colour").agg(F.count("*").alias("n"))
        hashed = around.select("v", F.sha2(F.concat_ws(":", "has", "label", "way", "colour", "n"), 256).alias("h"))
        pieces = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"s{i}") for i in range(8)]
        seen = hashed.groupBy("v").agg(F.count("*").alias("n"), *pieces)
        sums = F.concat_ws(",", "n", *(f"s{i}" for i in range(8)))
        new = colours.join(seen, "v", "left").select("v", F.sha2(F.concat_ws("|", "colour", sums), 256).alias("colour"))
        before, (colours, path) = path, staged(new, "colours")
        discard(nodes.sparkSession, before)
        run += 1
        if rounds is None:
            now = colours.select("colour").distinct().count()
            if now == classes:
                break
            classes = now
    return colours


def partition(colours: DataFrame) -> DataFrame:
    """(v, class): the smallest node of each colour's class, which no longer depends on the hash.

    The classes are broadcast if they are few, which is when a colour may be most of the nodes; else they are joined by a shuffle.
    """
    least, _ = staged(colours.groupBy("colour").agg(F.min("v").alias("class")), "classes")
    few = least.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return colours.join(F.broadcast(least) if few else least, "colour").select("v", "class")


def fingerprint(colours: DataFrame) -> DataFrame:
    """(classes, nodes, fingerprint) of one large graph: equal for graphs that differ in the naming of nodes only.

    Hashes of (colour, how many nodes have it) are summed in pieces of 32 bits, so no list of colours is gathered. For fingerprints of
    the byte layout that small graphs have, see refine_each.
    """
    hashed = colours.groupBy("colour").agg(F.count("*").alias("n")).select("n", F.sha2(F.concat_ws(":", "colour", "n"), 256).alias("h"))
    pieces = [F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"s{i}") for i in range(8)]
    total = hashed.agg(F.count("*").alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), *pieces)
    return total.select("classes", "nodes", F.sha2(F.concat_ws(",", "classes", "nodes", *(f"s{i}" for i in range(8))), 256).alias("fingerprint"))


def refine_each(nodes: DataFrame, edges: DataFrame, graph: str = "g", rounds: int | None = 3, mode: str = "wl", hash: str = "sha2_256") -> DataFrame:
    """(g, fingerprint, classes, rounds) of many small graphs: nodes (g, v, label), edges (g, a, b, label, directed).

    Each graph is refined where its rows meet, after one shuffle. ``blake3`` gives byte-compatible fingerprints, ``sha2_256``
    faster ones; classes are the same. An edge to an unknown node is an error.
    """
    kind = nodes.schema[graph].dataType.simpleString()

    def run(key: tuple, ns: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        g, ids = kernel.Graph(), {}
        for v, label in sorted(zip(ns["v"], ns["label"])):
            ids[v] = g.add_node(int(label) % 2**64)
        for a, b, label, directed in zip(es["a"], es["b"], es["label"], es["directed"]):
            if a not in ids or b not in ids:
                raise ValueError(f"unknown node in edge {a} {b}")
            g.add_edge(ids[a], ids[b], None if pd.isna(label) else int(label) % 2**64, bool(directed))
        made = (kernel.wl_refine if mode == "wl" else kernel.spd_wl_refine)(g, rounds, hash)
        return pd.DataFrame([(key[0], made.fingerprint(), made.classes, made.rounds)], columns=[graph, "fingerprint", "classes", "rounds"])

    return nodes.groupBy(graph).cogroup(edges.groupBy(graph)).applyInPandas(run, f"{graph} {kind}, fingerprint string, classes int, rounds int")


def label_of(*parts: str | Column) -> Column:
    """A 64-bit label (as a signed long of the same bits) from string columns; null if one of them is."""

    @F.arrow_udf("long")
    def run(rows: pa.Array) -> pa.Array:
        values = [None if None in row else kernel.label_of(*map(str.encode, row)) for row in rows.to_pylist()]
        return pa.array([v if v is None or v < 2**63 else v - 2**64 for v in values], pa.int64())

    return run(F.array(*(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)))
