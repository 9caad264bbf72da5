"""Operator 8: best-fit decreasing packing of token sequences.

Best fit only looks at lengths, and pieces of one length are interchangeable. So the packing is worked out
on the histogram of lengths: for the lengths from the largest down, the tightest open sequences are
found by a segment tree over remaining capacities and filled a run of equal ones at a time, with the same result
as piece by piece. The plan says for each run of ranks within a length where they go; pieces learn their rank
from counts by length and shard, so no task holds all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, records, staged


class OpenBins:
    """Runs of open bins by remaining capacity; a segment tree tells which capacities have any."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.runs: list[deque[tuple[int, int]]] = [deque() for _ in range(size + 1)]

    def _mark(self, capacity: int) -> None:
        node, self.any[self.leaves + capacity] = (self.leaves + capacity) >> 1, bool(self.runs[capacity])
        while node:
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]
            node >>= 1

    def put(self, capacity: int, first: int, count: int) -> None:
        self.runs[capacity].append((first, count))
        self._mark(capacity)

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least *least* that some open bin has."""
        node = self.leaves + least
        if least >= len(self.runs):
            return None
        while not self.any[node]:
            while node & 1:  # no right neighbour under the same parent
                node >>= 1
                if not node:
                    return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """Remove up to *most* bins of one run: (first, count)."""
        first, count = self.runs[capacity].popleft()
        if count > most:
            self.runs[capacity].appendleft((first + most, count - most))
        self._mark(capacity)
        return first, min(count, most)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank from, rank to, first bin, offset, pieces a bin takes) for *counts* pieces of each length."""
    bins, opened, out = OpenBins(size), 0, []
    for length in sorted(counts, reverse=True):
        at, n = 0, counts[length]
        while at < n:
            capacity = bins.tightest(length)
            if capacity is None:
                capacity, each = size, size // length
                first, count = opened, -(-(n - at) // each)
                opened += count
            else:
                # having taken one piece, a bin is the tightest for the next as long as that fits
                each = capacity // length
                first, count = bins.take(capacity, -(-(n - at) // each))
            placed = min(n - at, count * each)
            out.append((length, at, at + placed, first, size - capacity, each))
            full, rest = divmod(placed, each)
            if full and (left := capacity - each * length):
                bins.put(left, first, full)
            if rest and (left := capacity - rest * length):
                bins.put(left, first + full, 1)
            at += placed
    return out


def pieces(docs: DataFrame, path: str, size: int = 2048, end: int = 0, keep: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, piece, start, length, ids_crc32 and with *keep* ids (little-endian unsigned 32-bit): each document's
    ids and *end*, cut into pieces of *size* if there are more."""
    fields = "piece:int,start:bigint,length:bigint,ids_crc32:bigint" + ",ids:binary" * keep

    kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if keep else {})

    @F.arrow_udf(f"array<struct<{fields}>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from .word_bpe import load

        bpe = load(path)
        for texts in batches:
            out, offsets = [], [0]
            for t in texts:
                ids = bpe.encode(t.as_py()) + end.to_bytes(4, "little")
                parts = [ids[s : s + 4 * size] for s in range(0, len(ids), 4 * size)]
                out += [(i, i * size, len(p) // 4, zlib.crc32(p), *([p] if keep else [])) for i, p in enumerate(parts)]
                offsets.append(len(out))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), records(out, **kinds))

    # else the planner would filter on the array's size first and evaluate it twice
    once = cut.asNondeterministic()
    return docs.select(F.col(key), once(F.col(text)).alias("_p")).select(key, F.inline("_p"))


def table_of(runs: list[tuple[int, int, int, int, int, int]]) -> pa.Table:
    columns = zip(*runs) if runs else [()] * 6
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["_length", "_from", "_to", "_first", "_offset", "_each"])


def pack(docs: DataFrame, path: str, size: int = 2048, end: int = 0, keep: bool = False, shards: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset, and with *keep* ids.

    Sequences hold *size* ids at most, without gaps. Null and empty texts are the end id alone. Repeated rows are
    packed each, null keys stay null, other columns are not read, an empty table gives no rows.
    """
    spark = docs.sparkSession
    made, _ = staged(pieces(docs, path, size, end, keep, text, key).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    rows = made.count()
    shards = shards or max(256, rows // 50_000)
    made = made.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    counts, _ = staged(few(made.groupBy("length", "_shard").agg(F.count("*").alias("n")), min(rows, size * shards)), "lengths")
    ahead = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_base"))
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # an Arrow table gets to the JVM as it is; rows would start workers of another kind, which stay
    runs = spark.createDataFrame(table_of(plan(lengths, size)))
    within = F.row_number().over(Window.partitionBy("length", "_shard").orderBy("_row")) - 1
    ranked = made.withColumn("_within", within).join(bases, ["length", "_shard"]).withColumn("_rank", F.col("_base") + F.col("_within"))
    # the plan is bounded by the number of lengths, not of documents
    placed = ranked.join(F.broadcast(runs), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    nth = F.col("_rank") - F.col("_from")
    sequence, offset = F.expr("_first + (_rank - _from) div _each"), F.col("_offset") + nth % F.col("_each") * F.col("length")
    return few(placed, rows).select(key, "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"), *(["ids"] if keep else []))
