"""Vectors packed in blocks, and the meeting of query blocks with candidate blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "dim int, block string, n int, ids binary, data binary"


def usable(df: DataFrame, key: str, vector: str, zero: bool = True) -> DataFrame:
    """(id, v) of the rows that take part: a key, and a vector without null or non-finite components
    (and, where not *zero*, with some component other than zero)."""
    v = F.col(vector)
    fine = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if not zero:
        fine &= F.exists(v, lambda x: x != 0)
    return df.filter(F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def packed(rows: DataFrame, size: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of up to *size* vectors of one length, made where the rows lie, without a shuffle.

    *extra*: further long columns, each packed beside the ids.
    """
    names = [f"x_{c}" for c in extra]
    schema = BLOCK + "".join(f", {c} binary" for c in names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[list[np.ndarray]]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, data, *more = (np.concatenate(x) for x in zip(*held.pop(dim)))
            made += 1
            values = [[dim], [f"{task}-{made}"], [len(ids)], [ids.tobytes()], [data.tobytes()], *([x.tobytes()] for x in more)]
            kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * (2 + len(more))]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["dim", "block", "n", "ids", "data", *names])

        for rows in batches:
            lengths = np.diff(rows.column("v").offsets.to_numpy())
            for dim in np.unique(lengths).tolist():
                part = rows.filter(pa.array(lengths == dim))
                for s in range(0, len(part), size):
                    piece = part.slice(s, size)
                    held.setdefault(dim, []).append([piece.column("id").to_numpy(), matrix(piece.column("v")), *(piece.column(c).to_numpy() for c in extra)])
                    if sum(len(x[0]) for x in held[dim]) >= size:
                        yield block(dim)
        for dim in [*held]:
            yield block(dim)

    return rows.mapInArrow(pack, schema)


MOST_CELLS = 4096


def grid(candidates: int, queries: int, cores: int) -> tuple[int, int]:
    """(rows, columns) of a grid of cells that candidate blocks and query blocks are dealt to.

    A candidate block goes to each column of its row, a query block to each row of its column; with sides in proportion to the blocks, both
    are copied about equally often, and as little as can be for that many cells. A cell has a few pairs of blocks or more.
    """
    pairs = candidates * queries
    cells = max(1, min(MOST_CELLS, max(pairs // 4, min(pairs, 2 * cores))))
    rows = max(1, min(candidates, round(math.sqrt(cells * candidates / max(1, queries)))))
    return rows, max(1, min(queries, -(-cells // rows)))


def meet(queries: DataFrame, candidates: DataFrame, score: Callable[..., Iterator[pa.RecordBatch]], schema: str, blocks: tuple[int, int]) -> DataFrame:
    """Let every query block meet every candidate block of its vector length, one pair of blocks at a time.

    Blocks are dealt to a grid (*blocks*: about how many candidate and query blocks there are); a task holds two blocks at a
    time, however many there are. *score* turns a row with the columns of both (those of queries prefixed with q_) into record batches.
    """
    rows, columns = grid(*blocks, queries.sparkSession.sparkContext.defaultParallelism)
    along = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = candidates.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(rows))).withColumn("h", along(columns))
    sent = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns), F.pmod(F.xxhash64("block"), F.lit(columns)).alias("_h"), along(rows).alias("_g"))
    pairs = dealt.join(sent, (F.col("g") == F.col("_g")) & (F.col("h") == F.col("_h")) & (F.col("dim") == F.col("q_dim"))).drop("g", "h", "_g", "_h")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            names = rows.schema.names
            for i in range(len(rows)):
                yield from score(dict(zip(names, (rows.column(j)[i].as_py() for j in range(len(names))))))

    return pairs.mapInArrow(scored, schema)
