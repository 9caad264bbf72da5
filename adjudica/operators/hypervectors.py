"""Tables of hypervectors: encoding, bundles, nearest entries, iterative decoding, resonators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decisions import similarity
from ..kernels import hdc


def _signed(words: np.ndarray) -> list[list[int]]:
    return words.view(np.int64).tolist()


def _lists(words: np.ndarray, present: np.ndarray) -> pa.Array:
    """Rows of words where *present*, null elsewhere."""
    width = words.shape[1] if words.ndim == 2 else 0
    at = np.r_[0, np.cumsum(present * width)].astype(np.int32)
    offsets = pa.array(at, mask=np.r_[~present, False])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(words).view(np.int64).ravel()))


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors that are not null as rows, which rows those are)."""
    present = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = int(present.sum())
    return flat.view(np.uint64).reshape(n, -1) if n else np.zeros((0, 1), np.uint64), present


def _unsigned(rows) -> np.ndarray:
    return np.array([list(r) for r in rows], dtype=np.int64).view(np.uint64)


def seed(symbol: Column, namespace: str, version: int = 1) -> Column:
    """The 64-bit seed of a symbol, as a signed long of the same bits; null for null."""

    @F.arrow_udf("long")
    def run(symbols: pa.Array) -> pa.Array:
        made = [None if s is None else hdc.seed(namespace, s, version) for s in symbols.to_pylist()]
        return pa.array([x if x is None or x < 2**63 else x - 2**64 for x in made], pa.int64())

    return run(symbol)


def encode(symbol: Column, namespace: str, dim: int = 1024, version: int = 1) -> Column:
    """Packed hypervectors of symbols; null for null."""

    @F.arrow_udf("array<long>")
    def run(symbols: pa.Array) -> pa.Array:
        present = symbols.is_valid().to_numpy(zero_copy_only=False)
        return _lists(hdc.encode([hdc.seed(namespace, s, version) for s in symbols.to_pylist() if s is not None], dim), present)

    return run(symbol)


def permute(vector: Column, shift: int) -> Column:
    """Component i moves to i + *shift*, around the end; null stays null."""

    @F.arrow_udf("array<long>")
    def run(vectors: pa.Array) -> pa.Array:
        words, present = _vectors(vectors)
        return _lists(hdc.permute(words, shift), present) if len(words) else pa.array([None] * len(present), pa.list_(pa.int64()))

    return run(vector)


def sums(df: DataFrame, keys: list[str], vector: str = "vector", weight: str | None = None, dim: int = 1024) -> DataFrame:
    """(keys, sums array<int>): weighted component sums per key, held within 32 bits.

    Each partition adds up its own rows first, so a key's rows shuffle as one array per partition however many they are.
    """
    names = [*keys, "part"]
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + ", part array<bigint>"
    chosen = df.select(*keys, vector, (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for k, group in b.groupby(keys, dropna=False, sort=False):
                total = hdc.signs(_unsigned(group[vector])) * group["_w"].to_numpy()[:, None]
                held[k] = held.get(k, 0) + total.sum(axis=0)
            if len(held) > 10_000:
                yield pd.DataFrame([(*k, v.tolist()) for k, v in held.items()], columns=names)
                held = {}
        if held:
            yield pd.DataFrame([(*k, v.tolist()) for k, v in held.items()], columns=names)

    parts = chosen.mapInPandas(partial, schema)
    exploded = parts.select(*keys, F.posexplode("part").alias("i", "s")).groupBy(*keys, "i").agg(F.sum("s").alias("s"))
    held = F.greatest(F.lit(-(2**31)), F.least(F.lit(2**31 - 1), F.col("s"))).cast("int")
    return exploded.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", held.alias("s")))), lambda x: x["s"]).alias("sums"))


def signs(total: Column) -> Column:
    """The packed signs of sums, zero counting as +1: words of 64 components, in expressions only."""
    word = lambda w: F.aggregate(F.slice(total, w * 64 + 1, F.lit(64)), F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).alias("b")), lambda s, v: F.struct(F.when(v < 0, s["x"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), s["b"]))).otherwise(s["x"]).alias("x"), (s["b"] + 1).alias("b")), lambda s: s["x"])
    return F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(total), F.lit(64)).cast("int") - 1), word)


def bundle(df: DataFrame, keys: list[str], vector: str = "vector", dim: int = 1024) -> DataFrame:
    return sums(df, keys, vector, None, dim).withColumn("vector", signs(F.col("sums"))).drop("sums")


def codebook(entries: DataFrame, id: str = "id", vector: str = "vector") -> DataFrame:
    """(idx, id, vector): a codebook's entries, numbered in the byte order of their ids.

    An empty codebook is an error at once; an empty or null id, or one that occurs twice, when the entries are read.
    """
    if entries.isEmpty():
        raise hdc.CodebookError("empty", "codebook is empty")
    once = entries.groupBy(F.col(id).alias("id")).agg(F.count("*").alias("_n"), F.min(vector).alias("vector"))
    fault = F.when(F.coalesce(F.length("id"), F.lit(0)) == 0, "empty codebook id").when(F.col("_n") > 1, F.concat(F.lit("duplicate codebook id "), "id"))
    checked = once.withColumn("_n", F.when(fault.isNull(), F.lit(0)).otherwise(F.raise_error(fault).cast("int"))).filter("_n = 0")
    # codebooks are dimensions; a large one is numbered in one task, but holds no more than ids and vectors
    return checked.select((F.row_number().over(Window.orderBy("id")) - 1).alias("idx"), "id", "vector")


BLOCK = 4096  # codebook entries that go along as a constant: 512 KB at 1024 dimensions; a larger codebook is dealt to rows of so many
BROADCAST_BYTES = 64 << 20


def nearest(queries: DataFrame, book: DataFrame, key: str, dim: int = 1024, floor: int = -1000) -> DataFrame:
    """(key, id, similarity, margin): for each query the entry of a codebook (id, vector) that is most like it, if that reaches *floor*.

    A codebook of at most BLOCK entries (counted first) goes along as a constant, and queries are not shuffled. A larger one is dealt to
    blocks, each one row; a query meets each block and keeps its two best of it. The blocks are broadcast if their bytes are at
    most BROADCAST_BYTES; else queries are dealt to as many parts as there are blocks, so that no key holds all queries. Of equal
    entries the first id wins; a single entry's runner-up counts as -1000. Keys are taken to be unique; null vectors have no row.
    """
    count = book.count()
    present = queries.filter(F.col("vector").isNotNull())
    if count <= BLOCK:
        held = sorted(((r.id, r.vector) for r in book.select("id", "vector").collect()), key=lambda e: e[0].encode())
        ids, words = [i for i, _ in held], _unsigned([v for _, v in held]) if held else np.zeros((0, dim // 64), np.uint64)

        @F.arrow_udf("struct<id:string,similarity:int,margin:int>")
        def best_of(vectors: pa.Array) -> pa.Array:
            asked, _ = _vectors(vectors)
            first, top, margin = hdc.nearest_of_each(asked, words)
            return pa.StructArray.from_arrays([pa.array([ids[i] for i in first], pa.string()), pa.array(top, pa.int32()), pa.array(margin, pa.int32())], names=["id", "similarity", "margin"])

        if not ids:
            return present.select(key, F.lit("").alias("id"), F.lit(0).alias("similarity"), F.lit(0).alias("margin")).limit(0)
        return present.select(key, best_of("vector").alias("_b")).filter(F.col("_b.similarity") >= floor).select(key, "_b.id", "_b.similarity", "_b.margin")
    blocks = -(-count // BLOCK)
    entries = book.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("_g")).groupBy("_g").agg(F.collect_list(F.struct("id", "vector")).alias("_book"))
    sent = present.select(key, "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_g"))
    if count * (dim // 8 + 64) <= BROADCAST_BYTES:
        met = sent.join(F.broadcast(entries), "_g")
    else:
        parts = F.lit(blocks)
        spread = entries.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        met = sent.withColumn("_p", F.pmod(F.xxhash64(key), parts)).join(spread, ["_g", "_p"])
    sims = F.transform("_book", lambda e: F.struct((-similarity(F.col("vector"), e["vector"], dim)).alias("s"), e["id"].alias("id")))
    best = met.select(key, F.slice(F.array_sort(sims), 1, 2).alias("_two"))
    best = best.groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_two"))), 1, 2).alias("_two"))
    best = best.withColumn("similarity", -F.col("_two")[0]["s"])
    margin = F.least(F.lit(1000), F.col("similarity") - F.coalesce(-F.get(F.col("_two"), F.lit(1))["s"], F.lit(-1000)))
    return best.filter(F.col("similarity") >= floor).select(key, F.col("_two")[0]["id"].alias("id"), F.col("similarity").cast("int").alias("similarity"), margin.cast("int").alias("margin"))


def decode(df: DataFrame, ids: list[str], book: np.ndarray, key: str, k: int, floor: int, total: str = "sums") -> DataFrame:
    """(key, rank, id, similarity): the entries that sums are made of, one after another. The codebook goes along as a constant."""

    @F.pandas_udf("array<struct<rank:int,id:string,similarity:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        entries = hdc.components(book)
        for rows in batches:
            yield pd.Series([[{"rank": r + 1, "id": ids[i], "similarity": s} for r, (i, s) in enumerate(hdc.decode(np.array(x), book, k, floor, entries))] for x in rows], dtype=object)

    return df.select(key, F.inline(run(total)))


def capacity(cells: DataFrame, trials: int = 10) -> DataFrame:
    """(entries, dim, k, decode, sign): thousandths of a bundle's members that are found again, for each cell (entries, dim, k) of a table; a cell is one task's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, dim, k, *hdc.capacity(n, dim, k, trials)) for n, dim, k in zip(b["entries"].tolist(), b["dim"].tolist(), b["k"].tolist())]
            yield pd.DataFrame(rows, columns=["entries", "dim", "k", "decode", "sign"])

    return cells.select("entries", "dim", "k").mapInPandas(run, "entries int, dim int, k int, decode int, sign int")


def resonate(df: DataFrame, a: tuple[list[str], np.ndarray], b: tuple[list[str], np.ndarray], key: str, cap: int = 16, vector: str = "vector") -> DataFrame:
    """(key, converged, iterations, a, b): the two entries whose binding a vector is."""

    @F.pandas_udf("struct<converged:boolean,iterations:int,a:string,b:string>")
    def run(rows: pd.Series) -> pd.DataFrame:
        out = []
        for q in _unsigned(rows) if len(rows) else []:
            n, x, y = hdc.resonate(q, a[1], b[1], cap)
            out.append((x is not None, n, x and a[0][x[0]], y and b[0][y[0]]))
        return pd.DataFrame(out, columns=["converged", "iterations", "a", "b"])

    return df.select(key, run(vector).alias("r")).select(key, "r.*")
