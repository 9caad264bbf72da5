"""Operator 5: exact top-k search by distributed histogram selection.

Queries and candidates are dealt to cells of a grid, as chunks of a few KB. Each round counts scores in a global histogram per query; the bin
that holds the k-th value becomes the next round's range, until it is one value wide. A last round
keeps the scores above that value and, of those equal to it, the smallest ids. A cell tells of no more than
its own k best within the range: what lies below them can't hold the k-th value, so counts above
that value's bin stay exact. It holds its queries and one block of candidates at a time, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, staged
from .vectors import matrix, usable

BINS = 1024
SCALE = 256
RANGE = ("low", "width", "bins")
CHUNK = "dim int, block long, kind string, ids binary, data binary, " + ", ".join(f"{c} binary" for c in RANGE)
#: Bytes of a chunk's data (more only where one vector takes more), and of the queries or the candidates that a task holds as doubles:
#: Arrow batches are counted in rows, up to 10,000, so that only small rows bound them.
CHUNK_BYTES, HELD_BYTES = 4096, 32 << 20
#: Pairs of a query and a candidate in a cell of the grid, where there are enough queries.
CELL_PAIRS = 2 * 10**9


def _narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    largest = np.abs(values).max(initial=0)
    return values.astype("<i2" if largest < 2**15 else "<i4" if largest < 2**31 else "<f8")


def _chunks(rows: DataFrame) -> DataFrame:
    """Quantised vectors of one length in chunks of a few KB, made where the rows lie; the columns of RANGE go along if there are any."""
    extra = [c for c in RANGE if c in rows.columns]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 40
        for rows in batches:
            lengths = np.diff(rows.column("v").offsets.to_numpy())
            for dim in np.unique(lengths).tolist():
                part = rows.filter(pa.array(lengths == dim))
                data = _narrow(np.floor(SCALE * matrix(part.column("v"))))
                each = max(1, CHUNK_BYTES // (dim * data.itemsize))
                at = range(0, len(part), each)
                packed = lambda x: pa.array([x[s : s + each].tobytes() for s in at], pa.binary())
                more = [packed(part.column(c).to_numpy()) if c in extra else pa.nulls(len(at), pa.binary()) for c in RANGE]
                blocks = pa.array(range(block, block + len(at)), pa.int64())
                block += len(at)
                yield pa.RecordBatch.from_arrays([pa.array([dim] * len(at), pa.int32()), blocks, pa.array([data.dtype.str] * len(at)), packed(part.column("id").to_numpy()), packed(data), *more], [c.split(" ")[0] for c in CHUNK.split(", ")])

    return rows.mapInArrow(cut, CHUNK)


def cells_of(candidates: int, queries: int, dim: int, cores: int) -> tuple[int, int]:
    """(rows, columns) of cells: a cell's queries fit a task, and so does its time where that doesn't copy queries more often than candidates."""
    columns = max(1, -(-queries * dim * 8 // HELD_BYTES))
    cells = max(2 * cores, candidates * queries // CELL_PAIRS)
    rows = min(-(-cells // columns), max(2 * cores, columns * candidates // max(1, queries)))
    return max(1, min(candidates, rows)), columns


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products. A score beyond 64 bits is an error."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], dtype=object) @ np.array([[int(x) for x in r] for r in c], dtype=object).T
    return exact.astype(np.int64)


_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class _Cell:
    """Some queries, and of the candidates so far their k best from *low* to *high*: highest scores first, ties by smaller id."""

    def __init__(self, k: int, ids: np.ndarray, data: np.ndarray, low: np.ndarray, high: np.ndarray | None):
        self.k, self.ids, self.data, self.low, self.high = k, ids, data, low, high
        self.scores, self.found = np.full((len(ids), k), _LEAST), np.full((len(ids), k), _MOST)

    def meet(self, ids: np.ndarray, data: np.ndarray, part: int = 512) -> None:
        for s in range(0, len(self.ids), part):
            own, here = self.ids[s : s + part], slice(s, s + part)
            scores = _products(self.data[here], data)
            for i in np.flatnonzero(np.isin(own, ids)).tolist():
                scores[i, ids == own[i]] = _LEAST
            if self.high is not None:
                scores[scores > self.high[here, None]] = _LEAST  # counted before
            least = np.maximum(self.scores[here, -1], self.low[here])
            fits = scores >= least[:, None]
            if np.count_nonzero(fits) > 8 * self.k * len(own) and len(ids) > self.k:
                fits = scores >= np.maximum(least, np.partition(scores, len(ids) - self.k, axis=1)[:, -self.k])[:, None]
            q, c = np.nonzero(fits)
            if len(q):
                self._keep(s + q, scores[q, c], ids[c])

    def _keep(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        some = np.unique(q)
        q = np.r_[np.repeat(some, self.k), q]
        scores, ids = np.r_[self.scores[some].ravel(), scores], np.r_[self.found[some].ravel(), ids]
        order = np.lexsort((ids, -1 - scores, q))  # -1 - x turns the order round without overflow
        firsts = np.searchsorted(q[order], some)
        best = order[(firsts[:, None] + np.arange(self.k)).ravel()]
        self.scores[some], self.found[some] = scores[best].reshape(-1, self.k), ids[best].reshape(-1, self.k)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, its place, id, score) of what was found."""
        q, r = np.nonzero((self.scores > _LEAST) & (self.scores >= self.low[:, None]))
        return q, self.found[q, r], self.scores[q, r]


def _meet(queries: DataFrame, candidates: DataFrame, k: int, size: int, cells: tuple[int, int], counting: bool) -> DataFrame:
    """(query_id, bin, n) of each cell's k best within the ranges or else (query_id, vec_id, score)."""
    rows, columns = cells
    along = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    to = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    names = ["dim", "kind", "ids", "data", *RANGE]
    asked = queries.select(*names, F.lit(0).alias("side"), to(columns).alias("h"), along(rows).alias("g"))
    dealt = candidates.select(*names, F.lit(1).alias("side"), along(columns).alias("h"), to(rows).alias("g"))
    each = asked.unionByName(dealt).withColumn("cell", F.col("g") * columns + F.col("h")).drop("g", "h")
    longs = lambda parts: np.frombuffer(b"".join(parts), dtype=np.int64)

    def told(cell: _Cell | None, width: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        q, ids, scores = cell.best() if cell else ((), (), ())
        if not len(q):
            return
        if not counting:
            yield pa.RecordBatch.from_arrays([pa.array(cell.ids[q]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])
            return
        both, n = np.unique(np.stack([q, (scores - cell.low[q]) // width[q]]), axis=1, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cell.ids[both[0]]), pa.array(both[1]), pa.array(n.astype(np.int64))], ["query_id", "bin", "n"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by length, queries before candidates
        at, cell, width = None, None, None
        held: list[dict] = []
        count = 0

        def put(dim: int) -> np.ndarray:
            return np.concatenate([np.frombuffer(x["data"], dtype=x["kind"]).astype(float) for x in held]).reshape(-1, dim)

        def turn() -> None:
            """What is held becomes the cell's queries, or meets them."""
            nonlocal cell, width, held, count
            if held and at[1]:
                if cell:
                    cell.meet(longs(x["ids"] for x in held), put(at[0]))
            elif held:
                low, width, bins = (longs(x[c] for x in held) for c in RANGE)
                cell = _Cell(k, longs(x["ids"] for x in held), put(at[0]), low, low + width * bins - 1 if counting else None)
            held, count = [], 0

        for rows in batches:
            columns = [rows.column(c) for c in ("side", *names)]
            for i in range(len(rows)):
                side, *values = (c[i].as_py() for c in columns)
                chunk = dict(zip(names, values))
                if at != (chunk["dim"], side):
                    if at:
                        turn()
                        if at[0] != chunk["dim"]:
                            yield from told(cell, width)
                            cell = None
                    at = chunk["dim"], side
                held.append(chunk)
                count += len(chunk["ids"]) // 8
                if side and count >= min(size, max(256, HELD_BYTES // (8 * chunk["dim"]))):
                    turn()
        turn()
        yield from told(cell, width)

    ordered = each.repartitionById(rows * columns, F.col("cell")).sortWithinPartitions("dim", "side")
    return ordered.select("side", *names).mapInArrow(score, "query_id long, bin long, n long" if counting else "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, size: int = 4096, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the *k* highest integer inner products of floor(256 * x).

    Queries are the rows whose key is divisible by *every*, one per key (of repeated ones the least vector);
    candidates all other rows, except such as bear the query's own key, each for itself where keys repeat.
    Ties go to the smaller key. Rows with a null key, or with a vector that is null, empty or holds null or non-finite
    components, take no part; vectors of different lengths aren't compared. Fewer than *k* candidates
    give fewer rows, an empty table none. Other columns are not read. *size* is how many candidates are scored at a time.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + F.floor(x * SCALE).cast("double") * F.floor(x * SCALE).cast("double")))
    longest, dim, count = rows.agg(F.max(norm), F.max(F.size("v")), F.count("*")).first()
    if longest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, _ = staged(_chunks(rows), "candidates")
    asked = rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    bound = F.least(F.ceil(norm * F.lit(float(longest)) * 1.000001 + 1).cast("double"), F.lit(4.0e18)).cast("long")
    state, path = staged(asked.withColumn("low", -bound).withColumn("width", F.ceil((2 * bound.cast("double") + 1) / BINS).cast("long") + 1).withColumn("bins", F.lit(BINS).cast("long")).withColumn("need", F.lit(k).cast("long")), "ranges")
    cells = cells_of(count, state.count(), dim, spark.sparkContext.defaultParallelism)
    while True:
        counts = _meet(_chunks(state), blocks, k, size, cells, True).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        upto = counts.join(state.select(F.col("id").alias("query_id"), "need"), "query_id").withColumn("upto", F.sum("n").over(down)).withColumn("before", F.col("upto") - F.col("n"))
        # the bin of the k-th value, or the lowest one if there are fewer
        found = upto.filter(F.col("before") < F.col("need")).groupBy("query_id").agg(F.min("bin").alias("bin"), F.max("before").alias("before"))
        moved = state.join(found, F.col("id") == F.col("query_id")).select("id", "v", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), F.ceil(F.col("width") / BINS).cast("long").alias("step"), F.col("width").alias("span"), (F.col("need") - F.col("before")).alias("need"))
        before = path
        state, path = staged(moved.select("id", "v", "low", F.col("step").alias("width"), F.ceil(F.col("span") / F.col("step")).cast("long").alias("bins"), "need", "span"), "ranges")
        discard(spark, before)
        if (state.agg(F.max("span")).first()[0] or 1) <= 1:
            break
    best = _meet(_chunks(state), blocks, k, size, cells, False)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
