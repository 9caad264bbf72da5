"""Operator 9: approximate nearest neighbours by a permutation index.

The pivots are vectors of a bounded sample that lie apart, so that a group of near copies takes few of them. Each vector stands for the ordered list of its nearest pivots;
each pivot's inverted file lists the vectors that name it, with its place in their lists. A query reads
the files of its own nearest pivots, which sums up to the footrule distance between the lists (absent
pivots counting as one place past the end). How the cosine falls with it is fitted per query on some rows of the
segment; that times a row's norm tells which rows may have large inner products, and these are ranked anew by the measure itself.
The index is kept in segments, one record each, so that searching needs one segment at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .vectors import meet, packed, usable

SEGMENT = "dim int, block string, n int, ids binary, data binary, members binary, places binary, starts binary, firsts binary, copies binary"


def pivots_of(rows: DataFrame, count: int) -> dict[int, np.ndarray]:
    """By vector length, up to *count* unit vectors that lie apart, out of the four times *count* of the least hashes, equal ones once.

    Only rows with hashes in about the share that holds these are shuffled; where that leaves a length too few
    (equal vectors, a rare length), all rows are.
    """
    span = 1 << 30
    share = min(span, -(-4 * count * span // max(1, rows.count())))
    hashed = rows.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(span)).alias("h"), "v")
    rank = F.row_number().over(Window.partitionBy("dim").orderBy("h", "v"))
    for most in (share, span):
        firsts = hashed.filter(F.col("h") < most).groupBy("dim", "h").agg(F.min("v").alias("v"))
        chosen = firsts.withColumn("r", rank).filter(F.col("r") <= 4 * count).select("dim", "r", "v").collect()
        found: dict[int, list] = {}
        for r in chosen:
            found.setdefault(r.dim, []).append((r.r, r.v))
        lengths = {r.dim for r in rows.select(F.size("v").alias("dim")).distinct().collect()}
        if most == span or all(len(found.get(n, ())) >= count for n in lengths):
            break
    return {dim: _apart(_unit(np.array([v for _, v in sorted(x)])), count) for dim, x in found.items()}


def _apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to *count* rows: the first, then always the one whose largest cosine with those taken is least; ties to the first row."""
    largest, taken = np.full(len(sample), -2.0), [0]
    while len(taken) < min(count, len(sample)):
        largest = np.maximum(largest, sample @ sample[taken[-1]])
        largest[taken[-1]] = np.inf
        taken.append(int(largest.argmin()))
    return sample[taken]


def _unit(m: np.ndarray) -> np.ndarray:
    largest = np.abs(m).max(axis=1, keepdims=True)
    m = m / np.where(largest > 0, largest, 1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _nearest(m: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """For each row, its nearest pivots in order; of those that count, ties go to the first pivot."""
    far = -(_unit(m) @ pivots.T)
    if length < far.shape[1]:
        some = np.sort(np.argpartition(far, length - 1, axis=1)[:, :length], axis=1)
        return np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable"), 1)
    return np.argsort(far, axis=1, kind="stable")


def _indexed(pivots: dict[int, np.ndarray], length: int, keep: int):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                dim = row["dim"]
                ids, data = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["data"]).reshape(-1, dim)
                # equal vectors have one entry; it leads to their smallest ids
                order = np.lexsort((ids, *data.T))
                ids, data = ids[order], data[order]
                new = np.r_[True, (data[1:] != data[:-1]).any(axis=1)]
                group, at = np.cumsum(new) - 1, np.flatnonzero(new)
                kept = np.arange(len(ids)) - at[group] < keep
                copies, firsts = ids[kept], np.searchsorted(group[kept], np.arange(len(at) + 1))
                data = np.ascontiguousarray(data[at])
                lists = np.concatenate([_nearest(data[s : s + 4096], pivots[dim], length) for s in range(0, len(data), 4096)])
                member, place = np.divmod(np.arange(lists.size), lists.shape[1])
                by = np.argsort(lists.ravel(), kind="stable")
                starts = np.searchsorted(lists.ravel()[by], np.arange(len(pivots[dim]) + 1))
                made = [dim, row["block"], len(data), b"", data.tobytes(), member[by].astype(np.int32).tobytes(), place[by].astype(np.int16).tobytes(), starts.astype(np.int64).tobytes(), firsts.astype(np.int64).tobytes(), copies.tobytes()]
                kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds)], [x.split(" ")[0] for x in SEGMENT.split(", ")])

    return index


def _expected(shared: np.ndarray, x: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """What a cosine may reach: a straight line through the probes' cosines, and two standard deviations from it."""
    x = x.astype(float)
    spread = x.var()
    slope = ((x - x.mean()) * (cosines - cosines.mean())).mean() / spread if spread > 0 else 0.0
    at = cosines.mean() - slope * x.mean()
    return at + slope * shared + 2 * (cosines - at - slope * x).std()


def _searched(pivots: dict[int, np.ndarray], length: int, k: int, share: float):
    def score(row: dict) -> Iterator[pa.RecordBatch]:
        dim = row["dim"]
        own, asked = np.frombuffer(row["q_ids"], dtype=np.int64), np.frombuffer(row["q_data"]).reshape(-1, dim)
        data = np.frombuffer(row["data"]).reshape(-1, dim)
        members, places = np.frombuffer(row["members"], dtype=np.int32), np.frombuffer(row["places"], dtype=np.int16)
        starts, firsts, copies = (np.frombuffer(row[c], dtype=np.int64) for c in ("starts", "firsts", "copies"))
        asked, which = np.unique(asked, axis=0, return_inverse=True)
        lists = _nearest(asked, pivots[dim], length)
        norms = np.linalg.norm(data / max(np.abs(data).max(initial=0), np.finfo(float).tiny), axis=1)
        probes = np.unique(np.linspace(0, len(data) - 1, 512).astype(np.int64))
        cosines = _unit(asked) @ _unit(data[probes]).T
        count = min(len(data), max(8 * (k + 1), int(share * len(data))))
        found = []
        for i, q in enumerate(asked):
            shared = np.zeros(len(data), dtype=np.int32)  # the footrule distance is length * (length + 1) - 2 * shared
            for a, p in enumerate(lists[i]):
                s, e = starts[p], starts[p + 1]
                shared[members[s:e]] += length - np.maximum(places[s:e], a)
            if count < len(data):
                promise = norms * _expected(shared, shared[probes], cosines[i])
                near = np.argpartition(-promise, count - 1)[:count]
            else:
                near = np.arange(len(data))
            scores = np.einsum("ij,j->i", data[near], q)
            size = firsts[near + 1] - firsts[near]
            if len(near) > k + 1:  # whole ties stay
                enough = np.partition(scores, len(near) - k - 1)[len(near) - k - 1]
                keep = scores >= enough
                near, scores, size = near[keep], scores[keep], size[keep]
            ids = copies[np.repeat(firsts[near] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
            scores = np.repeat(scores, size)
            order = np.lexsort((ids, -scores))
            found.append((ids[order], scores[order]))
        out: list[list[np.ndarray]] = [[], [], []]
        for query, w in zip(own, which.ravel()):
            ids, scores = found[w]
            other = np.flatnonzero(ids != query)[:k]
            for x, y in zip(out, (np.full(len(other), query), ids[other], scores[other])):
                x.append(y)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    return score


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, pivots: int = 1024, length: int = 64, share: float = 0.12, size: int = 16384, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the *k* largest inner products found, in double precision.

    *pivots* bounds the sample of pivots, *length* is that of a permutation, *size* that of a segment; of each
    segment the most promising *share* by footrule and norm (of very small ones 8 (k + 1) rows) are ranked anew. Many pivots and lists that hold
    few of them keep the inverted files short: a query meets length ** 2 / pivots entries a row. Every row is indexed. Queries are
    the rows whose key is divisible by *every*, one per key (of repeated ones the least vector); candidates all other
    rows except such as bear the query's own key. Ties go to the smaller key. Rows with a null key, or with
    a vector that is null, empty, zero or holds null or non-finite components, take no part; vectors of different
    lengths aren't compared. Fewer than *k* candidates give fewer rows, an empty table none. Equal vectors
    are one entry that leads to as many of their smallest ids as can be asked for. Other columns are not read.
    """
    rows = usable(vectors, key, vector, zero=False)
    sample = pivots_of(rows, pivots)
    index, _ = staged(packed(rows, size).mapInArrow(_indexed(sample, length, k + 1), SEGMENT), "segments")
    asked, _ = staged(rows.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), "asked")
    parts = max(1, -(-asked.count() // 1024))
    sent = packed(asked.repartition(parts, "id"), 1024)
    best = meet(sent, index, _searched(sample, length, k, share), "query_id long, vec_id long, score double", (index.count(), parts))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
