"""Helpers shared by the operators: table reading, staging in the shared folder, memos of bounded size."""

from __future__ import annotations

from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.staging import dealt, discard, scratch, shared_dir, staged

__all__ = ["Memo", "dealt", "discard", "few", "records", "scratch", "shared_dir", "staged", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(df: DataFrame, rows: int, each: int = 50_000, least: int = 1) -> DataFrame:
    """*df* of about *rows* rows in no more parts than make *each* rows a part (*least* parts at least): for small tables that many
    shuffle partitions would write as as many tiny files, for each of which Hadoop's local file system starts several processes. A large
    table keeps its parts."""
    return df.coalesce(max(least, -(-rows // each)))


def records(rows: list[tuple], **kinds: pa.DataType) -> pa.Array:
    """Rows as an array of structs, with a field for each of *kinds*."""
    columns = zip(*rows) if rows else [()] * len(kinds)
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=[*kinds])


class Memo(dict):
    """A dict that computes what is missing and keeps at most two generations of *limit* bytes.

    Values only depend on keys, so forgetting changes time, never results. Once the young generation is
    full it becomes the old one; what is asked for again moves back. Keys longer than *longest* are
    computed each time and not kept.
    """

    #: Bytes that an entry takes in the table besides key and value.
    ENTRY = 100

    def __init__(self, compute, limit: int = 24 << 20, longest: int = 64, weigh=getsizeof):
        super().__init__()
        self.compute, self.limit, self.longest, self.weigh = compute, limit, longest, weigh
        self.old: dict = {}
        self.held = 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if self.held >= self.limit:
                self.old = dict(self)
                self.clear()
                self.held = 0
            self[key] = value
            self.held += getsizeof(key) + self.weigh(value) + self.ENTRY
        return value
