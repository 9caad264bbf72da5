"""The decision journal: one JSON line per decision, read back with checks, replayed and compared."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.classifier import Classifier, ReplayError, canonical_json, diff, journal_line, read_line, render_trail


def lines(df: DataFrame, message: Column, profile: Column, decision_json: Column, keep: list[str] = ()) -> DataFrame:
    """(*keep*, value): a journal line per row, from the input's fields and the decision's canonical JSON. Rows without a decision have none."""
    import json

    @F.pandas_udf("string")
    def run(messages: pd.Series, profiles: pd.Series, decisions: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else journal_line({"message": m, "profile": p}, json.loads(d)) for m, p, d in zip(messages, profiles, decisions)], dtype=object)

    return df.select(*keep, run(message, profile, decision_json).alias("value")).filter("value is not null")


def write(journal: DataFrame, path: str) -> None:
    journal.select("value").write.mode("errorifexists").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def parsed(journal: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(*keep*, value, error, input_hash, message, profile, decision): *error* is null, deserialize, schema_mismatch or input_hash_mismatch."""

    @F.pandas_udf("struct<error:string,input_hash:string,message:string,profile:string,decision:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            rows = []
            for v in values:
                try:
                    r = read_line(v)
                    rows.append((None, r["input_hash"], r["input"].get("message"), r["input"].get("profile"), canonical_json(r["decision"])))
                except ReplayError as e:
                    rows.append((e.kind, None, None, None, None))
            yield pd.DataFrame(rows, columns=["error", "input_hash", "message", "profile", "decision"])

    return journal.select(*keep, "value", run("value").alias("r")).select(*keep, "value", "r.*")


def check(entries: DataFrame, classifier: Classifier) -> DataFrame:
    """Adds *same*: whether deciding anew gives the very bytes; and what changed where it doesn't."""
    import json

    @F.pandas_udf("struct<same:boolean,data_version:boolean,profile:boolean,answer:boolean,trail:boolean>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for messages, profiles, decisions in batches:
            rows = []
            for m, p, d in zip(messages, profiles, decisions):
                if d is None:
                    rows.append((None,) * 5)
                    continue
                before, after = json.loads(d), classifier.decide(m or "", p)
                c = diff(before, after)
                rows.append((canonical_json(before) == canonical_json(after), *(c[k] is not None for k in ("data_version", "profile", "answer")), c["trail_changed"]))
            yield pd.DataFrame(rows, columns=["same", "data_version", "profile", "answer", "trail"])

    return entries.withColumn("check", run("message", "profile", "decision"))


def difference(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, one boolean per field, only_before, only_after): null-safe comparison of two tables of decisions, of rows that differ."""
    a = before.select(key, F.struct(*fields).alias("a"))
    b = after.select(key, F.struct(*fields).alias("b"))
    met = a.join(b, key, "full_outer")
    changed = [(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f"{f}_changed") for f in fields]
    out = met.select(key, *changed, F.col("b").isNull().alias("only_before"), F.col("a").isNull().alias("only_after"))
    return out.filter(" or ".join([*(f"{f}_changed" for f in fields), "only_before", "only_after"]))


def trail_text(decision_json: str) -> Column:
    """A decision's trail as text, a line per record."""
    import json

    @F.pandas_udf("string")
    def run(decisions: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else render_trail(json.loads(d)["trail"]) for d in decisions], dtype=object)

    return run(decision_json)
