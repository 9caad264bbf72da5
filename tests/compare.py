"""Run registered queries against their DuckDB equivalents: python tests/compare.py [sf_dir] [names...]."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in (r[i] for i in order)]) for r in data)


def compare(spark, sf_dir, name, f, sql):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = f(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), None, ""
    rel = c.execute(sql)
    columns = [x[0] for x in rel.description]
    if sorted(columns) != sorted(df.columns):
        return len(got), False, f"columns {sorted(df.columns)} {sorted(columns)}"
    expected = rows(columns, rel.fetchall())
    if got == expected:
        return len(got), True, ""
    a, b = sorted(set(got) - set(expected))[:3], sorted(set(expected) - set(got))[:3]
    return len(got), False, f"{len(got)} against {len(expected)} rows\n   spark {a}\n   duck  {b}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or [n for n in e.queries() if not n.startswith("op") and n != "pipeline"]
    os.environ["PYTHONPATH"] = sys.path[0]
    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '3')}]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    for n in names:
        began = time.time()
        try:
            count, same, why = compare(spark, sf_dir, n, e.queries()[n], e.oracle_sql().get(n))
        except Exception as x:  # noqa: BLE001
            count, same, why = -1, False, str(x)[:700]
        print(f"{n}: {count} rows, {'no oracle' if same is None else 'same' if same else 'DIFFERENT'} {time.time() - began:.1f}s {why}", flush=True)
