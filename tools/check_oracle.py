"""Compare registered queries with their SQL in DuckDB: row counts, column types and values.

    python tools/check_oracle.py [--sf 0.01] [query name prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

from lossweave.registry import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN",
}


def spark_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("names", nargs="*")
    opt = args.parse_args()
    folder = f"/root/testdata/sf{opt.sf}"
    spark = spark_session()
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name, query in QUERIES.items():
        if opt.names and not any(name.startswith(n) for n in opt.names):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            got = df.collect()
            seconds = time.time() - start
            if name not in ORACLE:
                print(f"rows {name}: {len(got)} rows {seconds:.1f}s", flush=True)
                continue
            rel = duck.sql(ORACLE[name])
            types = {c: TYPES.get(t, t) for c, t in df.dtypes}
            expected_types = dict(zip(rel.columns, map(str, rel.types)))
            want = rel.fetchall()
            a, b = rows_of(got, df.columns), rows_of(want, rel.columns)
            notes = []
            if types != expected_types:
                notes.append(f"types {sorted(set(types.items()) ^ set(expected_types.items()))}")
            if a != b:
                only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
                notes.append(f"values: {len(a)} vs {len(b)} rows\n   spark {str(only_a)[:700]}\n   duck  {str(only_b)[:700]}")
            bad += bool(notes)
            print(f"{'DIFF' if notes else 'ok  '} {name}: {len(got)} rows {seconds:.1f}s {'; '.join(notes)}", flush=True)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            bad += 1
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:900]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
