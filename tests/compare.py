"""Run registered queries next to their SQL and compare rows, types and values.

    python -m tests.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "VARCHAR",
         "int": "INTEGER"}


def local_session(name="liftengine-tests", **conf):
    builder = (
        SparkSession.builder.master("local[8]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.enabled", "false"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir):
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_cell(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((cell is None, str(cell)) for cell in row))


def compare(spark, con, sf_dir, build, statement):
    """An empty string when both agree, else what differs."""
    df = build(spark, sf_dir)
    ours_types = {name: KINDS.get(kind, kind) for name, kind in df.dtypes}
    ours = table(df.columns, [tuple(row) for row in df.collect()])
    result = con.execute(statement)
    names = [d[0] for d in result.description]
    their_types = {d[0]: str(d[1]) for d in result.description}
    theirs = table(names, result.fetchall())
    if ours_types != their_types:
        odd = {n: (ours_types.get(n), their_types.get(n))
               for n in {*ours_types, *their_types} if ours_types.get(n) != their_types.get(n)}
        return f"types differ: {odd}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows, not {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ, such as\n  {wrong[0][0]}\n  {wrong[0][1]}"
    return ""


def main():
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark, con = local_session(), duck(sf_dir)
    twins = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            found = compare(spark, con, sf_dir, build, twins[name])
        except Exception as error:  # keep going: the other queries still matter
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - start:.1f}s {found}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
