"""Runs catalogue queries against their SQL twins: python tests/oracle.py [folder] [name ...]"""

from __future__ import annotations

import datetime
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


_KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
          "TIMESTAMP": "timestamp", "TIMESTAMP WITH TIME ZONE": "timestamp"}


def differences(spark_df, con, sql: str) -> list[str]:
    """Everything that differs between a DataFrame and the SQL result; empty when equal."""
    relation = con.sql(sql)
    kinds = {c: _KINDS.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types, strict=True)}
    mine = dict(spark_df.dtypes)
    if kinds != mine:
        return [f"schema: spark {sorted(mine.items())} sql {sorted(kinds.items())}"]
    left = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    right = _rows(relation.columns, relation.fetchall())
    out = []
    if len(left) != len(right):
        out.append(f"rows: spark {len(left)} sql {len(right)}")
    wrong = [(a, b) for a, b in zip(left, right, strict=False) if a != b]
    if wrong:
        out.append(f"{len(wrong)} rows differ, first: {sorted(mine)}\n  spark {wrong[0][0]}\n  sql   {wrong[0][1]}")
    return out


def main() -> None:
    from flowquarry.plans import CATALOGUE
    from flowquarry.runtime import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(CATALOGUE)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names:
        found = CATALOGUE[name]
        start = time.time()
        try:
            df = found.build(spark, folder)
            problems = differences(df, con, found.sql) if found.sql else ([] if df.count() else ["no rows"])
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.2f}s", *problems, sep="\n  " if problems else " ",
              flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
