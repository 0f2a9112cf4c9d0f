"""Run queries and their SQL side by side: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: The tables that tests read.
SF_DIR = "/root/testdata/sf0.001"

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, rows in one order, values as text."""
    frame = frame[sorted(frame.columns)].reset_index(drop=True)

    def text(value) -> str:
        if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
            return "NULL"
        if isinstance(value, float):
            return repr(value + 0.0)
        return str(value)

    frame = frame.astype(object).map(text)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def kinds(spark_types: dict[str, str], oracle_types: dict[str, str]) -> list[str]:
    same = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
    return [f"{c}: {t} vs {oracle_types.get(c)}" for c, t in spark_types.items() if same.get(t) != oracle_types.get(c)]


def compare(spark, name, query, sql, connection, sf_dir) -> tuple[bool, str]:
    frame = query(spark, sf_dir)
    got = frame.toPandas()
    result = connection.execute(sql)
    oracle_types = {d[0]: str(d[1]) for d in result.description}
    want = result.fetchdf()
    for column, kind in oracle_types.items():  # nullable integers arrive as floats
        if kind in ("BIGINT", "INTEGER", "SMALLINT"):
            want[column] = want[column].astype("Int64")
            if column in got:
                got[column] = got[column].astype("Int64")
        if kind == "DATE":
            want[column] = pd.to_datetime(want[column]).dt.date
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    wrong = kinds(dict(frame.dtypes), oracle_types)
    if wrong:
        return False, f"types {wrong}"
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}"
    a, b = canonical(got.replace({pd.NA: None})), canonical(want.replace({pd.NA: None}))
    differing = (a != b).any(axis=1)
    if differing.any():
        at = differing.idxmax()
        return False, f"{int(differing.sum())} rows differ, first: {a.loc[at].to_dict()} vs {b.loc[at].to_dict()}"
    return True, f"{len(got)} rows"


def main() -> None:
    import __spark_entry__ as e
    from hodos.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(e.queries())
    spark, connection = local_session(8), oracle_connection(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in e.oracle_sql():
                ok, detail = compare(spark, name, e.queries()[name], e.oracle_sql()[name], connection, sf_dir)
            else:
                ok, detail = True, f"{e.queries()[name](spark, sf_dir).count()} rows, no SQL"
        except Exception as error:  # noqa: BLE001
            ok, detail = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} {time.time() - start:6.2f}s  {detail}", flush=True)
    print(f"{len(names) - bad}/{len(names)} match")


if __name__ == "__main__":
    main()
