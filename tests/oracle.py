"""Run registered queries and their SQL twins side by side and compare the values.

Usage: python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return "\\N"
    if isinstance(value, float):
        if math.isnan(value):
            return "\\N"
        return f"{value + 0.0:.6f}"
    if hasattr(value, "tolist") and not isinstance(value, str):
        value = value.tolist()
        return cell(value) if not isinstance(value, list) else str([cell(v) for v in value])
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    columns = [[cell(v) for v in frame[c].astype(object)] for c in frame.columns]
    return sorted(zip(*columns))


def kind(dtype) -> str:
    name = str(dtype)
    return "float" if name.startswith("float") else "int" if name.lower().startswith("int") else name


def compare(spark, con, folder, name, fn, sql):
    started = time.time()
    df = fn(spark, folder)
    got = df.toPandas()
    took = time.time() - started
    if sql is None:
        return "rows-only", len(got), took, ""
    started = time.time()
    want = con.execute(sql).fetch_df()
    sql_took = time.time() - started
    note = f"sql {sql_took:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return "COLUMNS", len(got), took, f"{sorted(got.columns)} vs {sorted(want.columns)}"
    kinds = [
        (c, kind(got[c].dtype), kind(want[c].dtype))
        for c in got.columns
        if len(got) and kind(got[c].dtype) != kind(want[c].dtype)
        and not (got[c].isna().any() or want[c].isna().any())
    ]
    if kinds:
        note += f" DTYPES {kinds}"
    a, b = rows(got), rows(want)
    if a != b:
        extra = [r for r in a if r not in set(b)][:3]
        missing = [r for r in b if r not in set(a)][:3]
        return "DIFF", len(got), took, f"{len(got)} vs {len(want)} rows; spark-only {extra}; sql-only {missing}"
    return "ok" if not kinds else "ok?", len(got), took, note


def main(argv):
    folder = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        folder, argv = argv[1], argv[2:]
    from parlance.session import build_session

    import __spark_entry__ as entry

    spark = build_session("oracle", 8, **{"spark.ui.showConsoleProgress": "false"})
    con = connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if argv and not any(a in name for a in argv):
            continue
        try:
            status, n, took, note = compare(spark, con, folder, name, fn, oracle.get(name))
        except Exception as e:  # noqa: BLE001
            status, n, took, note = "ERROR", 0, 0.0, str(e)[:1500]
        bad += status not in ("ok", "rows-only")
        print(f"{status:10} {name:34} rows={n:<7} {took:5.1f}s {note}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
