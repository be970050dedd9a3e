"""Compare registered queries with their SQL oracles. Usage: oracle_check.py SF_DIR [name or prefix* ...]"""

from __future__ import annotations

import fnmatch
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402
from foldspark.plans.registry import TABLES  # noqa: E402


def duck(root: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "null" if v != v else repr(round(v, 6) + 0.0)
    if v is None or v is pd.NaT:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_plain(x)}" for k, x in v.items()) + "}"
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return "[" + ",".join(_plain(x) for x in v) + "]"
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None) if v.tzinfo else v)
    if hasattr(v, "item"):
        return _plain(v.item())
    return str(v)


def rows(table) -> list[tuple]:
    cols = sorted(table.column_names)
    data = [[_plain(x) for x in table.column(c).to_pylist()] for c in cols]
    return sorted(zip(*data)) if data else []


def kinds(table) -> dict[str, str]:
    return {c: str(table.schema.field(c).type).replace("large_", "") for c in sorted(table.column_names)}


def compare(spark, con, root: str, name: str) -> tuple[str, float, float]:
    t0 = time.time()
    got = entry_module.queries()[name](spark, root).toArrow()
    t1 = time.time()
    sql = entry_module.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {got.num_rows}", t1 - t0, 0.0
    want = con.execute(sql).to_arrow_table()
    t2 = time.time()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"COLUMNS {sorted(got.column_names)} != {sorted(want.column_names)}", t1 - t0, t2 - t1
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"ROWS {len(a)} != {len(b)}", t1 - t0, t2 - t1
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"VALUES {len(bad)}/{len(a)} e.g. {bad[0]}", t1 - t0, t2 - t1
    note = "" if kinds(got) == kinds(want) else f" types {set(kinds(got).items()) ^ set(kinds(want).items())}"
    return f"ok {len(a)}{note}", t1 - t0, t2 - t1


def main() -> None:
    from foldspark.session import local_session

    root, patterns = sys.argv[1], sys.argv[2:] or ["*"]
    spark, con = local_session("check"), duck(root)
    for name in entry_module.queries():
        if any(fnmatch.fnmatch(name, p) for p in patterns):
            try:
                verdict, ts, td = compare(spark, con, root, name)
            except Exception as e:  # report and go on
                verdict, ts, td = f"ERROR {type(e).__name__} {str(e)[:700]}", 0, 0
            print(f"{name:36s} {ts:6.2f}s {td:6.2f}s  {verdict[:900]}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
