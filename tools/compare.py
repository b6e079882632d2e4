"""Run named queries and their SQL side by side.

python tools/compare.py [folder] [name ...]: the named queries, or all that have SQL;
"rows-only" as a name stands for those that have none.
"""

from __future__ import annotations

import glob
import importlib.util
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from apronflow.session import local_session  # noqa: E402


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(picked, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree in columns, row count and values."""
    columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected_columns, expected = rows_of(names, result.fetchall())
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}"
    for a, b in zip(got, expected):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{columns}: {a} != {b}"
    return None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    entry, spark, con = load_entry(), local_session(8), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = []
    chosen = sys.argv[2:] or list(oracles)
    if chosen == ["rows-only"]:
        chosen = [name for name in queries if name not in oracles]
    for name in chosen:
        started = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem = difference(df, con, oracles[name])
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        if problem:
            failed.append(name)
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - started:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
