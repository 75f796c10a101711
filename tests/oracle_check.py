"""Compare catalogued queries with their SQL in DuckDB: columns, types, rows, values.

    python tests/oracle_check.py [--sf 0.01] [--explain] [key ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402
from eventlens.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda x: tuple((v is None, str(type(v)), str(v)) for v in x))


def compare(spark, con, key: str, sf_dir: str) -> list[str]:
    """Differences found; empty if the two agree."""
    df = entry.queries()[key](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    text = entry.oracle_sql().get(key)
    if text is None:
        return [] if got else ["no rows"]
    rel = con.execute(text)
    columns = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    problems = []
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(df.columns)} against {sorted(columns)}"]
    for f in df.schema:
        if KINDS.get(f.dataType.simpleString()) != types[f.name] and want:
            problems.append(f"type of {f.name}: {f.dataType.simpleString()} against {types[f.name]}")
    a, b = _rows(df.columns, got), _rows(columns, want)
    if len(a) != len(b):
        problems.append(f"rows: {len(a)} against {len(b)}")
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        problems.append(f"{len(bad)} rows differ; first: {bad[:1]} ({sorted(columns)})")
    return problems


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--explain", action="store_true")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session("oracle", 8, **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for key in entry.queries():
        if args.keys and not any(key.startswith(k) for k in args.keys):
            continue
        start = time.time()
        try:
            if args.explain:
                entry.queries()[key](spark, sf_dir).explain("formatted")
            problems = compare(spark, con, key, sf_dir)
        except Exception as exc:
            problems = [f"{type(exc).__name__}: {str(exc)[:700]}"]
        print(f"{'FAIL' if problems else 'ok':<5}{key:<40}{time.time() - start:6.2f}s  {'; '.join(problems)[:1200]}", flush=True)
        if problems:
            failed.append(key)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
