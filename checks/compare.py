"""Run registered queries on Spark and their SQL texts on DuckDB and compare the rows.

python checks/compare.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value == int(value) and abs(value) < 1e15 else round(value, 9))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    from revgrain.plans import catalog

    start = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    table = df.toArrow()
    took = time.time() - start
    columns = sorted(df.columns)
    rows = Counter(zip(*[[plain(v) for v in table.column(c).to_pylist()] for c in columns]))
    n = table.num_rows
    if name not in catalog.ORACLES:
        return n > 0, f"{n} rows, no SQL, {took:.1f}s"
    other = con.execute(catalog.ORACLES[name]).to_arrow_table()
    if sorted(other.column_names) != columns:
        return False, f"columns {columns} against {sorted(other.column_names)}"
    kinds = []
    for c in columns:
        a, b = str(table.schema.field(c).type), str(other.schema.field(c).type)
        if a != b and {a, b} - {"string", "large_string"}:
            kinds.append(f"{c}:{a}/{b}")
    expected = Counter(zip(*[[plain(v) for v in other.column(c).to_pylist()] for c in columns]))
    note = f"{n} rows, {took:.1f}s" + (f" types {kinds}" if kinds else "")
    if rows != expected:
        return False, f"{note}; {other.num_rows} expected; only Spark {list((rows - expected).items())[:3]}; only SQL {list((expected - rows).items())[:3]}"
    return True, note if n else note + " EMPTY"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from revgrain.plans import catalog
    from revgrain.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(args.sf)
    names = [n for n in catalog.QUERIES if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    bad = 0
    began = time.time()
    for name in names:
        try:
            ok, note = compare(spark, con, name, args.sf)
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:900]}"
        bad += not ok
        print(f"{time.time() - began:.0f}s {name}", file=sys.stderr, flush=True)
        if not ok or "types" in note or "EMPTY" in note or len(names) < 12:
            print("ok " if ok else "BAD", name, note, flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
