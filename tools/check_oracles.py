"""Run registered queries and their SQL twins on the same tables and compare all rows.

    python tools/check_oracles.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from caseloom.catalog import ORACLES, QUERIES  # noqa: E402
from caseloom.session import build_session  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else float(f"{value:.10g}") + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return [plain(v) for v in value]
    if hasattr(value, "asDict"):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: plain(v) for k, v in sorted(value.items())}
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((repr([plain(r[i]) for i in order]) for r in rows))


def compare(spark, con, sf: str, name: str) -> tuple[str, float, str]:
    start = time.perf_counter()
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    seconds = time.perf_counter() - start
    if name not in ORACLES:
        return "rows-only", seconds, f"{len(rows)} rows"
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want_names, want = rows_of(names, cur.fetchall())
    got_names, got = rows_of(df.columns, [tuple(r) for r in rows])
    if got_names != want_names:
        return "COLUMNS", seconds, f"{got_names} != {want_names}"
    if got != want:
        off = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return "DIFFERENT", seconds, f"{len(got)} rows against {len(want)}; {str(off)[:600]}"
    kinds = [(str(t), str(d[1])) for t, d in zip((f.dataType.simpleString() for f in df.schema.fields), cur.description)]
    return "equal", seconds, f"{len(rows)} rows {kinds if os.environ.get('SHOW_TYPES') else ''}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for path in glob.glob(f"{args.sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    bad = 0
    names = args.names or list(QUERIES)
    for name in [n for q in names for n in ([q] if q in QUERIES else [x for x in QUERIES if x.startswith(q)])]:
        try:
            state, seconds, note = compare(spark, con, args.sf, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            state, seconds, note = "ERROR", 0.0, f"{type(error).__name__}: {str(error)[:700]}"
        bad += state not in ("equal", "rows-only")
        print(f"{state:10s} {seconds:7.2f}s  {name}  {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
