"""Compare catalog queries with their SQL on DuckDB: ``python tools/check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if type(v).__name__ == "Decimal":
        return int(v) if v == int(v) else float(v)
    if type(v).__name__ == "datetime":
        return v.replace(tzinfo=None).isoformat()
    return v


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, folder):
    from msgrisk.catalog import ORACLE, QUERIES

    t = time.time()
    df = QUERIES[name](spark, folder)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    if name not in ORACLE:
        return True, f"rows-only {len(got[1])} rows {spent:.1f}s"
    res = con.execute(ORACLE[name])
    want = table_of([c[0] for c in res.description], res.fetchall())
    if got == want:
        return True, f"ok {len(got[1])} rows {spent:.1f}s"
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    only_got = [r for r in got[1] if r not in set(want[1])][:3]
    only_want = [r for r in want[1] if r not in set(got[1])][:3]
    return False, f"rows {len(got[1])} vs {len(want[1])}\n   spark: {only_got}\n   sql:   {only_want}"


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def main(argv):
    sf = argv[0] if argv else "0.001"
    folder = f"/root/testdata/sf{sf}"
    from msgrisk.catalog import QUERIES
    from msgrisk.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    names = argv[1:] or list(QUERIES)
    names = [n for n in QUERIES if any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(("PASS " if ok else "FAIL ") + name, note, flush=True)
    print(f"{len(names) - bad}/{len(names)} passed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) and 1)
