"""Side-by-side run of registered queries and their SQL twins.

    python tests/check.py [sf] [name-part ...]
"""

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(repr(r[i]) if not isinstance(r[i], int) or isinstance(r[i], bool) else repr(int(r[i])) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out)


def compare(spark, con, sf_dir, run, sql):
    df = run(spark, sf_dir)
    got_c, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return (None if got else False), f"{len(got)} rows"
    rel = con.execute(sql)
    want_c, want = canonical([d[0] for d in rel.description], rel.fetchall())
    if got_c != want_c:
        return False, f"columns {got_c} vs {want_c}"
    if got == want:
        return True, f"{len(got)} rows"
    a, b = set(got) - set(want), set(want) - set(got)
    return False, f"{len(got)} vs {len(want)} rows; {len(a)} differ\n   spark {sorted(a)[:3]}\n   sql   {sorted(b)[:3]}"


if __name__ == "__main__":
    from kelvingrid.registry import ORACLES, QUERIES
    from kelvingrid.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, run in QUERIES.items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        begin = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, run, ORACLES.get(name))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += ok is False
        mark = {True: "ok  ", None: "rows", False: "FAIL"}[ok]
        if ok is False or len(parts) or time.time() - begin > 4:
            print(f"{mark} {name} {time.time() - begin:.1f}s {note}", flush=True)
    print("failed:", bad)
