"""Runs registered queries beside their SQL and compares the rows regardless of order."""

from __future__ import annotations

import math

import duckdb

from tallyforge.checks import ORACLES, QUERIES
from tallyforge.sources.samples import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "~" if value is None else f"{type(value).__name__}:{value}"


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(_plain(row[c]) for c in columns) for row in df.collect())
    if name not in ORACLES:
        return len(got) > 0, f"{len(got)} rows, no SQL"
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return False, f"columns {columns} vs {sorted(names)}"
    places = [names.index(c) for c in columns]
    want = sorted(tuple(_plain(row[p]) for p in places) for row in result.fetchall())
    if got == want:
        return len(got) > 0, f"{len(got)} rows"
    extra = sorted(set(got) - set(want))[:3]
    lost = sorted(set(want) - set(got))[:3]
    return False, f"{len(got)} vs {len(want)} rows of {columns}\n  spark only {extra}\n  sql only   {lost}"


if __name__ == "__main__":
    import sys
    import time

    from tallyforge.session import local_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    wanted = [n for n in QUERIES if len(sys.argv) < 3 or any(n.startswith(p) for p in sys.argv[2:])]
    session, connection = local_session(), connect(folder)
    bad = 0
    for query in wanted:
        start = time.time()
        try:
            ok, note = compare(session, connection, folder, query)
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, note = False, str(error)[:700]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {query} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} match")
