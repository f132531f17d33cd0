"""Runs registered queries in Spark and their SQL in DuckDB, and compares the answers.

    python -m tests.parity [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def shaped(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    got = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(got, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(spark_df, con, sql: str) -> str | None:
    """None if the answers are equal, else what differs."""
    names, rows = shaped(spark_df.columns, spark_df.collect())
    answer = con.execute(sql)
    want_names, want = shaped([d[0] for d in answer.description], answer.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}"
    bad = [(a, b) for a, b in zip(rows, want) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return f"{len(bad)} of {len(rows)} rows differ, e.g. {names} {bad[0]}" if bad else None


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from sparkmetrica.session import get_session

    folder = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    wanted = [a for a in argv if not a.startswith("/")]
    spark, con = get_session("parity", cores="8"), connect(folder)
    oracles, failed = oracle_sql(), []
    for name, run in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                wrong = compare(run(spark, folder), con, oracles[name])
            else:
                wrong = None if run(spark, folder).collect() else "no rows"
        except Exception as e:  # report and go on with the next query
            wrong = f"{type(e).__name__}: {str(e)[:600]}"
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if wrong else 'ok  '} {kind:4} {time.time() - start:6.2f}s {name} {wrong or ''}", flush=True)
        if wrong:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    sys.exit(main(sys.argv[1:]))
