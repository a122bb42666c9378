"""Run registered queries against their DuckDB twins and compare whole results."""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(normal(v) for v in value) + "]"
    return repr(value)


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    twin_types = {d[0]: str(d[1]) for d in cursor.description}
    theirs = cursor.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return False, f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    ordered = sorted(names)
    mine = sorted([normal(v) for v in row] for row in spark_df.select(*ordered).collect())
    index = [names.index(n) for n in ordered]
    other = sorted([normal(row[i]) for i in index] for row in theirs)
    note = f"{len(mine)} rows"
    if len(mine) != len(other):
        return False, f"rows {len(mine)} vs {len(other)}; mine {mine[:2]} twin {other[:2]} {ordered}"
    for a, b in zip(mine, other):
        if a != b:
            return False, f"{ordered}: {a} vs {b}  ({len(mine)} rows)"
    types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = [f"{n}:{types[n]}/{twin_types[n]}" for n in ordered if kinds.get(types[n]) != twin_types[n]]
    return True, note + (f"  types {odd}" if odd else "")


def main() -> int:
    from alertweft.session import local_session
    import __spark_entry__ as entry

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    queries, twins = entry.queries(), entry.oracle_sql()
    wanted = [n for n in queries if not args.names or any(n == a or n.startswith(a) for a in args.names)]
    spark, con, bad = local_session(), connect(folder), []
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in twins:
                ok, note = compare(df, con, twins[name])
            else:
                ok, note = True, f"{df.count()} rows (no twin)"
        except Exception as error:  # noqa: BLE001
            ok, note = False, "ERROR " + " ".join(str(error).split("JVM stacktrace")[0].split())[:330]
        if not ok:
            bad.append(name)
        print(f"{'ok  ' if ok else 'BAD '} {name:8s} {time.time() - start:6.2f}s  {note[:420]}", flush=True)
    print(f"{len(wanted) - len(bad)}/{len(wanted)} agree; bad: {bad}")
    return bool(bad)


if __name__ == "__main__":
    raise SystemExit(main())
