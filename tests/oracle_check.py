"""Run registered queries next to their check SQL and report differences.

    python -m tests.oracle_check [--sf 0.01] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, ".")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, oracle, sf_dir):
    """Empty text when both sides agree, else what differs."""
    df = query(spark, sf_dir)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if oracle is None:
        return "" if got[1] else "no rows"
    rel = con.execute(oracle)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = rows_of(names, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    bad = {c: (kinds[c], types[c]) for c in kinds if types[c].startswith(("DECIMAL", "HUGEINT"))
           or (kinds[c] in ("double", "float")) != (types[c] in ("DOUBLE", "FLOAT"))}
    if bad:
        return f"types {bad}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    if not got[1]:
        return "both empty"
    diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if diff:
        return f"{len(diff)} of {len(got[1])} rows differ; columns {got[0]}\n   {diff[0][0]}\n   {diff[0][1]}"
    return ""


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from tracewell.session import build_session

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = build_session(cores="8"), connect(sf_dir)
    qs, orc = queries(), oracle_sql()
    failed = 0
    for name in argv or qs:
        t = time.time()
        try:
            text = compare(spark, con, name, qs[name], orc.get(name), sf_dir)
        except Exception as exc:  # report and go on
            text = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += bool(text)
        print(f"{'ok ' if not text else 'BAD'} {time.time() - t:6.1f}s {name} {'' if name in orc else '(rows only)'} {text}",
              flush=True)
    print(f"{failed} failed of {len(argv or qs)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
