"""Compare registered queries with their SQL on one scale factor.

Usage: python -m tests.crosscheck [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


SAME = {
    "VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "FLOAT": "float",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def compare(spark, con, query, sql, sf_dir):
    """None when equal, else a short description of the first difference."""
    df = query(spark, sf_dir)
    ours, our_names = rows_of(df.columns, [tuple(r) for r in df.collect()])
    done = con.execute(sql)
    theirs, their_names = rows_of([d[0] for d in done.description], done.fetchall())
    kinds = {n: t for n, t in df.dtypes}
    other = {d[0]: SAME.get(str(d[1]), str(d[1])) for d in done.description}
    if our_names == their_names and any(kinds[n] != other[n] for n in kinds):
        return f"types { {n: (kinds[n], other[n]) for n in kinds if kinds[n] != other[n]} }"
    if our_names != their_names:
        return f"columns {our_names} / {their_names}"
    if len(ours) != len(theirs):
        extra = [r for r in ours if r not in set(theirs)][:1] + [r for r in theirs if r not in set(ours)][:1]
        return f"rows {len(ours)} / {len(theirs)} e.g. {repr(extra)[:600]}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows differ, first {repr(bad[0])[:900]}" if bad else None


def main(argv):
    from ledgerleaf.session import build_session
    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv[1:] or queries:
        start = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, queries[name], oracle[name], sf_dir)
            else:
                problem = None if queries[name](spark, sf_dir).count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = "error " + str(error)[:700]
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {'' if name in oracle else '(rows only)'} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
