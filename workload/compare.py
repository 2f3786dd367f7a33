"""Runs queries against their SQL on one data folder and reports differences.

    python -m workload.compare /root/testdata/sf0.001 [name …]
"""

import decimal
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


_KIND = {"tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int",
         "hugeint": "huge", "varchar": "string", "timestamp_ntz": "timestamp", "float": "float"}


def _kinds(pairs):
    out = {}
    for name, kind in pairs:
        kind = str(kind).lower().split("(")[0]
        out[name] = _KIND.get(kind, kind)
    return out


def differences(spark, con, name, query, sql, sf_dir):
    """(problem or None, rows, seconds)."""
    start = time.time()
    df = query(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return None, len(ours), took
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}", len(ours), took
    kinds = _kinds(df.dtypes), _kinds((c[0], c[1]) for c in cur.description)
    if kinds[0] != kinds[1]:
        odd = {n: (kinds[0][n], kinds[1][n]) for n in names if kinds[0][n] != kinds[1][n]}
        return f"types {odd}", len(ours), took
    a, b = _rows(df.columns, ours), _rows(names, theirs)
    if a == b:
        return None, len(ours), took
    only_a, only_b = list(set(a) - set(b))[:2], list(set(b) - set(a))[:2]
    return (f"{len(a)} rows / {len(b)}; columns {sorted(names)}\n   spark {only_a}\n"
            f"   sql   {only_b}"), len(ours), took


def main(argv):
    from twoclock.session import build_session
    from workload.oracle import ORACLES
    from workload.queries import QUERIES

    sf_dir, wanted = argv[0], argv[1:] or list(QUERIES)
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name in wanted:
        try:
            problem, n, took = differences(spark, con, name, QUERIES[name],
                                           ORACLES.get(name), sf_dir)
        except Exception as exc:  # one broken query must not hide the others
            problem, n, took = f"{type(exc).__name__}: {str(exc)[:600]}", 0, 0.0
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'DIFF'} {name:24} {n:8} rows {took:6.2f}s"
              + (f"\n   {problem}" if problem else ""), flush=True)
    print(f"{len(wanted)} queries, {bad} differ")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
