"""Registered queries against their twins in SQL."""

import duckdb

from lakescope.plans import queries, warehouse

FOLDER = "/root/testdata/sf0.001"


def test_all_partitions(spark):
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{FOLDER}/lineitem.parquet'")
    name = "agg10_partitions_by_bytes"
    got = [tuple(r) for r in queries.QUERIES[name](spark, FOLDER).collect()]
    assert sorted(got) == sorted(con.sql(queries.ORACLE_SQL[name]).fetchall())
    assert got == sorted(got, key=lambda r: (r[0], -r[2], r[1])) and max(r[3] for r in got) > 5


def test_warehouse_of_documents(spark):
    """Queries over a warehouse in the real formats, and single expressions, against their twins."""
    names = {n for n, f in queries.QUERIES.items() if f.__module__ == warehouse.__name__}
    assert len(names) > 20
    con = duckdb.connect()
    for t in ("supplier", "lineitem", "events", "orders", "customer"):
        con.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    for name in sorted(names):
        got = queries.QUERIES[name](spark, FOLDER)
        columns = sorted(got.columns)
        want = con.sql(queries.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        rows = want.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, rows)), name
