"""Sampling of real Parquet files for personal data."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_tables import entry, table

from lakescope.operators import pii
from lakescope.plans import audit
from lakescope.sources import catalogs


@pytest.fixture
def saved(tmp_path):
    """Writes a table of one file; gives what finds its personal data."""
    def save(spark, columns, group, **options):
        base = table(str(tmp_path), "one", [entry(f"{tmp_path}/db/one/data/f.parquet")])
        pq.write_table(pa.table(columns), f"{base}/data/f.parquet", row_group_size=group)
        return {(f["column"], f["pii_type"]): (f["match_count"], f["sample_count"]) for f in audit.pii(spark, catalogs.LocalCatalog(str(tmp_path)), "db.one", **options)[1]}

    return save


def test_values_after_nulls(spark, saved):
    mails = [None] * 3000 + [f"u{k}@mail.example.org" for k in range(2000)]
    assert saved(spark, {"mail": mails, "note": ["plain"] * 5000}, 5000) == {("mail", "EMAIL"): (1024, 1024)}


def test_real_row_groups(spark, saved):
    mails = ["none"] * 1000 + [f"u{k}@mail.example.org" for k in range(4000)]
    assert saved(spark, {"mail": mails}, 1000, fraction=1.0, per_group=100) == {("mail", "EMAIL"): (400, 500)}


NESTED = {
    "tags": ("array<string>", "array('a@b.org', null, 'c@d.org')"), "deep": ("array<array<string>>", "array(array('x'), null, array('y', 'z'))"),
    "people": ("array<struct<mail:string,n:int>>", "array(named_struct('mail', 'p@q.org', 'n', 1), null)"), "by": ("map<string,string>", "map('k', 'm@n.org', 'l', null)"),
    "lists": ("map<string,array<string>>", "map('k', array('s', 't'))"), "box": ("struct<all:array<string>>", "named_struct('all', array('u', null))"), "plain": ("string", "'v'"), "n": ("int", "1"),
}
LEAVES = {
    "tags.list.element": ["a@b.org", "c@d.org"], "deep.list.element.list.element": ["x", "y", "z"], "people.list.element.mail": ["p@q.org"], "by.key_value.key": ["k", "l"], "by.key_value.value": ["m@n.org"],
    "lists.key_value.key": ["k"], "lists.key_value.value.list.element": ["s", "t"], "box.all.list.element": ["u"], "plain": ["v"],
}


def test_nested_cells(spark):
    row = spark.sql("select " + ", ".join(f"cast({v} as {kind}) as {name}" for name, (kind, v) in NESTED.items()))
    rows = row.unionByName(spark.sql("select " + ", ".join(f"cast(null as {kind}) as {name}" for name, (kind, _) in NESTED.items())))
    assert pii.string_columns(rows.schema) == list(LEAVES)
    for columns in (list(LEAVES), ["tags.list.element"], ["plain"], ["by.key_value.value", "plain"]):
        got = [tuple(r) for r in pii.cells(rows, columns).collect()]
        assert sorted(got) == sorted((c, v) for c in columns for v in LEAVES[c])


def test_nested_leaves_of_files(spark, saved):
    """A table whose personal data stands in lists, structs in lists and maps alone."""
    n = 50
    mails = [[f"u{k}@mail.example.org", None] for k in range(n)]
    columns = {
        "tags": pa.array(mails, pa.list_(pa.string())), "people": pa.array([[{"ssn": "123-45-6789"}] if k % 2 else None for k in range(n)], pa.list_(pa.struct({"ssn": pa.string()}))),
        "by": pa.array([[("k", f"u{k}@mail.example.org")] for k in range(n)], pa.map_(pa.string(), pa.string())),
    }
    assert saved(spark, columns, 20, fraction=1.0) == {
        ("tags.list.element", "EMAIL"): (n, n), ("people.list.element.ssn", "SSN_US"): (n // 2, n // 2), ("by.key_value.value", "EMAIL"): (n, n),
    }
