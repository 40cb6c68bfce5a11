"""Listings of stored objects: (table_id, uri, size_bytes, updated_at_ms)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .stores import Stores, dealt

OBJECT = "table_id string, uri string, size_bytes long, updated_at_ms long"
#: Rows of a listing in one batch.
ROWS = 10_000


def listed(spark: SparkSession, prefixes: DataFrame) -> DataFrame:
    """prefixes(table_id, prefix) -> objects below each. Nothing is listed on the driver.

    Two levels of folders are listed first and dealt out; a task lists what is below its own, folder by folder.
    An unknown scheme is an error.
    """
    stores = Stores.of(spark)

    def batches_of(rows, schema: str):
        kinds = {"string": pa.string(), "long": pa.int64()}
        names = [x.split() for x in schema.split(", ")]
        for at in range(0, len(rows) or 1, ROWS):
            columns = list(zip(*rows[at:at + ROWS], strict=True)) or [[] for _ in names]
            yield pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])

    def rows_in(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def level(batches):
        """Folders (no size) to what lies in them; files pass."""
        rows = []
        for table, uri, size, changed in rows_in(batches):
            if size is None:
                files, folders = stores.level(uri)
                rows += [(table, *f) for f in files] + [(table, f, None, None) for f in folders]
            else:
                rows.append((table, uri, size, changed))
            if len(rows) >= ROWS:
                yield from batches_of(rows, OBJECT)
                rows = []
        yield from batches_of(rows, OBJECT)

    def below(batches):
        """Folders to all files below them; files pass."""
        files = []
        for table, uri, size, changed in rows_in(batches):
            if size is not None:
                files.append((table, uri, size, changed))
            else:
                for found in stores.walk(uri):
                    files += [(table, *f) for f in found]
                    if len(files) >= ROWS:
                        yield from batches_of(files, OBJECT)
                        files = []
            if len(files) >= ROWS:
                yield from batches_of(files, OBJECT)
                files = []
        yield from batches_of(files, OBJECT)

    top = prefixes.selectExpr("table_id", "prefix AS uri", "CAST(NULL AS LONG) AS size_bytes", "CAST(NULL AS LONG) AS updated_at_ms")
    for work in (level, level, below):
        top = dealt(top, "uri").mapInArrow(work, OBJECT)
    return top
