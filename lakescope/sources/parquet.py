"""Row groups of Parquet files and the values of their string leaves, in Arrow-batched tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stores import Stores, dealt

#: Rows of a column that are decoded at once, and bytes of a column chunk that are read at once.
ROWS, BUFFER = 256, 1 << 20


def opened(stores: Stores, uri: str) -> pq.ParquetFile | None:
    """A stored file; none if it is not there."""
    try:
        return pq.ParquetFile(stores.seekable(uri), buffer_size=BUFFER)
    except FileNotFoundError:
        return None


def string_leaves(file: pq.ParquetFile) -> list[str]:
    """Paths of leaves of the physical type BYTE_ARRAY, those of lists and maps included; decimals are not text."""
    columns = (file.schema.column(i) for i in range(len(file.schema)))
    return [c.path for c in columns if c.physical_type == "BYTE_ARRAY" and c.logical_type.type != "DECIMAL"]


def flat(values: pa.Array) -> pa.Array:
    """The non-null values of a column that was read for one leaf alone."""
    while True:
        kind = values.type
        if isinstance(values, pa.ExtensionArray):
            values = values.storage
        elif pa.types.is_dictionary(kind):
            values = values.dictionary_decode()
        elif pa.types.is_struct(kind):
            values = values.flatten()[0]
        elif pa.types.is_nested(kind):
            values = values.flatten()
        else:
            return values.drop_null().cast(pa.binary())


def first_values(file: pq.ParquetFile, group: int, leaf: str, most: int) -> Iterator[pa.Array]:
    """The first non-null values of a leaf in a row group, no more than most."""
    for batch in file.iter_batches(ROWS, row_groups=[group], columns=[leaf]):
        out = flat(batch.column(0))[:most]
        most -= len(out)
        if len(out):
            yield out
        if not most:
            return


def groups(paths: DataFrame) -> DataFrame:
    """paths(path) -> a row (path, row_group) for each row group that a file's footer names. Files that are not there have none."""
    stores = Stores.of(paths.sparkSession)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                n = file.num_row_groups if (file := opened(stores, path)) else 0
                yield pa.record_batch([pa.array([path] * n, pa.string()), pa.array(range(n), pa.int32())], names=["path", "row_group"])

    return dealt(paths.select("path"), "path").mapInArrow(run, "path string, row_group int")


def values(chosen: DataFrame, per_group: int) -> DataFrame:
    """chosen(path, row_group) -> (path, row_group, column, value): of every string leaf the first per_group non-null values."""
    stores = Stores.of(chosen.sparkSession)

    def run(batches):
        for batch in batches:
            for path, group in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file := opened(stores, path)) is None:
                    continue
                for leaf in string_leaves(file):
                    for found in first_values(file, group, leaf, per_group):
                        n = len(found)
                        yield pa.record_batch([pa.array([path] * n, pa.string()), pa.array([group] * n, pa.int32()), pa.array([leaf] * n, pa.string()), found], names=["path", "row_group", "column", "value"])

    return dealt(chosen.select("path", "row_group"), "path", "row_group").mapInArrow(run, "path string, row_group int, column string, value binary").withColumn("value", F.col("value").cast("string"))
