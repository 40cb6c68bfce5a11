"""Columns that hold personal data, from sampled cells. Cell values never leave the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pii import detected

FRACTION, ROWS_PER_GROUP, MAX_FILES, MIN_CONFIDENCE = 0.05, 1024, 16, 0.5
CELLS = "array<struct<column:string,value:string>>"


#: From a column's value to its leaf's: one value, or an array of them below a list or map.
Leaf = tuple[bool, Callable[[Column], Column]]


def _leaves(kind: T.DataType) -> dict[str, Leaf]:
    """String and binary leaves of a type by the rest of their path, with whether they are many and how to reach them."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return {"": (False, lambda v: v.cast("string"))}
    if isinstance(kind, T.StructType):
        return {f".{f.name}{path}": (many, lambda v, name=f.name, at=at: at(v.getField(name))) for f in kind.fields for path, (many, at) in _leaves(f.dataType).items()}
    if isinstance(kind, T.ArrayType):
        return {f".list.element{path}": (True, _each(leaf)) for path, leaf in _leaves(kind.elementType).items()}
    if isinstance(kind, T.MapType):
        sides = {"key": (kind.keyType, F.map_keys), "value": (kind.valueType, F.map_values)}
        return {f".key_value.{side}{path}": (True, lambda v, of=of, at=_each(leaf): at(of(v))) for side, (inner, of) in sides.items() for path, leaf in _leaves(inner).items()}
    return {}


def _each(leaf: Leaf) -> Callable[[Column], Column]:
    """A leaf of an array's elements, as one array; null arrays inside are left out."""
    many, at = leaf
    if many:
        return lambda v: F.flatten(F.array_compact(F.transform(v, lambda x: at(x))))
    return lambda v: F.transform(v, lambda x: at(x))


def _found(schema: T.StructType) -> dict[str, Leaf]:
    return {f"{f.name}{path}": (many, lambda name=f.name, at=at: at(F.col(f"`{name}`"))) for f in schema.fields for path, (many, at) in _leaves(f.dataType).items()}


def string_columns(schema: T.StructType) -> list[str]:
    """Paths of string and binary leaves, structs, arrays and maps entered, as Parquet names them."""
    return list(_found(schema))


def cells(rows: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """Non-null values of the columns, one (column, value) a row, with the kept columns; of arrays and maps, each value."""
    found = _found(rows.schema)

    def cell(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("column"), value.alias("value"))

    single = F.array(*(cell(c, found[c][1]()) for c in columns if not found[c][0]))
    many = [F.coalesce(_each((False, lambda v, c=c: cell(c, v)))(found[c][1]()), F.array().cast(CELLS)) for c in columns if found[c][0]]
    if len(many) == len(columns):
        pairs = F.concat(*many)
    else:
        pairs = F.concat(single, *many) if many else single
    return rows.select(*keep, F.explode(pairs).alias("_cell")).select(*keep, "_cell.*").filter("value is not null")


def findings(values: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """(table_id, column, value) -> table_id, column, pii_type, match_count, sample_count, confidence, recommend_tag.

    Detection runs before any exchange, so only types and counts are shuffled. All sampled cells of a column
    count in the confidence, also those too long to be looked at.
    """
    flags = values.select("table_id", "column", detected(F.col("value")).alias("types"))
    per = flags.groupBy("table_id", "column", "types").agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy("table_id", "column").agg(F.sum("n").alias("sample_count"))
    hits = per.select("table_id", "column", F.explode("types").alias("pii_type"), "n").groupBy("table_id", "column", "pii_type").agg(F.sum("n").alias("match_count"))
    out = hits.join(total, ["table_id", "column"]).withColumn("confidence", F.col("match_count") / F.col("sample_count"))
    return out.filter(F.col("confidence") >= least).withColumn("recommend_tag", F.concat(F.lit("PII_"), F.col("pii_type"))).select(
        "table_id", "column", "pii_type", "match_count", "sample_count", "confidence", "recommend_tag"
    )


def first_files(files: DataFrame, n: int = MAX_FILES) -> DataFrame:
    """Each table's first n live data files in scan order."""
    order = Window.partitionBy("table_id").orderBy("manifest_pos", "entry_pos")
    data = files.filter((F.col("status") != 2) & (F.col("content") == 0))
    return data.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def chosen_groups(groups: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """A hashed share of files' row groups (path, row_group), always the first of a file."""
    chance = F.pmod(F.xxhash64("path", "row_group"), F.lit(1_000_000)) < int(fraction * 1_000_000)
    return groups.filter(chance | (F.col("row_group") == 0))


def sampled(rows: DataFrame, fraction: float = FRACTION, per_group: int = ROWS_PER_GROUP, group_rows: int = 1 << 20) -> DataFrame:
    """Rows of a hashed share of runs of rows, the first per_group of each, always of the first run of a file.

    rows come from a Parquet scan. A run is group_rows rows of one file, whatever the file's row groups; which are
    taken depends on the file and the run alone. Audits sample by row groups and values (chosen_groups) instead.
    """
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    group = F.floor(row / group_rows)
    chance = F.pmod(F.xxhash64(file, group), F.lit(1_000_000)) < int(fraction * 1_000_000)
    return rows.filter((chance | (group == 0)) & (row % group_rows < per_group))
