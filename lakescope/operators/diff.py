"""Before and after: two captures of the same tables' statistics and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import delta_text

METRICS = ("score", "data_files", "manifest_count", "position_deletes", "equality_deletes")


def average_bytes(frame: DataFrame) -> DataFrame:
    """With avg_file_bytes: a whole number, 0 without files."""
    return frame.withColumn("avg_file_bytes", F.when(F.col("data_files") == 0, 0).otherwise(F.expr("data_bytes div data_files")).cast("long"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per table of both: each metric before and after, its change as number and text; the average file size."""
    a, b = (average_bytes(x).select("table_id", *METRICS, "avg_file_bytes") for x in (before, after))
    both = a.toDF("table_id", *(f"{c}_before" for c in a.columns[1:])).join(b.toDF("table_id", *(f"{c}_after" for c in b.columns[1:])), "table_id")
    change = {f"{m}_delta": F.col(f"{m}_after") - F.col(f"{m}_before") for m in METRICS}
    text = {f"{m}_change": delta_text(F.col(f"{m}_before"), F.col(f"{m}_after")) for m in METRICS}
    return both.withColumns(change | text)


def long_form(diff: DataFrame) -> DataFrame:
    """A row per table and metric: before, after, delta."""
    rows = ", ".join(f"'{m}', cast({m}_before as bigint), cast({m}_after as bigint), cast({m}_delta as bigint)" for m in METRICS)
    return diff.selectExpr("table_id", f"stack({len(METRICS)}, {rows}) as (metric, before, after, delta)")
