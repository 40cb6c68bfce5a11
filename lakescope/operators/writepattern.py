"""How a table is written to, from the intervals between its last commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import median, root

# Commits looked at, the longest streaming and the shortest batch interval, and the keys of a commit's summary.
LAST, STREAMING_MS, BATCH_MS = 50, 300_000, 3_600_000
ADDED_FILES = ("added-data-files", "added-files-count", "added-files")


def summary_files(summary: Column) -> Column:
    """The first of the keys whose value is a signed whole number, else 0."""
    values = [F.when(summary[k].rlike(r"^[+-]?[0-9]+\z"), summary[k].try_cast("bigint")) for k in ADDED_FILES]
    return F.coalesce(*values, F.lit(0))


def last_commits(snapshots: DataFrame, n: int = LAST) -> DataFrame:
    """Each table's last n snapshots by time, later array positions last among equal times."""
    order = Window.partitionBy("table_id").orderBy(F.desc("timestamp_ms"), F.desc("pos"))
    return snapshots.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def deltas(snapshots: DataFrame, n: int = LAST) -> DataFrame:
    """Last commits with the time since the one before, at least 0 and null for the first."""
    order = Window.partitionBy("table_id").orderBy("timestamp_ms", "pos")
    return last_commits(snapshots, n).withColumn("delta_ms", F.greatest(F.lit(0), F.col("timestamp_ms") - F.lag("timestamp_ms").over(order)) + F.lag(F.lit(0)).over(order))


def patterns(snapshots: DataFrame, n: int = LAST, streaming_ms: int = STREAMING_MS, batch_ms: int = BATCH_MS, sqrt_mode: str = "true") -> DataFrame:
    """snapshots(table_id, pos, timestamp_ms, added_files) -> a row per table with its pattern and what it rests on."""
    per = deltas(snapshots, n).groupBy("table_id").agg(
        F.count(F.lit(1)).alias("commits"),
        F.coalesce(F.floor(F.sum("delta_ms") / F.count("delta_ms")), F.lit(0)).cast("long").alias("mean_ms"),
        F.coalesce(median(F.col("delta_ms")), F.lit(0)).cast("long").alias("median_ms"),
        F.count("delta_ms").alias("_n"), F.avg("delta_ms").alias("_mean"), F.var_pop("delta_ms").alias("_var"),
        F.coalesce(F.avg(F.when(F.col("added_files") > 0, F.col("added_files"))), F.lit(0.0)).alias("_files"),
    )
    cv = F.when((F.col("_n") < 2) | (F.col("_mean") == 0), 0.0).otherwise(root(F.col("_var"), sqrt_mode) / F.col("_mean"))
    few = F.col("commits") < 2
    middle = F.col("median_ms")
    pattern = (
        F.when(few, "unknown").when(F.col("cv") > 1.0, "mixed").when((middle > 0) & (middle <= streaming_ms), "streaming")
        .when(middle >= batch_ms, "batch").otherwise("mixed")
    )
    return per.withColumn("cv", cv).withColumn("pattern", pattern).withColumn("files_per_commit", F.when(few, 0.0).otherwise(F.col("_files"))).drop("_n", "_mean", "_var", "_files")
