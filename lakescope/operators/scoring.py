"""Health dimensions and the composite score, over one row of statistics per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import duration_text
from .stats import MIB

DAY = 86_400_000
# Thresholds, severities with their ranks, and the dimensions in order.
THRESHOLDS = {
    "min_file_bytes": 128 * MIB, "warn_file_bytes": 64 * MIB, "manifests_warn": 2000, "manifests_crit": 5000, "age_warn_ms": 30 * DAY,
    "age_crit_ms": 90 * DAY, "snapshots_warn": 100, "snapshots_crit": 500, "delete_ratio_warn": 0.10, "delete_ratio_crit": 0.25,
}
RANKS = {"OK": 1, "INFO": 2, "WARNING": 3, "CRITICAL": 4}
DIMENSIONS = ("file_size", "delete_amplification", "manifest_density", "snapshot", "partition_skew", "format_version")
SKEW_WARN, SKEW_CRIT = 0.5, 1.0
DIMENSION = "struct<name:string,score:int,max_score:int,severity:string,summary:string,remediation:string>"


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in RANKS.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def with_thresholds(stats: DataFrame, **over) -> DataFrame:
    """Threshold columns where the frame has none: defaults, or the given values."""
    have = set(stats.columns)
    return stats.withColumns({k: F.lit(over.get(k, v)) for k, v in THRESHOLDS.items() if k not in have})


def relaxed_min_bytes(pattern: Column, least: Column) -> Column:
    """The file size that streaming writers are held to: a quarter, at least 16 MiB."""
    return F.when(pattern == "streaming", F.greatest(F.floor(least / 4).cast("long"), F.lit(16 * MIB))).otherwise(least.cast("long"))


def _dimension(name: str, most: int, *cases: tuple) -> Column:
    """The first case that holds: (condition or None, severity, score, summary, remediation)."""
    out = None
    for condition, severity, score, summary, remedy in reversed(cases):
        one = F.struct(
            F.lit(name).alias("name"), F.lit(score).cast("int").alias("score"), F.lit(most).cast("int").alias("max_score"), F.lit(severity).alias("severity"),
            (summary if isinstance(summary, Column) else F.lit(summary)).alias("summary"), F.lit(remedy).alias("remediation"),
        )
        out = one if condition is None else F.when(condition, one).otherwise(out)
    return out.cast(DIMENSION)


def _whole(x: Column) -> Column:
    return F.bround(x, 0).cast("long").cast("string")


def _tenth(x: Column) -> Column:
    return F.format_string("%.1f", F.bround(x, 1))


def file_size(effective: bool = False) -> Column:
    """Share of data files under 128 MiB. effective=True counts under the policy's own size, where small_effective is given."""
    n = F.col("data_files")
    frac = F.col("small_effective" if effective else "small_128") / n
    least = F.floor(F.col("min_file_bytes") / MIB).cast("long").cast("string")
    text = F.concat(_whole(frac * 100), F.lit("% of files below "), least, F.lit("MB"))
    return _dimension(
        "file_size", 20,
        (n == 0, "OK", 20, "no data files", ""),
        (frac >= 0.5, "CRITICAL", 8, text, "rewrite_data_files (target=512MB) recommended"),
        (frac >= 0.25, "WARNING", 12, text, "schedule rewrite_data_files when convenient"),
        (None, "OK", 20, text, ""),
    )


def delete_amplification() -> Column:
    deletes = F.col("position_deletes") + F.col("equality_deletes")
    ratio = deletes / F.col("data_files")
    text = F.concat(deletes.cast("string"), F.lit(" delete files ("), F.col("position_deletes").cast("string"), F.lit(" position, "), F.col("equality_deletes").cast("string"), F.lit(" equality); ratio "), _tenth(ratio * 100), F.lit("%"))
    return _dimension(
        "delete_amplification", 20,
        (F.col("format_version") < 2, "OK", 20, "delete files not applicable for v1 tables", ""),
        (deletes == 0, "OK", 20, "no delete files present", ""),
        (F.col("data_files") == 0, "OK", 20, "delete files present but no data files (table may be empty)", ""),
        (ratio >= F.col("delete_ratio_crit"), "CRITICAL", 6, text, "rewrite_position_deletes / rewrite_data_files urgent"),
        (ratio >= F.col("delete_ratio_warn"), "WARNING", 12, text, "schedule delete-file compaction"),
        (None, "OK", 20, text, ""),
    )


def manifest_density() -> Column:
    n = F.col("manifest_count")
    text = F.concat(n.cast("string"), F.lit(" manifest files"))
    return _dimension(
        "manifest_density", 15,
        (n >= F.col("manifests_crit"), "CRITICAL", 5, text, "rewrite_manifests recommended"),
        (n >= F.col("manifests_warn"), "WARNING", 9, text, "consider rewrite_manifests"),
        (None, "OK", 15, text, ""),
    )


def snapshot() -> Column:
    n, age = F.col("snapshot_count"), F.col("oldest_age_ms")
    text = F.concat(n.cast("string"), F.lit(" snapshots; oldest "), duration_text(age))
    return _dimension(
        "snapshot", 15,
        ((age >= F.col("age_crit_ms")) | (n >= F.col("snapshots_crit")), "CRITICAL", 5, text, "expire_snapshots --older-than=30d"),
        ((age >= F.col("age_warn_ms")) | (n >= F.col("snapshots_warn")), "WARNING", 10, text, "schedule expire_snapshots"),
        (None, "OK", 15, text, ""),
    )


def partition_skew() -> Column:
    n, cv = F.col("partitions"), F.col("cv")
    text = F.concat(F.lit("CV="), F.format_string("%.2f", F.bround(cv, 2)), F.lit(" across "), n.cast("string"), F.lit(" partitions ("), F.col("hot").cast("string"), F.lit(" hot, "), F.col("sparse").cast("string"), F.lit(" sparse)"))
    return _dimension(
        "partition_skew", 15,
        (n < 2, "OK", 15, "single partition or unpartitioned — skew not applicable", ""),
        (cv >= SKEW_CRIT, "CRITICAL", 5, text, "re-partition hot keys or bucket the partition column"),
        (cv >= SKEW_WARN, "WARNING", 9, text, "consider bucketing or re-partitioning hot keys"),
        (None, "OK", 15, text, ""),
    )


def format_version() -> Column:
    v = F.col("format_version")
    return _dimension(
        "format_version", 5,
        (v == 1, "INFO", 3, "Iceberg v1 — v2 upgrade available", "ALTER TABLE ... SET TBLPROPERTIES ('format-version'='2')"),
        (v == 2, "OK", 5, "Iceberg v2", ""),
        (v == 3, "OK", 5, "Iceberg v3 (latest)", ""),
        (None, "INFO", 3, F.concat(F.lit("unknown format-version "), v.cast("string")), ""),
    )


def dimensions(stats: DataFrame, effective: bool = False) -> DataFrame:
    """A row per table and dimension: table_id, pos, and the dimension's fields."""
    each = F.array(file_size(effective), delete_amplification(), manifest_density(), snapshot(), partition_skew(), format_version())
    return with_thresholds(stats).select("table_id", F.posexplode(each).alias("pos", "d")).select("table_id", "pos", "d.*")


def composite(dims: DataFrame) -> DataFrame:
    """Per table: the scores' sum, their maximum and the worst severity."""
    return dims.groupBy("table_id").agg(
        F.sum("score").cast("int").alias("score"), F.sum("max_score").cast("int").alias("max_score"), F.max_by("severity", severity_rank(F.col("severity"))).alias("worst_severity")
    )


def reports(dims: DataFrame) -> DataFrame:
    """composite, with the dimensions in order as an array."""
    fields = F.struct("pos", "name", "score", "max_score", "severity", "summary", "remediation")
    listed = dims.groupBy("table_id").agg(F.array_sort(F.collect_list(fields)).alias("dimensions"))
    return composite(dims).join(listed, "table_id")
