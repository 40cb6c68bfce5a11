"""Reports as metric samples in the Prometheus text format."""

from __future__ import annotations

import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The families in order, with their help texts, and the severities' values.
FAMILIES = {
    "iceberg_table_health_score": "Composite table health score (0..max).",
    "iceberg_table_health_max_score": "Maximum possible health score for the dimensions evaluated.",
    "iceberg_table_dimension_score": "Per-dimension health score.",
    "iceberg_table_dimension_max_score": "Per-dimension maximum possible health score.",
    "iceberg_table_dimension_severity": "Per-dimension severity (0=OK,1=INFO,2=WARNING,3=CRITICAL).",
    "iceberg_table_scan_duration_ms": "Wall-clock duration of the most recent scan.",
    "iceberg_table_estimated_wastage_bytes": "Storage wastage estimate (orphan + over-retained snapshots).",
}
CONTENT_TYPE = "text/plain; version=0.0.4"


def _quoted(value: Column) -> Column:
    v = F.replace(F.replace(F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), v, F.lit('"'))


def labels() -> Column:
    """Of a report, sorted as text; branch and write pattern only where there is one."""
    def pair(name: str, column: str) -> Column:
        return F.concat(F.lit(f"{name}="), _quoted(F.col(column)))

    some = [F.when(F.coalesce(F.col(c), F.lit("")) != "", pair(c, c)) for c in ("branch", "write_pattern")]
    every = [pair("table", "table_id"), pair("catalog", "catalog"), pair("format_version", "format_version")]
    return F.array_join(F.array_sort(F.array_compact(F.array(*every, *some))), ",")


def samples(reports: DataFrame) -> DataFrame:
    """reports(table_id, score, max_score, dimensions, format_version, catalog, branch, write_pattern, scan_ms, wastage_bytes)
    -> family, at (its place), table_id, pos, line: a row per sample."""
    r = reports.withColumn("_l", labels())
    severity = F.when(F.col("d.severity") == "CRITICAL", 3).when(F.col("d.severity") == "WARNING", 2).when(F.col("d.severity") == "INFO", 1).otherwise(0)

    def sample(at: int, value: Column, dimension: bool = False) -> Column:
        family = list(FAMILIES)[at]
        inner = F.concat(F.col("_l"), F.lit(",dimension="), _quoted(F.col("d.name"))) if dimension else F.col("_l")
        return F.struct(F.lit(family).alias("family"), F.lit(at).alias("at"), F.concat(F.lit(family + "{"), inner, F.lit("} "), value.cast("long").cast("string")).alias("line"))

    whole = F.array(sample(0, F.col("score")), sample(1, F.col("max_score")), sample(5, F.col("scan_ms")), sample(6, F.col("wastage_bytes")))
    out = r.select("table_id", F.lit(0).alias("pos"), F.explode(whole).alias("s"))
    each = r.select("table_id", "_l", F.posexplode("dimensions").alias("pos", "d"))
    each = each.select("table_id", "pos", F.explode(F.array(sample(2, F.col("d.score"), True), sample(3, F.col("d.max_score"), True), sample(4, severity, True))).alias("s"))
    return out.unionByName(each).select("s.family", "s.at", "table_id", "pos", "s.line")


def exposition(reports: DataFrame) -> str:
    """The whole page: families in order, their samples by table. Reports are a few rows per table."""
    lines: dict[str, list[str]] = {f: [] for f in FAMILIES}
    for row in samples(reports).orderBy("at", "table_id", "pos").toLocalIterator():
        lines[row["family"]].append(row["line"])
    return "".join(f"# HELP {f} {h}\n# TYPE {f} gauge\n" + "".join(x + "\n" for x in lines[f]) for f, h in FAMILIES.items())


def push(gateway: str, job: str, payload: str, instance: str = "", send=urllib.request.urlopen) -> None:
    """Put the page to a push gateway; a status of 400 or more is an error."""
    if not gateway or not job:
        raise ValueError("a gateway and a job name are required")
    url = gateway.rstrip("/") + "/metrics/job/" + job + (f"/instance/{instance}" if instance else "")
    request = urllib.request.Request(url, payload.encode(), {"Content-Type": CONTENT_TYPE}, method="PUT")
    try:
        with send(request) as answer:
            if answer.status >= 400:
                raise RuntimeError(f"push gateway status {answer.status}")
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"push gateway status {e.code}") from e
