"""Audits of real tables: from a catalog's entries to reports, a whole namespace in one set of jobs."""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import default_prefix, resolve
from ..operators import cost as cost_ops
from ..operators import diff as diff_ops
from ..operators import migration as migration_ops
from ..operators import orphans as orphan_ops
from ..operators import pii as pii_ops
from ..operators import policy as policy_ops
from ..operators import scoring, stats, writepattern
from ..sources import metadata, objects, parquet
from ..sources.catalogs import Catalog, NotFound
from . import exits


def now() -> int:
    return int(time.time() * 1000)


def tables_of(spark: SparkSession, catalog: Catalog, table: str = "", namespace: str = "") -> DataFrame:
    """The documents of one table or a namespace; a table that is not there, or of an unknown version, ends the run."""
    try:
        entries = catalog.entries(spark, table, namespace)
    except (NotFound, OSError) as e:
        raise exits.Coded(exits.CONNECTION, str(e)) from e
    docs = metadata.read(spark, entries)
    if table and (bad := docs.filter(~F.col("valid")).select("table_id", "format_version").first()):
        raise exits.Coded(exits.CONNECTION, f"{bad[0]}: unsupported format-version {bad[1]}")
    return docs.filter("valid")


def statistics(tables: DataFrame, now_ms: int, branch: str | None = None, doc: policy_ops.Policies | None = None, sqrt_mode: str = "true", effective: bool = False, kept: list[DataFrame] | None = None) -> DataFrame:
    """A row per table: what its snapshots, manifests and files add up to, its write pattern and its thresholds.

    Documents and manifests are read once and cached, entries are added up as they are read; only those that effective
    looks at again are cached. Cached frames are added to kept, for the caller to release.
    """
    tables = tables.select("table_id", "namespace", "format_version", "current_snapshot_id", "metadata_location", "refs", "snapshots").cache()
    snaps = metadata.snapshots(tables)
    chosen = metadata.resolved(tables, branch)
    manifests = metadata.manifests(chosen).cache()
    files = metadata.file_columns(manifests, ("status", "content", "file_size_bytes", "partition_key"))
    if effective:
        files = files.cache()
    if kept is not None:
        kept += (tables, manifests, *([files] if effective else []))
    base = policy_ops.apply(tables.select("table_id", "namespace", "format_version", "current_snapshot_id"), doc)
    pattern = writepattern.patterns(snaps, sqrt_mode=sqrt_mode).select("table_id", F.col("pattern").alias("write_pattern"), "files_per_commit")
    out = stats.table_stats(base, files, manifests, snaps, now_ms, sqrt_mode).join(pattern, "table_id", "left").fillna({"write_pattern": "unknown", "files_per_commit": 0.0})
    out = out.join(chosen.select("table_id", "snapshot_id"), "table_id", "left").withColumn("branch_found", F.col("snapshot_id").isNotNull()).fillna(0, ["snapshot_id"])
    out = out.withColumns({"branch": F.lit(branch or ""), "min_file_bytes": scoring.relaxed_min_bytes(F.col("write_pattern"), F.col("min_file_bytes"))})
    if effective:
        small = stats.live(files).filter("content = 0").join(out.select("table_id", "min_file_bytes"), "table_id")
        small = small.groupBy("table_id").agg(F.count_if(F.col("file_size_bytes") < F.col("min_file_bytes")).alias("small_effective"))
        out = out.join(small, "table_id", "left").fillna(0, ["small_effective"])
    return out


def reports(stat: DataFrame, catalog_name: str = "", scan_ms: int = 0, effective: bool = False) -> DataFrame:
    """Scores of statistics, with what the outputs show beside them."""
    dims = scoring.dimensions(stat, effective)
    beside = stat.select("table_id", "format_version", "snapshot_id", "write_pattern", "branch", "branch_found")
    return scoring.reports(dims).join(beside, "table_id").withColumns({"catalog": F.lit(catalog_name), "scan_ms": F.lit(scan_ms), "wastage_bytes": F.lit(0)})


def release(kept: list[DataFrame]) -> None:
    """Give up cached frames, the last one first."""
    while kept:
        kept.pop().unpersist()


def audit(spark: SparkSession, catalog: Catalog, table: str = "", namespace: str = "", now_ms: int | None = None, kept: list[DataFrame] | None = None, **options) -> DataFrame:
    """Health reports. Options: branch, doc (policies), sqrt_mode, effective.

    Only the statistics, a row per table, stay cached; their frame is added to kept, for who audits again and again.
    """
    began, read_ = time.time(), []
    stat = statistics(tables_of(spark, catalog, table, namespace), now_ms or now(), kept=read_, **options).cache()
    try:
        stat.count()
    except BaseException:
        stat.unpersist()
        raise
    finally:
        release(read_)
    if kept is not None:
        kept.append(stat)
    return reports(stat, catalog.name, int((time.time() - began) * 1000), options.get("effective", False))


def references(tables: DataFrame) -> DataFrame:
    """Everything any snapshot refers to; a list or manifest that several snapshots share is read once."""
    snaps = metadata.lists(tables)
    at = F.col("metadata_location")
    own = tables.select("table_id", at.alias("uri"))
    lists = snaps.filter("manifest_list <> ''").select("table_id", resolve(at, F.col("manifest_list")).alias("uri"))
    once = metadata.manifests(snaps).select("table_id", "base", "path").distinct()
    paths = once.select("table_id", F.col("path").alias("uri"))
    files = metadata.file_columns(once, ("file_path",), keep=("table_id", "base"))
    named = files.select("table_id", resolve(F.col("base"), F.col("file_path")).alias("uri"))
    return orphan_ops.active(own, lists, paths, named)


def orphans(spark: SparkSession, catalog: Catalog, table: str, prefix: str = "", grace_ms: int = orphan_ops.GRACE_MS, preview: int = 25, now_ms: int | None = None) -> dict:
    """What lies below the table's data folder and is referred to by nothing: totals and the largest candidates."""
    tables = tables_of(spark, catalog, table)
    row = tables.select("location", "current_snapshot_id").first()
    if not prefix:
        if not row["location"]:
            raise exits.Coded(exits.CONFIG, "the table has no location; give a data prefix")
        prefix = tables.select(default_prefix(F.col("location"))).first()[0]
    moment = now_ms or now()
    listing = objects.listed(spark, tables.select("table_id", F.lit(prefix).alias("prefix"))).cache()
    live = references(tables).cache()
    found = orphan_ops.orphans(listing, live, moment, grace_ms)
    total = orphan_ops.totals(listing, found, live).first()
    shown = [r.asDict() for r in orphan_ops.preview(found, preview).orderBy(F.desc("size_bytes"), "uri").collect()]
    return {"table_id": table, "prefix": prefix, "snapshot_id": row["current_snapshot_id"], "grace_ms": grace_ms, "scanned_at_ms": moment, **{k: total[k] for k in ("active_files", "scanned_objects", "candidates", "total_bytes")}, "preview": shown}


def pii(spark: SparkSession, catalog: Catalog, table: str, fraction: float = pii_ops.FRACTION, per_group: int = pii_ops.ROWS_PER_GROUP, least: float = pii_ops.MIN_CONFIDENCE, max_files: int = pii_ops.MAX_FILES) -> tuple[int, list[dict]]:
    """(files sampled, findings). Values are looked at where they are read; only counts come back.

    Of each chosen row group, the first per_group non-null values of every string leaf are looked at.
    """
    tables = tables_of(spark, catalog, table)
    manifests = metadata.manifests(metadata.resolved(tables), skip_bad=True)
    chosen = pii_ops.first_files(metadata.files(manifests, skip_bad=True), max_files)
    places = [r[0] for r in chosen.orderBy("manifest_pos", "entry_pos").select(resolve(F.col("base"), F.col("file_path"))).collect()]
    if not places:
        return 0, []
    groups = parquet.groups(spark.createDataFrame([(x,) for x in places], "path string"))
    values = parquet.values(pii_ops.chosen_groups(groups, fraction), per_group).withColumn("table_id", F.lit(table))
    return len(places), [r.asDict() for r in pii_ops.findings(values, least).orderBy("column", "pii_type").collect()]


def migration(spark: SparkSession, catalog: Catalog, table: str = "", namespace: str = "") -> DataFrame:
    tables = tables_of(spark, catalog, table, namespace)
    manifests = metadata.manifests(metadata.resolved(tables), skip_bad=True)
    swept = metadata.file_columns(manifests.filter(F.col("manifest_pos") < migration_ops.MANIFESTS), migration_ops.SWEPT, skip_bad=True, keep=("table_id", "manifest_pos"))
    return migration_ops.reports(tables, metadata.snapshots(tables), manifests, swept)


def cost(spark: SparkSession, catalog: Catalog, table: str, rates: cost_ops.Rates | None = None, cold_days: int = cost_ops.COLD_DAYS, now_ms: int | None = None) -> DataFrame:
    snaps = metadata.snapshots(tables_of(spark, catalog, table))
    return cost_ops.timeline(snaps, now_ms or now(), rates, cold_days).orderBy("timestamp_ms", "snapshot_id")


BASELINE = ("score", "data_files", "data_bytes", "manifest_count", "position_deletes", "equality_deletes")


def baseline_path(folder: str, table: str, tag: str) -> str:
    return os.path.join(folder, re.sub(rb"[^A-Za-z0-9_.-]", b"_", f"{table}_{tag}".encode()).decode() + ".json")


def captured(spark: SparkSession, catalog: Catalog, table: str, now_ms: int | None = None) -> DataFrame:
    kept: list[DataFrame] = []
    try:
        stat = statistics(tables_of(spark, catalog, table), now_ms or now(), kept=kept)
        out = stat.join(scoring.composite(scoring.dimensions(stat)).select("table_id", "score"), "table_id").select("table_id", *BASELINE)
        return spark.createDataFrame(out.collect(), out.schema)  # one table's row
    finally:
        release(kept)


def bench_start(spark: SparkSession, catalog: Catalog, table: str, tag: str = "default", folder: str = ".lakescope/bench", now_ms: int | None = None) -> str:
    """Keep a table's figures under a tag."""
    row = captured(spark, catalog, table, now_ms).first()
    path = baseline_path(folder, row["table_id"], tag)
    os.makedirs(folder, exist_ok=True)
    with open(path, "w") as f:
        json.dump({"table_id": row["table_id"], "tag": tag, "captured_at_ms": now_ms or now(), **{k: row[k] for k in BASELINE}}, f, indent=2)
    return path


def bench_compare(spark: SparkSession, catalog: Catalog, table: str, tag: str = "default", folder: str = ".lakescope/bench", now_ms: int | None = None) -> dict:
    """A table's figures now against those kept under a tag."""
    after = captured(spark, catalog, table, now_ms)
    name = tables_of(spark, catalog, table).select("table_id").first()[0]
    with open(baseline_path(folder, name, tag)) as f:
        kept = json.load(f)
    before = spark.createDataFrame([(kept["table_id"], *(kept[k] for k in BASELINE))], "table_id string, score int, " + ", ".join(f"{k} long" for k in BASELINE[1:]))
    return diff_ops.compared(before, after).first().asDict()
