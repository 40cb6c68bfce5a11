"""A query per operator over the projections, and its twin in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import pii as detect
from ..operators import cost, diff, migration, orphans, pii, policy, scoring, stats, writepattern
from . import projections as p

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = p.NOW_MS
GRACE = 7 * 365 * 86_400_000 * 3


def query(sql: str, *frames: str):
    """Register a function under its name with SQL over the named projections."""
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = ("WITH " + ",\n".join(f"{x} AS ({p.SQL[x]})" for x in frames) + "\n" if frames else "") + sql
        return f

    return add


LIVE = "status <> 2"


@query(f"SELECT table_id, count(*) AS n, CAST(sum(file_size_bytes) AS BIGINT) AS bytes FROM files WHERE {LIVE} GROUP BY 1", "files")
def agg05_live_files(spark, d):
    return stats.live(p.files(spark, d)).groupBy("table_id").agg(F.count(F.lit(1)).alias("n"), F.sum("file_size_bytes").cast("long").alias("bytes"))


STATS_SQL = f"""SELECT table_id, count(*) FILTER (content = 0) AS data_files, CAST(coalesce(sum(file_size_bytes) FILTER (content = 0), 0) AS BIGINT) AS data_bytes,
count(*) FILTER (content = 0 AND file_size_bytes < 67108864) AS small_64, count(*) FILTER (content = 0 AND file_size_bytes < 134217728) AS small_128,
count(*) FILTER (content = 1) AS position_deletes, count(*) FILTER (content = 2) AS equality_deletes, CAST(coalesce(sum(file_size_bytes) FILTER (content IN (1, 2)), 0) AS BIGINT) AS delete_bytes
FROM files WHERE {LIVE} GROUP BY table_id"""


@query(STATS_SQL, "files")
def agg06_file_stats(spark, d):
    return stats.file_stats(p.files(spark, d))


@query(f"""SELECT table_id, CAST(sum(file_size_bytes) AS BIGINT) AS sample_bytes, count(*) AS sample_files FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY manifest_pos, entry_pos) AS r
FROM files WHERE {LIVE} AND content = 0) WHERE r <= 1024 GROUP BY 1""", "files")
def agg07_size_sample(spark, d):
    s = stats.size_sample(p.files(spark, d))
    return s.select("table_id", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("sample_bytes"), F.size("sizes").cast("long").alias("sample_files"))


@query("SELECT DISTINCT 'a=' || CAST(c_nationkey AS VARCHAR) || '/b=' || CASE WHEN c_custkey % 2 = 0 THEN '<nil>' ELSE 'x' END AS key FROM customer")
def agg08_partition_key(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    part = F.create_map(F.lit("b"), F.when(F.col("c_custkey") % 2 != 0, "x"), F.lit("a"), F.col("c_nationkey").cast("string"))
    return c.select(paths.partition_key(part).alias("key")).distinct()


@query(f"""SELECT table_id, month_key AS key, count(*) AS file_count, CAST(sum(file_size_bytes) AS BIGINT) AS bytes, CAST(sum(record_count) AS BIGINT) AS rows FROM files
WHERE {LIVE} AND content = 0 GROUP BY 1, 2""", "files")
def agg09_partition_stats(spark, d):
    return stats.partition_stats(p.files(spark, d))


@query(f"""SELECT table_id, part_key AS key, CAST(sum(file_size_bytes) AS BIGINT) AS bytes, CAST(row_number() OVER (PARTITION BY table_id ORDER BY sum(file_size_bytes) DESC, part_key) AS INTEGER) AS rank
FROM files WHERE {LIVE} AND content = 0 GROUP BY 1, 2""", "files")
def agg10_partitions_by_bytes(spark, d):
    return stats.by_bytes(stats.partition_stats(p.files(spark, d, "part"))).select("table_id", "key", "bytes", "rank")


AGES = f"""SELECT table_id, count(*) AS snapshot_count, max(greatest(0, {NOW} - timestamp_ms)) AS oldest_age_ms, min(greatest(0, {NOW} - timestamp_ms)) AS newest_age_ms FROM snapshots GROUP BY 1"""


@query(AGES, "snapshots")
def agg01_snapshot_ages(spark, d):
    return stats.snapshot_stats(p.snapshots(spark, d), NOW)


@query("SELECT table_id, count(*) AS manifest_count FROM manifests GROUP BY 1", "manifests")
def agg04_manifest_count(spark, d):
    return stats.manifest_stats(p.manifests(spark, d))


def _skew_sql(key: str) -> str:
    return f"""p AS (SELECT table_id, {key}_key AS key, CAST(sum(file_size_bytes) AS BIGINT) AS bytes FROM files WHERE {LIVE} AND content = 0 GROUP BY 1, 2),
m AS (SELECT table_id, count(*) AS partitions, CAST(floor(quantile_cont(bytes, 0.5)) AS BIGINT) AS median, avg(bytes) AS mean, stddev_pop(bytes) AS sd FROM p GROUP BY 1),
s AS (SELECT m.table_id, any_value(partitions) AS partitions, any_value(median) AS median, any_value(sd / mean) AS cv, count(*) FILTER (bytes > 2 * median) AS hot, count(*) FILTER (bytes < median * 0.1) AS sparse
FROM m JOIN p ON m.table_id = p.table_id GROUP BY 1)"""


for _key in ("month", "quantity", "part"):
    def _skewed(spark, d, key=_key):
        s = stats.skew(stats.partition_stats(p.files(spark, d, key)))
        return s.select("table_id", "partitions", "median", F.round("cv", 6).alias("cv"), "hot", "sparse")

    _skewed.__name__ = f"hlt10_skew_{_key}"
    query(f", {_skew_sql(_key)} SELECT table_id, partitions, median, round(cv, 6) AS cv, hot, sparse FROM s", "files")(_skewed)


@query(f"SELECT table_id, CAST(floor(quantile_cont(file_size_bytes, 0.5)) AS BIGINT) AS median FROM files WHERE {LIVE} GROUP BY 1", "files")
def hlt11_median(spark, d):
    return stats.live(p.files(spark, d)).groupBy("table_id").agg(stats.median(F.col("file_size_bytes")).alias("median"))


def _stats(spark, d, key="month"):
    """Statistics of the two tables of files; their snapshots are the events with even and with odd ids."""
    snaps = p.snapshots(spark, d, "event_type").withColumn("table_id", F.when(F.col("snapshot_id") % 2 == 0, "sales.f").otherwise("sales.o"))
    base = spark.createDataFrame([("sales.f", 1), ("sales.o", 2)], "table_id string, format_version int")
    return stats.table_stats(base, p.files(spark, d, key), p.manifests(spark, d), snaps, NOW)


DIM_SQL = f""", {_skew_sql('quantity')}, f AS ({STATS_SQL}), mc AS (SELECT table_id, count(*) AS manifest_count FROM manifests GROUP BY 1),
sn AS (SELECT CASE WHEN snapshot_id % 2 = 0 THEN 'sales.f' ELSE 'sales.o' END AS table_id, count(*) AS n, max({NOW} - timestamp_ms) AS age FROM snapshots GROUP BY 1),
j AS (SELECT f.*, mc.manifest_count, sn.n, sn.age, s.partitions, s.cv, CASE f.table_id WHEN 'sales.f' THEN 1 ELSE 2 END AS v FROM f JOIN mc USING (table_id) JOIN sn USING (table_id) JOIN s USING (table_id)),
dims AS (
SELECT table_id, 'file_size' AS name, CASE WHEN data_files = 0 THEN 20 WHEN small_128 / data_files >= 0.5 THEN 8 WHEN small_128 / data_files >= 0.25 THEN 12 ELSE 20 END AS score, 20 AS max_score,
  CASE WHEN data_files = 0 THEN 'OK' WHEN small_128 / data_files >= 0.5 THEN 'CRITICAL' WHEN small_128 / data_files >= 0.25 THEN 'WARNING' ELSE 'OK' END AS severity FROM j
UNION ALL SELECT table_id, 'delete_amplification', CASE WHEN v < 2 OR data_files = 0 THEN 20 WHEN (position_deletes + equality_deletes) / data_files >= 0.25 THEN 6 WHEN (position_deletes + equality_deletes) / data_files >= 0.1 THEN 12 ELSE 20 END, 20,
  CASE WHEN v < 2 OR data_files = 0 THEN 'OK' WHEN (position_deletes + equality_deletes) / data_files >= 0.25 THEN 'CRITICAL' WHEN (position_deletes + equality_deletes) / data_files >= 0.1 THEN 'WARNING' ELSE 'OK' END FROM j
UNION ALL SELECT table_id, 'manifest_density', CASE WHEN manifest_count >= 5000 THEN 5 WHEN manifest_count >= 2000 THEN 9 ELSE 15 END, 15, CASE WHEN manifest_count >= 5000 THEN 'CRITICAL' WHEN manifest_count >= 2000 THEN 'WARNING' ELSE 'OK' END FROM j
UNION ALL SELECT table_id, 'snapshot', CASE WHEN age >= 7776000000 OR n >= 500 THEN 5 WHEN age >= 2592000000 OR n >= 100 THEN 10 ELSE 15 END, 15, CASE WHEN age >= 7776000000 OR n >= 500 THEN 'CRITICAL' WHEN age >= 2592000000 OR n >= 100 THEN 'WARNING' ELSE 'OK' END FROM j
UNION ALL SELECT table_id, 'partition_skew', CASE WHEN partitions < 2 THEN 15 WHEN cv >= 1.0 THEN 5 WHEN cv >= 0.5 THEN 9 ELSE 15 END, 15, CASE WHEN partitions < 2 THEN 'OK' WHEN cv >= 1.0 THEN 'CRITICAL' WHEN cv >= 0.5 THEN 'WARNING' ELSE 'OK' END FROM j
UNION ALL SELECT table_id, 'format_version', CASE WHEN v = 1 THEN 3 ELSE 5 END, 5, CASE WHEN v = 1 THEN 'INFO' ELSE 'OK' END FROM j)"""

for _name, _ in zip(scoring.DIMENSIONS, range(6), strict=True):
    def _one(spark, d, name=_name):
        return scoring.dimensions(_stats(spark, d, "quantity")).filter(F.col("name") == name).select("table_id", "name", "score", "max_score", "severity")

    _one.__name__ = f"hlt_{_name}"
    query(f"{DIM_SQL} SELECT * FROM dims WHERE name = '{_name}'", "files", "manifests", "snapshots")(_one)


@query(f"{DIM_SQL} SELECT table_id, CAST(sum(score) AS INTEGER) AS score, CAST(sum(max_score) AS INTEGER) AS max_score, arg_max(severity, CASE severity WHEN 'OK' THEN 1 WHEN 'INFO' THEN 2 WHEN 'WARNING' THEN 3 ELSE 4 END) AS worst_severity FROM dims GROUP BY 1", "files", "manifests", "snapshots")
def hlt07_composite(spark, d):
    return scoring.composite(scoring.dimensions(_stats(spark, d, "quantity")))


@query("""SELECT o_orderkey AS id, CASE WHEN ms <= 0 THEN '0s' WHEN ms >= 86400000 THEN (ms // 86400000) || 'd' WHEN ms >= 3600000 THEN (ms // 3600000) || 'h' ELSE (ms // 60000) || 'm' END AS text
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 977 ELSE CAST(o_orderkey AS BIGINT) * 99991 END AS ms FROM orders)""")
def hlt13_duration_text(spark, d):
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), paths.duration_text(F.when(k % 3 == 0, k * 977).otherwise(k * 99_991)).alias("text"))


WP_SQL = """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {id} ORDER BY timestamp_ms DESC, pos DESC) AS r FROM snapshots) WHERE r <= 50),
g AS (SELECT {id} AS tid, added_files, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY {id} ORDER BY timestamp_ms, pos) AS delta FROM l),
w AS (SELECT tid AS table_id, count(*) AS commits, CAST(coalesce(floor(sum(delta) / count(delta)), 0) AS BIGINT) AS mean_ms, CAST(coalesce(floor(quantile_cont(delta, 0.5)), 0) AS BIGINT) AS median_ms,
CASE WHEN count(delta) < 2 OR avg(delta) = 0 THEN 0 ELSE stddev_pop(delta) / avg(delta) END AS cv, CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(avg(added_files) FILTER (added_files > 0), 0) END AS files FROM g GROUP BY 1)
SELECT table_id, commits, mean_ms, median_ms, round(cv, 6) AS cv, round(files, 6) AS files_per_commit,
CASE WHEN commits < 2 THEN 'unknown' WHEN cv > 1 THEN 'mixed' WHEN median_ms > 0 AND median_ms <= {s} THEN 'streaming' WHEN median_ms >= {b} THEN 'batch' ELSE 'mixed' END AS pattern FROM w"""


def _pattern(frame):
    return frame.select("table_id", "commits", "mean_ms", "median_ms", F.round("cv", 6).alias("cv"), F.round("files_per_commit", 6).alias("files_per_commit"), "pattern")


@query(WP_SQL.format(id="table_id", s=300_000, b=3_600_000), "snapshots")
def wp08_pattern_by_user(spark, d):
    return _pattern(writepattern.patterns(p.snapshots(spark, d)))


@query(WP_SQL.format(id="type_id", s=600_000, b=1_200_000), "snapshots")
def wp10_pattern_tunables(spark, d):
    return _pattern(writepattern.patterns(p.snapshots(spark, d, "event_type"), streaming_ms=600_000, batch_ms=1_200_000))


@query("""SELECT table_id, snapshot_id, delta_ms FROM (SELECT *, greatest(0, timestamp_ms - lag(timestamp_ms) OVER (PARTITION BY table_id ORDER BY timestamp_ms, pos)) + CASE WHEN lag(pos) OVER (PARTITION BY table_id ORDER BY timestamp_ms, pos) IS NULL THEN NULL ELSE 0 END AS delta_ms
FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY timestamp_ms DESC, pos DESC) AS r FROM snapshots) WHERE r <= 50) WHERE delta_ms IS NOT NULL""", "snapshots")
def wp03_commit_deltas(spark, d):
    return writepattern.deltas(p.snapshots(spark, d)).filter("delta_ms is not null").select("table_id", "snapshot_id", "delta_ms")


CST_SQL = f""", s AS (SELECT *, sum(added_bytes - removed_bytes) OVER w AS t FROM snapshots WINDOW w AS (PARTITION BY table_id ORDER BY timestamp_ms, pos)),
c AS (SELECT *, CAST(t - least(0, min(t) OVER (PARTITION BY table_id ORDER BY timestamp_ms, pos)) AS BIGINT) AS cumulative_bytes FROM s)"""


@query(f"{CST_SQL} SELECT table_id, snapshot_id, cumulative_bytes, round(cumulative_bytes / 1073741824, 12) AS cumulative_gb, round(cumulative_bytes / 1073741824 * 0.023, 12) AS monthly_usd FROM c", "snapshots")
def cst05_timeline(spark, d):
    t = cost.timeline(p.snapshots(spark, d), NOW)
    return t.select("table_id", "snapshot_id", "cumulative_bytes", F.round("cumulative_gb", 12).alias("cumulative_gb"), F.round("monthly_usd", 12).alias("monthly_usd"))


@query(f"SELECT table_id, count(*) FILTER (floor(({NOW} - timestamp_ms) / 86400000) >= 45) AS cold, count(*) AS n FROM snapshots GROUP BY 1", "snapshots")
def cst07_cold_snapshots(spark, d):
    t = cost.timeline(p.snapshots(spark, d), NOW, cold_days=45)
    return t.groupBy("table_id").agg(F.count_if("tier_candidate").alias("cold"), F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS id, round(CAST(c_custkey AS DOUBLE) * 1000000 / 1073741824 * 0.05, 12) AS usd FROM customer")
def cst08_reclaimable(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.col("c_custkey").alias("id"), F.round(cost.Rates("own", 0.05).reclaimable(F.col("c_custkey") * 1_000_000), 12).alias("usd"))


@query("SELECT event_id AS id, CASE WHEN regexp_full_match(x, '[0-9]+') THEN CAST(x AS BIGINT) ELSE 0 END AS n FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '+' || event_id WHEN 1 THEN ' ' || event_id WHEN 2 THEN '' ELSE CAST(event_id AS VARCHAR) END AS x FROM events)")
def cst03_summary_numbers(spark, d):
    k = F.col("event_id")
    s = k.cast("string")
    x = F.when(k % 4 == 0, F.concat(F.lit("+"), s)).when(k % 4 == 1, F.concat(F.lit(" "), s)).when(k % 4 == 2, "").otherwise(s)
    return spark.read.parquet(f"{d}/events.parquet").select(k.alias("id"), cost.summary_long(x).alias("n"))


NORM = "regexp_replace(regexp_replace(uri, '/$', ''), '^file://', '')"
ORPHAN_SQL = f""", o AS (SELECT *, {NORM} AS uri_norm FROM objects), c AS (SELECT * FROM o WHERE (updated_at_ms = 0 OR updated_at_ms <= {NOW - GRACE}) AND NOT regexp_matches(uri, '\\.metadata\\.json$') AND uri_norm NOT IN (SELECT uri_norm FROM refs))"""


def _orphans(spark, d):
    objects, live = p.objects(spark, d), orphans.active(p.references(spark, d))
    return objects, live, orphans.orphans(objects, live, NOW, GRACE)


@query(f"{ORPHAN_SQL} SELECT table_id, uri, size_bytes, updated_at_ms, {NOW} - updated_at_ms AS age_ms FROM c", "objects", "refs")
def orp04_orphans(spark, d):
    return _orphans(spark, d)[2]


@query(f"""{ORPHAN_SQL} SELECT 'wh.orders' AS table_id, (SELECT count(*) FROM objects) AS scanned_objects, (SELECT count(*) FROM refs) AS active_files, (SELECT count(*) FROM c) AS candidates, (SELECT CAST(sum(size_bytes) AS BIGINT) FROM c) AS total_bytes""", "objects", "refs")
def orp06_orphan_totals(spark, d):
    objects, live, found = _orphans(spark, d)
    return orphans.totals(objects, found, live)


@query(f"{ORPHAN_SQL} SELECT table_id, uri, size_bytes FROM c ORDER BY size_bytes DESC, uri LIMIT 25", "objects", "refs")
def orp06_orphan_preview(spark, d):
    return orphans.preview(_orphans(spark, d)[2], 25).select("table_id", "uri", "size_bytes")


@query(f"SELECT count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM objects WHERE updated_at_ms = 0 OR updated_at_ms <= {NOW - GRACE}", "objects")
def orp03_past_grace(spark, d):
    return orphans.past_grace(p.objects(spark, d), NOW, GRACE).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").cast("long").alias("bytes"))


@query(f"SELECT count(*) AS n FROM objects WHERE {NORM} IN (SELECT uri_norm FROM refs)", "objects", "refs")
def orp_referenced_semi(spark, d):
    return orphans.referenced(p.objects(spark, d), orphans.active(p.references(spark, d))).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT uri, {NORM} AS norm FROM objects", "objects")
def orp02_normalize(spark, d):
    return p.objects(spark, d).select("uri", paths.normalized(F.col("uri")).alias("norm"))


@query("SELECT uri, NOT regexp_matches(uri, '\\.metadata\\.json$') AS data FROM objects", "objects")
def orp05_metadata_guard(spark, d):
    return p.objects(spark, d).select("uri", (~paths.protected(F.col("uri"))).alias("data"))


@query("SELECT location, CASE WHEN position('://' IN location) > 1 THEN lower(split_part(location, '://', 1)) ELSE '' END AS scheme FROM tables", "tables")
def sto03_scheme(spark, d):
    return p.tables(spark, d).select("location", paths.scheme_of(F.col("location")).alias("scheme"))


@query("SELECT location, CASE WHEN position('://' IN location) > 1 THEN lower(split_part(location, '://', 1)) ELSE 'file' END AS scheme, CASE WHEN position('://' IN location) > 1 THEN split_part(split_part(location, '://', 2), '/', 1) ELSE '' END AS host, CASE WHEN position('://' IN location) > 1 THEN substr(split_part(location, '://', 2), position('/' IN split_part(location, '://', 2))) ELSE location END AS path FROM tables", "tables")
def sto04_split_uri(spark, d):
    return p.tables(spark, d).select("location", paths.split_uri(F.col("location")).alias("u")).select("location", "u.*")


@query("""SELECT table_id, CASE WHEN ref = '' THEN '' WHEN position('://' IN ref) > 0 OR ref[1] = '/' THEN ref ELSE regexp_replace(base, '/[^/]*$', '') || '/' || ref END AS path FROM (SELECT table_id, location || '/metadata/v3.metadata.json' AS base,
CASE WHEN metadata_location = '' THEN '' WHEN format_version = 1 THEN metadata_location ELSE 'snap-' || format_version || '.avro' END AS ref FROM tables)""", "tables")
def md10_resolve(spark, d):
    t = p.tables(spark, d)
    base = F.concat("location", F.lit("/metadata/v3.metadata.json"))
    ref = F.when(F.col("metadata_location") == "", "").when(F.col("format_version") == 1, F.col("metadata_location")).otherwise(F.concat(F.lit("snap-"), F.col("format_version").cast("string"), F.lit(".avro")))
    return t.select("table_id", paths.resolve(base, ref).alias("path"))


@query("SELECT table_id AS id, split_part(table_id, '.', 1) AS namespace, split_part(table_id, '.', 2) AS name FROM tables", "tables")
def cat01_table_id(spark, d):
    return p.tables(spark, d).select(F.col("table_id").alias("id"), paths.table_id_parts(F.concat(F.lit(" "), "table_id")).alias("t")).select("id", "t.*")


@query("SELECT CASE WHEN namespace = 'building' THEN '' ELSE namespace || '.' END || location AS id FROM tables", "tables")
def cat02_render_id(spark, d):
    return p.tables(spark, d).select(paths.table_id(F.when(F.col("namespace") == "building", "").otherwise(F.col("namespace")), F.col("location")).alias("id"))


@query("SELECT table_id, location || '/data' AS prefix FROM tables", "tables")
def orp10_default_prefix(spark, d):
    return p.tables(spark, d).select("table_id", paths.default_prefix(F.concat("location", F.lit("//"))).alias("prefix"))


@query("SELECT location, regexp_replace(location, '[^A-Za-z0-9_.-]', '_', 'g') AS name FROM tables", "tables")
def ben06_sanitize(spark, d):
    return p.tables(spark, d).select("location", paths.sanitized(F.col("location")).alias("name"))


@query("""SELECT id, CASE WHEN b >= 1099511627776 THEN round_even(b / 1099511627776, 2) WHEN b >= 1073741824 THEN round_even(b / 1073741824, 2) WHEN b >= 1048576 THEN round_even(b / 1048576, 2) WHEN b >= 1024 THEN round_even(b / 1024, 2) ELSE CAST(b AS DOUBLE) END AS amount,
CASE WHEN b >= 1099511627776 THEN 'TB' WHEN b >= 1073741824 THEN 'GB' WHEN b >= 1048576 THEN 'MB' WHEN b >= 1024 THEN 'KB' ELSE 'B' END AS unit FROM (SELECT o_orderkey AS id, CAST(o_orderkey AS BIGINT) * o_orderkey * (o_orderkey % 7) * 1009 AS b FROM orders)""")
def out11_human_bytes(spark, d):
    k = F.col("o_orderkey")
    text = F.split(paths.human_bytes(k * k * (k % 7) * 1009), " ")
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), text[0].cast("double").alias("amount"), text[1].alias("unit"))


_POLICIES = [(0, "auto", "automobile"), (1, "house", "house.*"), (2, "m", "mach*"), (3, "rest", "*"), (4, "late", "")]
_POLICY_SQL = "(VALUES " + ", ".join(f"({a}, '{b}', '{c}')" for a, b, c in _POLICIES) + ") AS pol(ord, name, pat)"


@query(f"SELECT table_id, arg_min(name, ord) AS policy FROM tables, {_POLICY_SQL} WHERE pat IN ('', '*') OR pat = namespace OR (suffix(pat, '.*') AND (namespace = regexp_replace(pat, '\\.\\*$', '') OR starts_with(namespace, regexp_replace(pat, '\\*$', '')))) GROUP BY 1", "tables")
def pol03_first_match(spark, d):
    return policy.first_match(p.tables(spark, d), [(name, glob) for _, name, glob in _POLICIES])


@query("""SELECT table_id, CAST(CASE WHEN namespace = 'machinery' THEN 64 ELSE 128 END * 1048576 AS BIGINT) AS min_file_bytes, CASE WHEN namespace = 'machinery' THEN 10 ELSE 2000 END AS manifests_warn, CASE WHEN namespace = 'machinery' THEN 20 ELSE 5000 END AS manifests_crit,
CAST(CASE WHEN namespace = 'furniture' THEN 7 ELSE 30 END * 86400000::BIGINT AS BIGINT) AS age_warn_ms, CAST(CASE WHEN namespace = 'furniture' THEN 21 ELSE 90 END * 86400000::BIGINT AS BIGINT) AS age_crit_ms, CASE WHEN namespace = 'furniture' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS delete_ratio_warn FROM tables""", "tables")
def pol04_thresholds(spark, d):
    doc = policy.parse("version: '1'\npolicies:\n- {name: a, target_namespace: machinery, min_file_size_mb: 64, max_manifest_files: 10}\n- {name: b, target_namespace: 'furniture.*', max_snapshot_age: 7d, delete_file_ratio_warn: 0.2}\n")
    t = policy.apply(p.tables(spark, d).select("table_id", "namespace"), doc)
    return t.select("table_id", F.col("min_file_bytes").cast("long").alias("min_file_bytes"), "manifests_warn", "manifests_crit", F.col("age_warn_ms").cast("long").alias("age_warn_ms"), F.col("age_crit_ms").cast("long").alias("age_crit_ms"), "delete_ratio_warn")


_RE2 = {
    "EMAIL": r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b", "SSN_US": r"\b\d{3}-\d{2}-\d{4}\b", "CREDIT_CARD": r"\b(?:\d[ -]?){13,19}\b", "PHONE_E164": r"\+[1-9]\d{7,14}",
    "AU_TFN": r"\b\d{3}[ -]?\d{3}[ -]?\d{3}\b", "IN_AADHAAR": r"\b\d{4}\s?\d{4}\s?\d{4}\b",
}
for _kind, _re in _RE2.items():
    def _hits(spark, d, kind=_kind):
        return p.cells(spark, d).groupBy("table_id", "column").agg(F.count_if(detect.matches(F.col("value"), kind)).alias("hits"), F.count(F.lit(1)).alias("n"))

    _hits.__name__ = f"pii_{_kind.lower()}"
    query(f"""SELECT table_id, "column", count(*) FILTER (regexp_matches(value, '{_re}')) AS hits, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY 1, 2""", "cells")(_hits)

_LUHN = "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(d)[i] AS INTEGER) ELSE (CAST(reverse(d)[i] AS INTEGER) * 2) // 10 + (CAST(reverse(d)[i] AS INTEGER) * 2) % 10 END))"


@query(f"""SELECT d AS card, {_LUHN} % 10 = 0 AND {_LUHN} > 0 AS valid FROM (SELECT replace(value, ' ', '') AS d FROM cells WHERE "column" = 'card')""", "cells")
def pii15_luhn(spark, d):
    c = p.cells(spark, d).filter(F.col("column") == "card")
    return c.select(F.col("value").alias("card"), detect.luhn(F.col("value")).alias("valid"))

@query("""SELECT table_id, "column", md5(value) AS digest, round((SELECT -sum(n / len(value) * log2(n / len(value))) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(value, '')) AS c) WHERE c <> '' GROUP BY c)), 6) AS bits FROM cells WHERE table_id = 't.customer'""", "cells")
def pii17_entropy(spark, d):
    c = p.cells(spark, d).filter(F.col("table_id") == "t.customer")
    return c.select("table_id", "column", F.md5(F.col("value").cast("binary")).alias("digest"), F.round(detect.entropy(F.col("value")), 6).alias("bits"))


_PII_SQL = f""", f AS (SELECT table_id, "column", value, octet_length(encode(value)) BETWEEN 1 AND 4096 AS g, {", ".join(f"regexp_matches(value, '{r}') AS {k.lower()}" for k, r in _RE2.items())}, regexp_extract(regexp_replace(regexp_extract(value, '{_RE2["CREDIT_CARD"]}'), '[ -]', '', 'g'), '.*') AS d FROM cells WHERE value IS NOT NULL),
t AS (SELECT table_id, "column", value, g, list_filter([CASE WHEN email THEN 'EMAIL' END, CASE WHEN ssn_us THEN 'SSN_US' END, CASE WHEN credit_card AND coalesce({_LUHN}, 1) % 10 = 0 AND coalesce({_LUHN}, 0) > 0 THEN 'CREDIT_CARD' END, CASE WHEN phone_e164 THEN 'PHONE_E164' END,
CASE WHEN au_tfn AND NOT credit_card THEN 'AU_TFN' END, CASE WHEN in_aadhaar AND NOT credit_card THEN 'IN_AADHAAR' END], lambda x: x IS NOT NULL) AS types FROM f),
u AS (SELECT table_id, "column", CASE WHEN NOT g THEN [] WHEN len(types) > 0 THEN types WHEN regexp_full_match(value, '[A-Za-z0-9_+/=-]{{24,}}') AND (SELECT -sum(n / len(value) * log2(n / len(value))) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split(value, '')) AS c) WHERE c <> '' GROUP BY c)) >= 4 THEN ['API_KEY_ENTROPY'] ELSE [] END AS types FROM t),
n AS (SELECT table_id, "column", count(*) AS sample_count FROM u GROUP BY 1, 2), m AS (SELECT table_id, "column", pii_type, count(*) AS match_count FROM (SELECT table_id, "column", unnest(types) AS pii_type FROM u) GROUP BY 1, 2, 3)
SELECT m.table_id, m."column", pii_type, match_count, sample_count, round(match_count / sample_count, 9) AS confidence, 'PII_' || pii_type AS recommend_tag FROM m JOIN n ON m.table_id = n.table_id AND m."column" = n."column" WHERE match_count / sample_count >= 0.01"""


@query(_PII_SQL, "cells")
def pii18_findings(spark, d):
    return pii.findings(p.cells(spark, d), 0.01).withColumn("confidence", F.round("confidence", 9))


@query("""SELECT * FROM (SELECT c_custkey AS id, unnest(['c_name', 'c_mktsegment']) AS "column", unnest([c_name, c_mktsegment]) AS value FROM customer)""")
def pii06_unpivot(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return pii.cells(c.withColumnRenamed("c_custkey", "id"), [x for x in pii.string_columns(c.schema)], "id")


@query(f"SELECT table_id, manifest_pos, entry_pos FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY manifest_pos, entry_pos) AS r FROM files WHERE {LIVE} AND content = 0) WHERE r <= 16", "files")
def pii01_first_files(spark, d):
    return pii.first_files(p.files(spark, d)).select("table_id", "manifest_pos", "entry_pos")


MIG_SQL = """, u AS (SELECT table_id, location AS uri FROM tables UNION ALL SELECT table_id, metadata_location FROM tables),
x AS (SELECT table_id, 'HDFS_PATH' AS code, 'HIGH' AS severity FROM u WHERE uri LIKE 'hdfs%://%' UNION ALL SELECT table_id, 'HDFS_BARE_PATH', 'MEDIUM' FROM u WHERE uri LIKE '/user/hive%'
UNION ALL SELECT table_id, 'HDFS_PROPERTY', 'MEDIUM' FROM tables WHERE len(properties) > 0 UNION ALL SELECT table_id, 'V1_UPGRADE_RECOMMENDED', 'MEDIUM' FROM tables WHERE format_version = 1)"""


def _findings(spark, d):
    t = p.tables(spark, d)
    none = spark.createDataFrame([], "table_id string, manifest_list string")
    found = migration.uri_findings(migration.uris(t, none)).unionByName(migration.property_findings(t)).unionByName(migration.version_findings(t))
    return t, found


@query(f"{MIG_SQL} SELECT * FROM x", "tables")
def mig_findings(spark, d):
    return _findings(spark, d)[1].select("table_id", "code", "severity")


@query(f"{MIG_SQL} SELECT table_id, high, medium, CASE WHEN high > 0 OR medium >= 2 THEN 'HIGH' WHEN medium = 1 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (SELECT tables.table_id, count(x.code) FILTER (severity = 'HIGH') AS high, count(x.code) FILTER (severity = 'MEDIUM') AS medium FROM tables LEFT JOIN x ON tables.table_id = x.table_id GROUP BY 1)", "tables")
def mig08_risk(spark, d):
    t, found = _findings(spark, d)
    return migration.risk(found, t)


@query(f"SELECT table_id, count(*) AS data_file_count, CAST(sum(file_size_bytes) AS BIGINT) AS total_data_bytes, bool_or(file_path LIKE 'hdfs%') AS on_hdfs FROM files WHERE manifest_pos < 256 AND {LIVE} GROUP BY 1", "files")
def mig06_file_sweep(spark, d):
    return migration.file_sweep(p.files(spark, d))


@query(f"""{DIM_SQL}, cs AS (SELECT table_id, CAST(sum(score) AS INTEGER) AS score FROM dims GROUP BY 1), ms AS (SELECT table_id, unnest(['score', 'data_files', 'manifest_count', 'position_deletes', 'equality_deletes']) AS metric,
unnest([score::BIGINT, data_files, manifest_count, position_deletes, equality_deletes]) AS before FROM j JOIN cs USING (table_id)) SELECT table_id, metric, before, before + CASE metric WHEN 'data_files' THEN -5 WHEN 'score' THEN 2 ELSE 0 END AS after, CAST(CASE metric WHEN 'data_files' THEN -5 WHEN 'score' THEN 2 ELSE 0 END AS BIGINT) AS delta FROM ms""", "files", "manifests", "snapshots")
def ben03_diff(spark, d):
    s = _stats(spark, d, "quantity")
    before = s.join(scoring.composite(scoring.dimensions(s)), "table_id")
    after = before.withColumns({"data_files": F.col("data_files") - 5, "score": F.col("score") + 2})
    return diff.long_form(diff.compared(before, after))


@query(f"""SELECT table_id, data_bytes // data_files AS avg_file_bytes FROM ({STATS_SQL})""", "files")
def ben04_average_size(spark, d):
    return diff.average_bytes(stats.file_stats(p.files(spark, d))).select("table_id", "avg_file_bytes")


@query("SELECT o_orderkey AS id, CASE WHEN x = 0 THEN '(no change)' WHEN x > 0 THEN '(+' || x || ')' ELSE '(' || x || ')' END AS text FROM (SELECT o_orderkey, o_orderkey % 7 - 3 AS x FROM orders)")
def ben05_delta_text(spark, d):
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), paths.delta_text(F.lit(3), k % 7).alias("text"))


SEVERITY_SQL = "CASE severity WHEN 'CRITICAL' THEN 3 WHEN 'WARNING' THEN 2 WHEN 'INFO' THEN 1 ELSE 0 END"


@query(f"{DIM_SQL} SELECT 'iceberg_table_dimension_severity{{catalog=\"c\",format_version=\"' || v || '\",table=\"' || dims.table_id || '\",dimension=\"' || name || '\"}} ' || {SEVERITY_SQL} AS line FROM dims JOIN j ON dims.table_id = j.table_id", "files", "manifests", "snapshots")
def out05_prometheus(spark, d):
    from . import metrics

    s = _stats(spark, d, "quantity")
    reports = scoring.reports(scoring.dimensions(s)).join(s.select("table_id", "format_version"), "table_id")
    reports = reports.withColumns({"catalog": F.lit("c"), "branch": F.lit(""), "write_pattern": F.lit(""), "scan_ms": F.lit(0), "wastage_bytes": F.lit(0)})
    return metrics.samples(reports).filter("family = 'iceberg_table_dimension_severity'").select("line")


@query(f"{DIM_SQL} SELECT table_id, count(*) FILTER (severity = 'CRITICAL') AS critical FROM dims GROUP BY 1", "files", "manifests", "snapshots")
def dsh02_critical_dimensions(spark, d):
    return scoring.dimensions(_stats(spark, d, "quantity")).groupBy("table_id").agg(F.count_if(F.col("severity") == "CRITICAL").alias("critical"))


@query(f"{DIM_SQL} SELECT table_id, CASE WHEN bool_or(severity = 'CRITICAL') THEN 2 WHEN bool_or(severity = 'WARNING') THEN 1 ELSE 0 END AS code FROM dims GROUP BY 1", "files", "manifests", "snapshots")
def cli10_exit_codes(spark, d):
    from .exits import exit_code

    return scoring.composite(scoring.dimensions(_stats(spark, d, "quantity"))).select("table_id", exit_code(F.col("worst_severity"), "warn").alias("code"))


@query("SELECT CAST(c_custkey % 3 AS INTEGER) AS i, count(*) AS n FROM customer GROUP BY 1")
def md08_coalesced_counts(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    a, b = F.when(F.col("c_custkey") % 3 == 1, 1), F.when(F.col("c_custkey") % 3 == 2, 2)
    return c.select(F.coalesce(a, b, F.lit(0)).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT table_id, snapshot_id, timestamp_ms FROM (SELECT *, max(pos) OVER (PARTITION BY table_id) AS cur FROM snapshots) WHERE pos = cur""", "snapshots")
def md02_current_snapshot(spark, d):
    s = p.snapshots(spark, d)
    current = s.groupBy("table_id").agg(F.max("snapshot_id").alias("snapshot_id"))
    return current.join(s, ["table_id", "snapshot_id"], "left").select("table_id", "snapshot_id", "timestamp_ms")


@query("""SELECT table_id, CASE WHEN hash_id % 2 = 0 THEN mn ELSE 0 END AS snapshot_id FROM (SELECT table_id, min(snapshot_id) AS mn, count(*) AS hash_id FROM snapshots GROUP BY 1)""", "snapshots")
def md03_branch(spark, d):
    from ..sources.metadata import wanted_snapshot

    t = p.snapshots(spark, d).groupBy("table_id").agg(F.min("snapshot_id").alias("first"), F.count(F.lit(1)).alias("n"))
    ref = F.struct(F.col("first").alias("snapshot-id"), F.lit("branch").alias("type"))
    t = t.withColumn("refs", F.when(F.col("n") % 2 == 0, F.create_map(F.lit("audit"), ref)).otherwise(F.create_map(F.lit("other"), ref)))
    return t.select("table_id", wanted_snapshot("audit").alias("snapshot_id"))
