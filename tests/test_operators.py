import random

import pytest
from pyspark.sql import functions as F

from lakescope.operators import cost, diff, migration, orphans, pii, policy, scoring, stats, writepattern

DAY = 86_400_000
MIB = 1 << 20
FILES = "table_id string, status int, content int, file_size_bytes long, record_count long, partition_key string, manifest_pos int, entry_pos long"


def entries(spark, *groups):
    """groups: (count, content, size, partition, status)."""
    rows, k = [], 0
    for n, content, size, partition, status in groups:
        for _ in range(n):
            rows.append(("t", status, content, size, 10, partition, 0, k))
            k += 1
    return spark.createDataFrame(rows, FILES)


def dims(spark, files, version=2, manifests=1, snapshots=(0,), now=0, **thresholds):
    tables = spark.createDataFrame([("t", version)], "table_id string, format_version int")
    m = spark.range(manifests).select(F.lit("t").alias("table_id"), F.col("id").alias("manifest_path"))
    s = spark.createDataFrame([("t", x) for x in snapshots], "table_id string, timestamp_ms long")
    stat = scoring.with_thresholds(stats.table_stats(tables, files, m, s, now), **thresholds)
    return {r["name"]: r for r in scoring.dimensions(stat).collect()}, stat


def test_deletes_critical_and_total(spark):
    d, stat = dims(spark, entries(spark, (4, 0, 256 * MIB, "", 1), (6, 1, MIB, "", 1)))
    assert (d["delete_amplification"]["severity"], d["delete_amplification"]["score"]) == ("CRITICAL", 6)
    assert d["delete_amplification"]["summary"] == "6 delete files (6 position, 0 equality); ratio 150.0%"
    total = scoring.composite(scoring.dimensions(stat)).first()
    assert total[1:] == (76, 90, "CRITICAL")


EDGES = {
    **{f"small{n}": (dict(data_files=100, small_128=n), "file_size", sev, score) for n, sev, score in [(0, "OK", 20), (24, "OK", 20), (25, "WARNING", 12), (49, "WARNING", 12), (50, "CRITICAL", 8)]},
    **{f"manifests{n}": (dict(manifest_count=n), "manifest_density", sev, score) for n, sev, score in [(1999, "OK", 15), (2000, "WARNING", 9), (4999, "WARNING", 9), (5000, "CRITICAL", 5)]},
    **{f"age{k}": (dict(oldest_age_ms=age, snapshot_count=n), "snapshot", sev, score) for k, (age, n, sev, score) in enumerate([(30 * DAY - 1, 99, "OK", 15), (30 * DAY, 1, "WARNING", 10), (0, 100, "WARNING", 10), (90 * DAY, 1, "CRITICAL", 5), (0, 500, "CRITICAL", 5)])},
    **{f"deletes{n}": (dict(data_files=100, equality_deletes=n), "delete_amplification", sev, score) for n, sev, score in [(9, "OK", 20), (10, "WARNING", 12), (25, "CRITICAL", 6)]},
    **{f"cv{k}": (dict(partitions=n, cv=cv), "partition_skew", sev, score) for k, (n, cv, sev, score) in enumerate([(1, 9.0, "OK", 15), (2, 0.4999, "OK", 15), (2, 0.5, "WARNING", 9), (2, 1.0, "CRITICAL", 5)])},
    "v1": (dict(format_version=1, data_files=1, position_deletes=9), "delete_amplification", "OK", 20),
    "info": (dict(format_version=1), "format_version", "INFO", 3),
    "v9": (dict(format_version=9, position_deletes=3), "format_version", "INFO", 3),
}


def test_edges(spark):
    """Every threshold, at it and just short of it."""
    columns = ["data_files", "small_128", "position_deletes", "equality_deletes", "manifest_count", "snapshot_count", "oldest_age_ms", "partitions", "hot", "sparse"]
    rows = [(k, c.get("format_version", 2), c.get("cv", 0.0), *(c.get(x, 0) for x in columns)) for k, (c, *_) in EDGES.items()]
    stat = spark.createDataFrame(rows, "table_id string, format_version int, cv double, " + ", ".join(f"{c} long" for c in columns))
    got = {(r["table_id"], r["name"]): r for r in scoring.dimensions(stat).collect()}
    for k, (_, name, severity, score) in EDGES.items():
        assert (got[k, name]["severity"], got[k, name]["score"]) == (severity, score), k
    text = {k: got[k, n]["summary"] for k, n in (("small25", "file_size"), ("age1", "snapshot"), ("v9", "format_version"), ("v9", "file_size"), ("v1", "delete_amplification"), ("cv2", "partition_skew"))}
    assert text["small25"] == "25% of files below 128MB" and text["age1"] == "1 snapshots; oldest 30d" and text["v1"] == "delete files not applicable for v1 tables"
    assert text["cv2"] == "CV=0.50 across 2 partitions (0 hot, 0 sparse)" and got["v9", "format_version"]["summary"] == "unknown format-version 9"
    assert got["v9", "delete_amplification"]["summary"] == "delete files present but no data files (table may be empty)"


def test_small_file_edges(spark):
    files = entries(spark, (3, 0, 128 * MIB - 1, "", 1), (2, 0, 128 * MIB, "", 1), (4, 0, 64 * MIB - 1, "", 1), (1, 0, 64 * MIB, "", 1), (9, 0, 1, "", 2))
    assert stats.file_stats(files).first()[:] == ("t", 10, 5 * 128 * MIB - 3 + 5 * 64 * MIB - 4, 4, 8, 0, 0, 0)


def test_skew_and_root(spark):
    sizes = [250 * MIB + k * 1000 for k in range(6)] + [5000 * MIB]
    files = entries(spark, *((1, 0, s, f"p={k}", 1) for k, s in enumerate(sizes)))
    s = stats.skew(stats.partition_stats(files)).first()
    mean = sum(sizes) / 7
    sd = (sum((x - mean) ** 2 for x in sizes) / 7) ** 0.5
    assert s["cv"] == pytest.approx(sd / mean) and (s["hot"], s["sparse"], s["median"]) == (1, 0, sorted(sizes)[3])
    z = v = sd * sd
    z /= 2
    for _ in range(12):
        z = (z + v / z) / 2
    assert stats.skew(stats.partition_stats(files), "newton12").first()["cv"] == pytest.approx(z / mean)
def test_size_sample(spark):
    files = entries(spark, (1500, 0, 7, "", 1), (3, 1, 9, "", 1))
    assert stats.size_sample(files).first()["sizes"] == [7] * 1024


def commits(spark, times, files=1):
    return spark.createDataFrame([("t", k, x, files) for k, x in enumerate(times)], "table_id string, pos int, timestamp_ms long, added_files long")


PATTERNS = [
    ([k * 60_000 for k in range(30)], "streaming"), ([k * 7_200_000 for k in range(20)], "batch"), ([k // 2 * 10_000_000 + k % 2 * 1000 for k in range(40)], "mixed"), ([5], "unknown"), ([5, 5, 5], "mixed"),
]


def test_patterns(spark):
    rows = [(str(t), k, x, 1) for t, (times, _) in enumerate(PATTERNS) for k, x in enumerate(times)]
    frame = spark.createDataFrame(rows, "table_id string, pos int, timestamp_ms long, added_files long")
    got = {r["table_id"]: r["pattern"] for r in writepattern.patterns(frame).collect()}
    assert got == {str(t): p for t, (_, p) in enumerate(PATTERNS)}


def test_pattern_window_and_summary(spark):
    old = [k * DAY for k in range(30)]
    late = [old[-1] + (k + 1) * 60_000 for k in range(50)]
    r = writepattern.patterns(commits(spark, old + late, 4)).first()
    assert (r["commits"], r["median_ms"], r["pattern"], r["files_per_commit"]) == (50, 60_000, "streaming", 4.0)
    s = spark.createDataFrame([({"added-files-count": "x", "added-files": "+7"},), ({"added-data-files": "3", "added-files": "9"},), ({"added-files": " 4"},)], "s map<string,string>")
    assert [r[0] for r in s.select(writepattern.summary_files(F.col("s"))).collect()] == [7, 3, 0]


def test_cost(spark):
    gb, now = 1 << 30, 400 * DAY
    rows = [("t", 0, 1, now - 200 * DAY, gb, 0), ("t", 1, 2, now - 100 * DAY, 2 * gb, 0), ("t", 2, 3, now - DAY, gb // 2, 0)]
    s = spark.createDataFrame(rows, "table_id string, pos int, snapshot_id long, timestamp_ms long, added_bytes long, removed_bytes long")
    t = cost.timeline(s, now, cold_days=30).orderBy("timestamp_ms").collect()
    assert t[-1]["cumulative_gb"] == 3.5 and [r["tier_candidate"] for r in t] == [True, True, False]
    assert t[-1]["monthly_usd"] == pytest.approx(3.5 * 0.023)
    assert spark.range(1).select(cost.Rates().reclaimable(F.lit(100 * gb))).first()[0] == pytest.approx(2.30)
    assert cost.Rates("x", 0.5).rate("glacier-deep") == 0.5 and cost.Rates().rate("glacier-deep") == 0.00099


def test_clamped_sum(spark):
    rng = random.Random(3)
    rows = [("t", k, k, k, rng.randrange(50), rng.randrange(60)) for k in range(400)]
    s = spark.createDataFrame(rows, "table_id string, pos int, snapshot_id long, timestamp_ms long, added_bytes long, removed_bytes long")
    got = [r["cumulative_bytes"] for r in cost.timeline(s, 0).orderBy("timestamp_ms").collect()]
    want, c = [], 0
    for r in rows:
        c = max(0, c + r[4] - r[5])
        want.append(c)
    assert got == want


def test_orphans(spark):
    now, hour = 10**12, 3_600_000
    rows = [("t", "file:///w/data/a", 1, now - 48 * hour), ("t", "/w/data/b/", 2, now - 48 * hour), ("t", "/w/data/x", 4, now - 48 * hour), ("t", "/w/data/new", 8, now - hour), ("t", "/w/data/edge", 16, now - 24 * hour), ("t", "/w/data/unknown", 32, 0), ("t", "/w/m/v1.metadata.json", 64, 1)]
    objects = spark.createDataFrame(rows, "table_id string, uri string, size_bytes long, updated_at_ms long")
    live = orphans.active(spark.createDataFrame([("t", "/w/data/a"), ("t", "file:///w/data/b"), ("t", "/w/data/a"), ("t", "")], "table_id string, uri string"))
    found = orphans.orphans(objects, live, now)
    assert sorted(r["uri"] for r in found.collect()) == ["/w/data/edge", "/w/data/unknown", "/w/data/x"]
    assert orphans.totals(objects, found, live).first()[:] == ("t", 7, 2, 3, 52)
    assert [r["uri"] for r in orphans.preview(found, 1).collect()] == ["/w/data/unknown"]
    assert orphans.referenced(objects, live).count() == 2
    assert orphans.orphans(objects, live, now, 0).count() == 4


def test_pii_findings(spark):
    cells = spark.createDataFrame([("t", "mail", "a@b.org"), ("t", "mail", "c@d.org"), ("t", "mail", "e@f.org"), ("t", "mail", "none"), ("t", "n", "1")], "table_id string, column string, value string")
    assert [r[:] for r in pii.findings(cells).collect()] == [("t", "mail", "EMAIL", 3, 4, 0.75, "PII_EMAIL")]
    assert pii.findings(cells, 0.8).count() == 0


def test_pii_columns_and_sampling(spark, tmp_path):
    from pyspark.sql import types as T

    nested = T.StructType([T.StructField("a", T.StructType([T.StructField("b", T.StringType()), T.StructField("n", T.LongType())])), T.StructField("raw", T.BinaryType())])
    assert pii.string_columns(nested) == ["a.b", "raw"]
    spark.range(5000).selectExpr("cast(id as string) as x").coalesce(1).write.parquet(str(tmp_path / "f"))
    rows = spark.read.parquet(str(tmp_path / "f"))
    assert pii.sampled(rows, 0.0, 100, group_rows=1000).count() == 100
    assert pii.sampled(rows, 1.0, 100, group_rows=1000).count() == 500
    assert pii.cells(rows, ["x"]).count() == 5000


def test_migration(spark):
    kind = "table_id string, location string, metadata_location string, format_version int, properties map<string,string>"
    rows = [("a", "hdfs://n/w", "hdfs://n/w/m.json", 2, {"write.metadata.path": "x"}), ("b", "s3://b/w", "s3://b/m", 1, None), ("c", "s3://b/w", "s3://b/m", 2, {"owner": "x"}), ("d", "/user/hive/w", "", 1, {})]
    tables = spark.createDataFrame(rows, kind)
    snaps = spark.createDataFrame([("a", "hdfs://n/w/snap.avro"), ("c", "")], "table_id string, manifest_list string")
    files = spark.createDataFrame([("c", 0, 1, 5, "s3://b/f"), ("c", 300, 1, 7, "hdfs://x/f"), ("c", 1, 2, 9, "hdfs://x/f")], "table_id string, manifest_pos int, status int, file_size_bytes long, file_path string")
    manifests = spark.createDataFrame([("c", "m")], "table_id string, manifest_path string")
    r = {x["table_id"]: x for x in migration.reports(tables, snaps, manifests, files).collect()}
    assert {k: v["risk"] for k, v in r.items()} == {"a": "HIGH", "b": "MEDIUM", "c": "LOW", "d": "HIGH"}
    assert sorted(f["code"] for f in r["a"]["findings"]) == ["HDFS_PATH", "HDFS_PATH", "HDFS_PATH", "HDFS_PROPERTY"]
    assert (r["c"]["data_file_count"], r["c"]["total_data_bytes"], r["c"]["manifest_count"]) == (1, 5, 1)


POLICY = """
version: "1"
default_catalog: c
extra: ignored
policies:
- {name: one, target_namespace: sales.*, min_file_size_mb: 64, max_manifest_files: 10, max_snapshot_age: 7d, delete_file_ratio_warn: 0.2, delete_file_ratio_fail: 0.4, colour: red}
- {name: two, target_namespace: "*"}
"""


def test_policies(spark):
    doc = policy.parse(POLICY)
    t = spark.createDataFrame([("a", "sales"), ("b", "sales.eu"), ("c", "salesx"), ("d", "")], "table_id string, namespace string")
    r = {x["table_id"]: x for x in policy.apply(t, doc).collect()}
    assert [r[k]["policy"] for k in "abcd"] == ["one", "one", "two", "two"]
    assert (r["a"]["min_file_bytes"], r["a"]["manifests_crit"], r["a"]["age_warn_ms"], r["a"]["age_crit_ms"], r["a"]["delete_ratio_crit"]) == (64 * MIB, 20, 7 * DAY, 21 * DAY, 0.4)
    assert r["c"]["manifests_crit"] == 5000
    for bad in ("policies: []", "version: '1'\npolicies: [{target_namespace: x}]"):
        with pytest.raises(ValueError):
            policy.parse(bad)


@pytest.mark.parametrize(("text", "ms"), [("30d", 30 * DAY), ("12h", 12 * 3_600_000), ("1h30m", 5_400_000), ("1.5s", 1500), ("0", 0)])
def test_durations(text, ms):
    assert policy.parse_duration(text) == ms


@pytest.mark.parametrize("text", ["", "5", "d", "1dx", "h1"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        policy.parse_duration(text)


def test_diff(spark):
    kind = "table_id string, score int, data_files long, data_bytes long, manifest_count long, position_deletes long, equality_deletes long"
    a, b = (spark.createDataFrame([r], kind) for r in (("t", 70, 10, 105, 3, 1, 0), ("t", 82, 0, 0, 3, 0, 0)))
    d = diff.compared(a, b).first()
    assert (d["score_change"], d["data_files_change"], d["manifest_count_change"], d["avg_file_bytes_before"], d["avg_file_bytes_after"]) == ("(+12)", "(-10)", "(no change)", 10, 0)
    assert diff.long_form(diff.compared(a, b)).count() == 5
