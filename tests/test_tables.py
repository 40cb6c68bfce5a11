"""Whole audits over a small warehouse in the real formats."""

import io
import json
import os
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from lakescope.plans import audit, cli, metrics, render
from lakescope.sources import avro, catalogs, metadata, objects
from lakescope.streaming import monitor

NOW = int(time.time() * 1000)
DAY = 86_400_000
LIST = {"type": "record", "name": "manifest_file", "fields": [{"name": n, "type": t} for n, t in [("manifest_path", "string"), ("manifest_length", "long"), ("partition_spec_id", "int"), ("content", "int"), ("sequence_number", "long"), ("min_sequence_number", "long"), ("added_snapshot_id", "long"), ("added_files_count", ["null", "int"]), ("existing_files_count", "int"), ("deleted_files_count", "int"), ("added_rows_count", "long"), ("existing_rows_count", "long"), ("deleted_rows_count", "long")]]}
PART = {"type": "record", "name": "r102", "fields": [{"name": "day", "type": ["null", "int"]}, {"name": "region", "type": ["null", "string"]}]}
DATA = {"type": "record", "name": "r2", "fields": [{"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "partition", "type": PART}, {"name": "record_count", "type": "long"}, {"name": "file_size_in_bytes", "type": "long"}, {"name": "sizes", "type": ["null", {"type": "map", "values": "long"}]}, {"name": "offsets", "type": {"type": "array", "items": "long"}}]}
ENTRY = {"type": "record", "name": "manifest_entry", "fields": [{"name": "status", "type": "int"}, {"name": "snapshot_id", "type": ["null", "long"]}, {"name": "sequence_number", "type": ["null", "long"]}, {"name": "data_file", "type": DATA}]}


def save(path, schema, rows, codec="deflate"):
    with open(path, "wb") as f:
        avro.write(f, schema, rows, codec)


def entry(path, content=0, size=256 << 20, status=1, day=1, region=None):
    return {"status": status, "snapshot_id": 1, "sequence_number": None, "data_file": {"content": content, "file_path": path, "file_format": "PARQUET", "partition": {"day": day, "region": region}, "record_count": 5, "file_size_in_bytes": size, "sizes": {"a": 1}, "offsets": [1, 2]}}


def table(root, name, entries, version=2, properties=None, location=None, snapshots=1, refs=None):
    base = f"{root}/db/{name}"
    meta = f"{base}/metadata"
    os.makedirs(meta)
    os.makedirs(f"{base}/data", exist_ok=True)
    save(f"{meta}/m0.avro", ENTRY, entries)
    save(f"{meta}/snap-1.avro", LIST, [{"manifest_path": f"{meta}/m0.avro", "manifest_length": 1, "partition_spec_id": 0, "content": 0, "sequence_number": 1, "min_sequence_number": 1, "added_snapshot_id": 1, "added_files_count": None, "existing_files_count": 0, "deleted_files_count": 0, "added_rows_count": 1, "existing_rows_count": 0, "deleted_rows_count": 0}], "null")
    snaps = [{"snapshot-id": 2**60 + k, "sequence-number": k, "timestamp-ms": NOW - (snapshots - k) * 60_000, "manifest-list": "snap-1.avro", "summary": {"operation": "append", "added-data-files": "2", "added-files-size": str(1 << 30)}} for k in range(snapshots)]
    doc = {"format-version": version, "table-uuid": "u", "location": location or base, "last-updated-ms": NOW, "current-snapshot-id": 2**60 + snapshots - 1 if snapshots else -1, "snapshots": snaps, "properties": properties or {}, "refs": refs or {}, "schemas": [{"type": "struct", "schema-id": 0, "fields": [{"id": 1, "name": "x", "required": True, "type": {"type": "list", "element": "int"}}]}]}
    for v, d in ((9, {**doc, "snapshots": []}), (10, doc)):
        with open(f"{meta}/v{v}.metadata.json", "w") as f:
            json.dump(d, f)
    return base


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("wh"))
    base = table(root, "healthy", [entry(f"{root}/db/healthy/data/part-{k}.parquet", day=k) for k in range(2)], snapshots=30, refs={"old": {"snapshot-id": 2**60, "type": "branch"}})
    rows = spark.createDataFrame([(k, f"u{k}@mail.example.org", "plain text") for k in range(50)], "id long, email string, note string")
    rows.coalesce(1).write.parquet(f"{base}/tmp")
    part = next(f for f in os.listdir(f"{base}/tmp") if f.endswith(".parquet"))
    for k in range(2):
        with open(f"{base}/tmp/{part}", "rb") as a, open(f"{base}/data/part-{k}.parquet", "wb") as b:
            b.write(a.read())
    with open(f"{base}/data/.hidden-orphan", "wb") as f:
        f.write(b"x" * 10)
    old = time.time() - 3 * 86_400
    os.utime(f"{base}/data/.hidden-orphan", (old, old))
    table(root, "sick", [entry("a", day=1), entry("b", day=None, region="eu"), *(entry(f"d{k}", content=1) for k in range(4)), entry("gone", status=2)])
    table(root, "hdfs", [entry("hdfs://nn/f")], version=1, properties={"write.distribution-mode": "none"}, location="hdfs://nn/w")
    return root


def test_avro_codecs_and_types():
    schema = {"type": "record", "name": "x", "fields": [{"name": "a", "type": "double"}, {"name": "b", "type": ["null", "bytes"]}, {"name": "c", "type": {"type": "map", "values": "string"}}, {"name": "d", "type": "boolean"}]}
    rows = [{"a": 1.5, "b": None, "c": {"k": "v"}, "d": True}, {"a": -2.0, "b": b"\x00\xff", "c": {}, "d": False}]
    for codec in ("null", "deflate"):
        f = io.BytesIO()
        avro.write(f, schema, rows, codec)
        assert list(avro.records(io.BytesIO(f.getvalue()))) == rows
        with pytest.raises(ValueError):
            list(avro.records(io.BytesIO(f.getvalue()[:-3])))
    with pytest.raises(ValueError):
        list(avro.records(io.BytesIO(b"junk")))
    assert [avro.plain(v) for v in (None, 3, True, 1.5, 2.0, 1e21, b"\x01\x02", "x")] == [None, "3", "true", "1.5", "2", "1e+21", "[1 2]", "x"]


def test_catalog(spark, root):
    c = catalogs.LocalCatalog(root)
    assert c.tables("db") == [("db", "hdfs"), ("db", "healthy"), ("db", "sick")] == catalogs.LocalCatalog(root).tables("")
    assert c.load("db", "healthy").metadata_location.endswith("v10.metadata.json")
    assert catalogs.LocalCatalog(root, compat=True).load("db", "healthy").metadata_location.endswith("v9.metadata.json")
    with pytest.raises(catalogs.NotFound):
        c.load("db", "none")
    assert catalogs.LocalCatalog(root + "/nowhere").tables("x") == []


def test_audit_namespace(spark, root):
    got = {r["table_id"]: r for r in audit.audit(spark, catalogs.LocalCatalog(root), namespace="db", now_ms=NOW).collect()}
    assert {k: r["worst_severity"] for k, r in got.items()} == {"db.healthy": "OK", "db.sick": "CRITICAL", "db.hdfs": "INFO"}
    h = got["db.healthy"]
    assert (h["score"], h["max_score"], h["snapshot_id"], h["write_pattern"]) == (90, 90, 2**60 + 29, "streaming")
    one = audit.audit(spark, catalogs.LocalCatalog(root), "db.healthy", branch="old", now_ms=NOW).first()
    assert one["snapshot_id"] == 2**60
    lost = audit.audit(spark, catalogs.LocalCatalog(root), "db.healthy", branch="none", now_ms=NOW).first()
    assert (lost["snapshot_id"], lost["branch_found"]) == (0, False)


def test_files_and_keys(spark, root):
    t = audit.tables_of(spark, catalogs.LocalCatalog(root), "db.sick")
    files = metadata.files(metadata.manifests(metadata.resolved(t)))
    assert {r["partition_key"] for r in files.collect()} == {"day=1/region=<nil>", "day=<nil>/region=eu"}
    assert files.filter("content = 1").count() == 4


def test_orphans(spark, root):
    r = audit.orphans(spark, catalogs.LocalCatalog(root), "db.healthy", now_ms=NOW)
    assert (r["candidates"], r["total_bytes"], r["scanned_objects"]) == (1, 10, 3)
    assert r["preview"][0]["uri"].endswith("/.hidden-orphan")
    assert "Found 1 orphan candidate(s)" in render.orphans_text("db.healthy", r["prefix"], r)


def test_pii_migration_cost(spark, root):
    files, found = audit.pii(spark, catalogs.LocalCatalog(root), "db.healthy")
    assert files == 2 and [(f["column"], f["pii_type"], f["confidence"]) for f in found] == [("email", "EMAIL", 1.0)]
    risks = {r["table_id"]: r["risk"] for r in audit.migration(spark, catalogs.LocalCatalog(root), namespace="db").collect()}
    assert risks == {"db.healthy": "LOW", "db.sick": "LOW", "db.hdfs": "HIGH"}
    assert audit.cost(spark, catalogs.LocalCatalog(root), "db.healthy").collect()[-1]["cumulative_gb"] == 30


def test_bench(spark, root, tmp_path):
    c = catalogs.LocalCatalog(root)
    path = audit.bench_start(spark, c, "db/healthy", folder=str(tmp_path))
    assert os.path.basename(path) == "db.healthy_default.json"
    d = audit.bench_compare(spark, c, "db.healthy", folder=str(tmp_path))
    assert d["score_change"] == "(no change)" and "Health Score:" in render.diff_text("default", d)


@pytest.fixture(scope="module")
def audited(spark, root):
    """Audits of a namespace and of a table, made once."""
    catalog = catalogs.LocalCatalog(root)
    out = {name: audit.audit(spark, catalog, **{kind: name}) for kind, name in (("namespace", "db"), ("table", "db.healthy"))}
    return {k: spark.createDataFrame(f.collect(), f.schema) for k, f in out.items()}


@pytest.mark.parametrize(("args", "code", "text"), [
    (["audit", "--namespace", "db"], 2, "Table: db.sick"), (["audit", "--namespace", "db", "--fail-on", "never"], 0, "[CRITICAL]"), (["audit", "--table", "db.healthy", "--format", "json"], 0, '"score": 90'),
    (["audit", "--namespace", "db", "--format", "sarif"], 2, "lakescope/delete_amplification"), (["audit", "--namespace", "db", "--format", "prom"], 2, 'iceberg_table_health_score{catalog="localfs"'), (["audit", "--table", "db.none"], 5, ""), (["audit", "--catalog", "zzz"], 5, ""),
    (["audit", "--format", "zzz"], 4, ""), (["audit", "--namespace", "empty"], 0, "no tables"), (["orphans", "--table", "db.healthy", "--grace-period", "1d"], 0, "Found 1"), (["pii", "--table", "db.healthy"], 3, "[EMAIL]"), (["pii", "--table", "db.healthy", "--format", "atlas"], 3, "review_required"),
    (["migration", "--namespace", "db"], 2, "HDFS_DATA_PATH"), (["cost", "--table", "db.healthy", "--rate", "0.1"], 0, "$0.1000"), (["cost"], 4, ""), (["version"], 0, "lakescope"), (["audit", "--table", "db.healthy", "--atlas-output", "-"], 0, "HEALTH_OK"), (["audit", "--table", "db.healthy", "--min-health-score", "91"], 2, ""),
])
def test_cli(spark, root, audited, monkeypatch, args, code, text):
    if args[0] == "audit" and args[1] != "--catalog" and args[2] in audited:
        monkeypatch.setattr(audit, "audit", lambda *a, **k: audited[args[2]])
    out = io.StringIO()
    args = args if args[0] == "version" else [*args, "--catalog-root", root]
    assert cli.main(args, spark, out) == code
    assert text in out.getvalue()


def test_exposition(spark, root):
    page = metrics.exposition(audit.audit(spark, catalogs.LocalCatalog(root), "db.healthy", now_ms=NOW))
    lines = page.splitlines()
    assert lines[:3] == ["# HELP iceberg_table_health_score Composite table health score (0..max).", "# TYPE iceberg_table_health_score gauge", 'iceberg_table_health_score{catalog="localfs",format_version="2",table="db.healthy",write_pattern="streaming"} 90']
    assert 'iceberg_table_dimension_score{catalog="localfs",format_version="2",table="db.healthy",write_pattern="streaming",dimension="file_size"} 20' in lines
    assert len(lines) == 7 * 2 + 4 + 18


def test_push():
    seen = []

    class Answer:
        status = 200
        __enter__ = lambda self: self
        __exit__ = lambda self, *a: None

    metrics.push("http://g/", "job", "page", "i", lambda r: seen.append(r) or Answer())
    assert seen[0].full_url == "http://g/metrics/job/job/instance/i" and seen[0].get_method() == "PUT"
    Answer.status = 500
    with pytest.raises(RuntimeError):
        metrics.push("http://g/", "job", "page", "", lambda r: Answer())
    with pytest.raises(ValueError):
        metrics.push("", "job", "")


def test_monitor(spark, root):
    state = monitor.State()
    server = monitor.serve(state, "127.0.0.1", 0)
    url = f"http://127.0.0.1:{server.server_address[1]}"
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(url + "/metrics")
    assert e.value.code == 503
    query = monitor.watch(spark, lambda: audit.audit(spark, catalogs.LocalCatalog(root), "db.healthy"), state, 3_600_000)
    try:
        assert state.get()[2] is None
        assert urllib.request.urlopen(url + "/healthz").read() == b"ok"
        assert b"iceberg_table_health_score" in urllib.request.urlopen(url + "/metrics").read()
    finally:
        query.stop()
        server.shutdown()

    def bad():
        raise RuntimeError("no")

    monitor.scan_once(bad, state)
    assert state.get()[2] == "no"


def test_commit_rates(spark, tmp_path):
    rows = spark.createDataFrame([("t", "2024-01-01 00:10:00", 5), ("t", "2024-01-01 00:50:00", 7), ("t", "2024-01-01 03:00:00", 1)], "table_id string, ts string, added_bytes long").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = monitor.commit_rates(stream).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r[2:] for r in spark.sql("select * from rates").collect()] == [(2, 12)]


def test_rest_catalog():
    calls = []

    def send(request):
        calls.append((request.full_url, request.headers.get("Authorization")))
        if request.full_url == "http://o/token":
            return {"access_token": "T"}
        if "pageToken=2" in request.full_url:
            return {"identifiers": [{"namespace": ["a", "b"], "name": "y"}]}
        if request.full_url.endswith("/tables"):
            return {"identifiers": [{"namespace": ["a", "b"], "name": "x"}], "next-page-token": "2"}
        if request.full_url.endswith("none"):
            raise urllib.error.HTTPError(request.full_url, 404, "", {}, None)
        return {"metadata-location": "s3://m", "metadata": {"properties": {"k": "v"}}}

    clock = [0.0]
    c = catalogs.RestCatalog("http://r/", "p", oauth=("http://o/token", "id", "s"), send=send, clock=lambda: clock[0])
    assert c.tables("a.b") == [("a.b", "x"), ("a.b", "y")]
    assert c.load("a.b", "x").properties == {"k": "v"}
    with pytest.raises(catalogs.NotFound):
        c.load("a", "none")
    assert sum(u == "http://o/token" for u, _ in calls) == 1 and calls[-1][1] == "Bearer T" and "/v1/p/namespaces/a%1Fb/tables" in calls[1][0]
    clock[0] = 3571
    c.tables("a.b")
    assert sum(u == "http://o/token" for u, _ in calls) == 2


def test_glue_catalog():
    class Client:
        def get_table(self, DatabaseName, Name):
            if Name == "none":
                raise type("EntityNotFoundException", (Exception,), {})()
            return {"Table": {"Parameters": {"metadata_location": "", "metadata-location": "s3://m"} if Name == "x" else {}}}

        def get_paginator(self, name):
            pages = [{"TableList": [{"Name": "x", "Parameters": {"table_type": "iceberg"}}, {"Name": "y", "Parameters": {"table_type": "HIVE", "metadata_location": "z"}}]}, {"TableList": [{"Name": "w", "Parameters": {"metadata_location": "z"}}, {"Name": "v"}]}]
            return type("P", (), {"paginate": lambda self, **k: pages})()

    c = catalogs.GlueCatalog(Client())
    assert c.load("d", "x").metadata_location == "s3://m" and c.tables("d") == [("d", "x"), ("d", "w")]
    for bad in ("none", "y"):
        with pytest.raises(catalogs.NotFound):
            c.load("d", bad)
    with pytest.raises(ValueError):
        c.tables("")


def test_hive_catalog(spark, tmp_path):
    spark.sql("create database if not exists hv")
    spark.sql(f"create table hv.t (x int) using parquet location '{tmp_path}/t' tblproperties ('metadata_location'='s3://m')")
    spark.sql(f"create table hv.u (x int) using parquet location '{tmp_path}/u'")
    c = catalogs.catalog("hive", spark)
    assert sorted(c.tables("hv")) == [("hv", "t"), ("hv", "u")] and c.load("hv", "t").metadata_location == "s3://m"
    for bad in ("u", "none"):
        with pytest.raises(catalogs.NotFound):
            c.load("hv", bad)


def test_listing(spark, root):
    prefixes = spark.createDataFrame([("t", f"file://{root}/db/healthy/data")], "table_id string, prefix string")
    uris = sorted(r["uri"] for r in objects.listed(spark, prefixes).collect())
    assert len(uris) == 3 and all(u.startswith("file:///") for u in uris)
