"""Steps whose cost once grew faster than their input, or lay on one task or the driver."""

import io
import json
import os

import pytest
from pyspark.sql import functions as F

from lakescope.functions import pii as detect
from lakescope.operators import orphans, stats
from lakescope.plans import audit, projections, warehouse
from lakescope.sources import avro, catalogs, metadata, objects

TINY = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def root(tmp_path):
    """Tables a.t0 to a.t3 of 40 snapshots that share one manifest list."""
    for t in range(4):
        folder = tmp_path / "a" / f"t{t}" / "metadata"
        folder.mkdir(parents=True)
        with open(folder / "m0.avro", "wb") as f:
            avro.write(f, warehouse.ENTRY, [{"status": 1, "snapshot_id": 1, "sequence_number": None, "data_file": {"content": 0, "file_path": f"s3://b/{t}", "file_format": "PARQUET", "partition": {"day": 1, "region": None}, "record_count": 1, "file_size_in_bytes": 5}}])
        zeros = {f["name"]: 0 for f in warehouse.LIST["fields"]}
        with open(folder / "snap.avro", "wb") as f:
            avro.write(f, warehouse.LIST, [{**zeros, "manifest_path": "m0.avro"}])
        snaps = [{"snapshot-id": i + 1, "timestamp-ms": i, "manifest-list": "snap.avro"} for i in range(40)]
        for v, last in ((9, 3), (10, 40)):
            (folder / f"v{v}.metadata.json").write_text(json.dumps({"format-version": 2, "location": f"s3://b/t{t}", "current-snapshot-id": last, "snapshots": snaps}))
    return str(tmp_path)


def test_local_folders_are_listed_by_tasks(spark, root, monkeypatch):
    def on_driver(*_):
        raise AssertionError("the driver walks folders")

    monkeypatch.setattr(catalogs.os, "walk", on_driver)
    got = catalogs.LocalCatalog(root).entries(spark).collect()
    assert [(r.table_id, r.metadata_location, r.properties) for r in got] == [(f"a.t{t}", f"{root}/a/t{t}/metadata/v10.metadata.json", {}) for t in range(4)]
    assert [r.name for r in catalogs.LocalCatalog(root).entries(spark, namespace="a").collect()] == ["t0", "t1", "t2", "t3"]
    assert catalogs.LocalCatalog(f"{root}/none").entries(spark).count() == 0


def test_a_table_without_documents_ends_a_listing(spark, root):
    os.makedirs(f"{root}/a/empty/metadata")
    with pytest.raises(catalogs.NotFound):
        catalogs.LocalCatalog(root).entries(spark)


def test_documents_are_read_where_entries_lie(spark, root):
    docs = audit.tables_of(spark, catalogs.LocalCatalog(root))
    assert "FileScan json" not in plan(docs) and "Join" not in plan(docs)
    assert {(r.table_id, r.current_snapshot_id, len(r.snapshots)) for r in docs.collect()} == {(f"a.t{t}", 40, 40) for t in range(4)}


def test_the_wanted_snapshot_is_looked_up_in_its_document(spark, root):
    found = metadata.resolved(audit.tables_of(spark, catalogs.LocalCatalog(root)))
    assert "Join" not in plan(found) and "Aggregate" not in plan(found)
    assert {(r.table_id, r.snapshot_id, r.pos) for r in found.collect()} == {(f"a.t{t}", 40, 39) for t in range(4)}


def test_a_list_that_snapshots_share_is_read_once(spark, root):
    docs = audit.tables_of(spark, catalogs.LocalCatalog(root))
    assert metadata.lists(docs).count() == 4
    refs = {r.uri_norm for r in audit.references(docs).filter("table_id = 'a.t0'").collect()}
    assert refs == {f"{root}/a/t0/metadata/v10.metadata.json", f"{root}/a/t0/metadata/snap.avro", f"{root}/a/t0/metadata/m0.avro", "s3://b/0"}


def test_references_are_not_broadcast(spark):
    listing = spark.createDataFrame([("t", "/a", 1, 0), ("t", "/b", 1, 0)], "table_id string, uri string, size_bytes long, updated_at_ms long")
    live = spark.createDataFrame([("t", "/a")], "table_id string, uri_norm string").cache()
    live.count()
    found = orphans.orphans(listing, live, 1 << 40)
    assert "Broadcast" not in plan(found)
    assert [r.uri for r in found.collect()] == ["/b"]
    live.unpersist()


def test_schemas_are_decoded_by_code_made_for_them():
    schema = {"type": "record", "name": "r", "fields": [
        {"name": "i", "type": "long"}, {"name": "u", "type": ["null", "string"]}, {"name": "m", "type": {"type": "map", "values": "double"}}, {"name": "a", "type": {"type": "array", "items": ["null", "long"]}},
        {"name": "in", "type": {"type": "record", "name": "q", "fields": [{"name": "b", "type": "boolean"}, {"name": "y", "type": "bytes"}]}}, {"name": "again", "type": "q"},
    ]}
    rows = [{"i": i, "u": None if i % 2 else "ü" * i, "m": {"x": i / 3}, "a": [None, i], "in": {"b": i % 3 == 0, "y": b"\0" * i}, "again": {"b": False, "y": b""}} for i in (-(2**62), -65, 0, 1, 64, 200)]
    rows = [r if r["i"] >= 0 else {**r, "u": "n", "in": {"b": True, "y": b"z"}} for r in rows]
    body = b"".join(map(avro.encoder({**schema, "fields": schema["fields"][:-1]}), rows))
    out = io.BytesIO()
    known = {**schema, "fields": schema["fields"][:-1]}
    avro.write(out, known, rows)
    decode = avro._decoder(json.dumps(known))
    assert decode.__name__ == "decode"
    expected = [{k: v for k, v in r.items() if k != "again"} for r in rows]
    assert list(decode(body, len(rows))) == expected == list(avro.records(io.BytesIO(out.getvalue())))
    block, names = avro.Reader(body), {}
    assert [block.value(known, names) for _ in rows] == expected
    named = avro._decoder(json.dumps(schema))
    assert list(named(b"\x02\x00\x00\x00\x01\x00\x00\x02\x41", 1)) == [{"i": 1, "u": None, "m": {}, "a": [], "in": {"b": True, "y": b""}, "again": {"b": False, "y": b"A"}}]
    with pytest.raises((ValueError, IndexError)):
        list(decode(body[:-1], len(rows)))


def test_a_schema_that_holds_itself_is_still_read():
    schema = {"type": "record", "name": "n", "fields": [{"name": "v", "type": "int"}, {"name": "next", "type": ["null", "n"]}]}
    assert list(avro._decoder(json.dumps(schema))(b"\x02\x02\x04\x00", 1)) == [{"v": 1, "next": {"v": 2, "next": None}}]


def test_listings_travel_in_full_batches(spark, tmp_path):
    for t in range(50):
        (tmp_path / f"t{t}").mkdir()
        (tmp_path / f"t{t}" / "o").write_text("x" * t)
    prefixes = spark.createDataFrame([(f"t{t}", f"{tmp_path}/t{t}") for t in range(50)], "table_id string, prefix string")
    listing = objects.listed(spark, prefixes)
    assert {(r.table_id, r.size_bytes) for r in listing.collect()} == {(f"t{t}", t) for t in range(50)}
    assert "json" not in plan(warehouse._listing(spark, TINY))  # listing asks for no document


def test_a_size_sample_sorts_first_manifests_only(spark):
    files = spark.range(40_000).select(F.lit("t").alias("table_id"), F.lit(1).alias("status"), F.lit(0).alias("content"), (F.col("id") % 1000).cast("int").alias("manifest_pos"), F.col("id").alias("entry_pos"), F.col("id").alias("file_size_bytes"))
    sample = stats.size_sample(files)
    expected = sorted(((i % 1000, i) for i in range(40_000)))[:1024]
    assert sample.first()["sizes"] == [i for _, i in expected]
    assert "Broadcast" in plan(sample)
    assert len(stats.size_sample(files, 7).first()["sizes"]) == 7


def test_cells_are_dealt_to_all_tasks(spark):
    made = projections.cells(spark, TINY)
    assert plan(made).count("Exchange hashpartitioning") == 4
    per = made.filter("table_id = 't.customer'").groupBy(F.spark_partition_id()).count().count()
    assert per == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_pattern_is_looked_for_after_what_it_holds(spark):
    texts = spark.createDataFrame([("a@b.org",), ("a at b.org",), ("A.B@C.NET x",), ("@",), (None,)], "t string")
    for kind, p in detect.PATTERNS.items():
        got = [tuple(r) for r in texts.select(detect.matches(F.col("t"), kind), F.col("t").rlike(p)).collect()]
        assert all(a == b for a, b in got), kind


WANTED = ("status", "content", "record_count", "file_size_bytes", "file_path", "partition_key")


def plain_columns(path):
    """Wanted columns of a manifest by the plain decoder, until it turns out to be bad."""
    out = []
    try:
        with open(path, "rb") as f:
            for r in avro.records(f):
                if (x := avro.file_row(r)) is not None:
                    out.append((x[0], x[3], x[7], x[8], x[4], "/".join(f"{k}={'<nil>' if v is None else v}" for k, v in sorted(x[6]))))
    except (OSError, ValueError, IndexError):
        pass
    return out


def test_wanted_columns_of_entries_are_those_of_whole_ones(spark, tmp_path):
    def schema(partition, path="string", status="int", data=None, **more):
        fields = [{"name": "content", "type": "int"}, {"name": "file_path", "type": path}, *({"name": k, "type": t} for k, t in more.items())]
        fields += [{"name": "partition", "type": {"type": "record", "name": "p", "fields": [{"name": k, "type": t} for k, t in partition.items()]}}] if partition is not None else []
        fields += [{"name": "record_count", "type": "long"}, {"name": "file_size_in_bytes", "type": ["null", "long"]}]
        data = {"type": "record", "name": "d", "fields": fields}
        return {"type": "record", "name": "e", "fields": [{"name": "status", "type": status}, {"name": "snapshot_id", "type": ["null", "long"]}, {"name": "data_file", "type": data}]}

    def rows(parts, path="s3://b/ü", status=1, **more):
        return [{"status": status, "snapshot_id": 1 << 40 if i % 2 else None, "data_file": {"content": i % 3, "file_path": path, **more, "partition": p, "record_count": i << 33, "file_size_in_bytes": i * 7 if i % 4 else None}} for i, p in enumerate(parts)]

    skipped = {"sizes": {"type": "map", "values": "long"}, "offsets": {"type": "array", "items": ["null", "long"]}, "raw": "bytes", "x": "double", "sub": {"type": "record", "name": "q", "fields": [{"name": "b", "type": "boolean"}]}}
    given = {"sizes": {"a": 1 << 50}, "offsets": [None, -7], "raw": b"\0" * 300, "x": 0.5, "sub": {"b": True}}
    made = {
        "plain": (schema({"z": ["null", "int"], "a": ["null", "string"]}, **skipped), rows([{"z": i % 5 - 2, "a": None if i % 2 else f"r{i % 3}"} for i in range(300)], **given)),
        "floats": (schema({"f": "double", "b": "bytes"}), rows([{"f": f, "b": b"\1\2"} for f in (0.0, -0.0, 1.0, 1e22, 2.5)])),
        "logical": (schema({"d": {"type": "int", "logicalType": "date"}, "t": "boolean"}), rows([{"d": 19_000, "t": i == 1} for i in range(3)])),
        "no_values": (schema({}), rows([{}] * 3)),
        "no_partition": (schema(None), rows([{}] * 3)),
        "nullable_path": (schema({"z": "int"}, path=["null", "string"]), rows([{"z": 1}] * 3, path=None)),
        "text_status": (schema({"z": "int"}, status="string"), rows([{"z": 1}] * 3, status="x")),
        "empty": (schema({"z": "int"}), []),
    }
    for name, (s, r) in made.items():
        with open(tmp_path / f"{name}.avro", "wb") as f:
            avro.write(f, s, r, "null" if name == "plain" else "deflate")
    body = (tmp_path / "plain.avro").read_bytes()
    (tmp_path / "cut.avro").write_bytes(body[:-2000])
    (tmp_path / "ends.avro").write_bytes(body[:-3] + b"xyz")
    names = [*made, "cut", "ends", "missing"]
    paths = spark.createDataFrame([(n, f"{tmp_path}/{n}.avro") for n in names], "table_id string, path string")
    got = avro.entry_columns(paths, WANTED, skip_bad=True).collect()
    for n in names:
        assert [tuple(r)[1:] for r in got if r.table_id == n] == plain_columns(f"{tmp_path}/{n}.avro"), n
    assert len([r for r in got if r.table_id == "ends"]) == 300
    fast = {n: avro._narrow(json.dumps(s), WANTED) is not None for n, (s, _) in made.items()}
    assert [n for n, x in fast.items() if not x] == ["nullable_path", "text_status"]
    some = avro.entry_columns(paths.filter("table_id = 'floats'"), ("partition_key", "content")).collect()
    assert [(r.partition_key, r.content) for r in some] == [(x[5], x[1]) for x in plain_columns(f"{tmp_path}/floats.avro")]
    with pytest.raises(Exception, match="ends within|marker|No such file"):
        avro.entry_columns(paths, ("status",)).count()


def test_full_batches_leave_while_a_manifest_is_read(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(avro, "BATCH", 7)
    out = io.BytesIO()
    avro.write(out, warehouse.ENTRY, [{"status": 1, "snapshot_id": 1, "sequence_number": None, "data_file": {"content": 0, "file_path": "", "file_format": "", "partition": {"day": i, "region": None}, "record_count": 1, "file_size_in_bytes": i}} for i in range(20)])
    held = avro._Columns(("file_size_bytes", "partition_key"), pa.schema([("t", pa.string()), ("s", pa.int64()), ("k", pa.string())]))
    batches = [b for name in ("a", "b") for b in held.take((name,), avro._blocks(io.BytesIO(out.getvalue())))] + [held.batch()]
    assert [b.num_rows for b in batches] == [7, 7, 7, 7, 7, 5]
    assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == [(t, i, f"day={i}/region=<nil>") for t in "ab" for i in range(20)]


def test_statistics_keep_no_entries_and_read_them_once(spark, root):
    kept = []
    docs = audit.tables_of(spark, catalogs.LocalCatalog(root))
    stat = audit.statistics(docs, 100, kept=kept)
    assert len(kept) == 2 and all("status" not in f.columns for f in kept)
    assert "file_path" not in plan(stat)
    rows = stat.select("table_id", "manifest_count", "data_files", "data_bytes", "partitions", "median", "hot", "sparse", "snapshot_count").collect()
    assert {tuple(r) for r in rows} == {(f"a.t{t}", 1, 1, 5, 1, 5, 0, 0, 40) for t in range(4)}
    audit.release(kept)


def test_a_scan_adds_up_in_one_pass(spark):
    files = [(t, i % 7 % 3, i % 5 % 3, None if i % 11 == 0 else (i * 7919 % 1000) ** (2 + i % 2) * (i % 13), None if i % 17 == 0 else "" if i % 19 == 0 else f"k={i * i % 43 % 29}") for t, n in (("a", 500), ("b", 97), ("c", 2), ("d", 1)) for i in range(1, n + 1)]
    frame = spark.createDataFrame(files, "table_id string, status int, content int, file_size_bytes long, partition_key string")
    got = {r.table_id: r for r in stats.scan_stats(frame).collect()}
    whole = {r.table_id: r for r in stats.file_stats(frame).collect()}
    assert {t: tuple(r[c] for c in stats.TOTALS) for t, r in got.items()} == {t: tuple(r[c] for c in stats.TOTALS) for t, r in whole.items()}
    for t, r in got.items():
        sums = {}
        for _, status, content, size, key in (f for f in files if f[0] == t):
            if status != 2 and content == 0 and key:
                sums.setdefault(key, []).append(size)
        sizes = sorted(sum(x for x in v if x is not None) for v in sums.values() if any(x is not None for x in v))
        middle = (sizes[(len(sizes) - 1) // 2] + sizes[len(sizes) // 2]) // 2 if sizes else None
        assert (r.partitions, r.median) == (len(sums), middle), t
        assert (r.hot, r.sparse) == (sum(x > 2 * middle > 0 for x in sizes) if sizes else 0, sum(middle > 0 and x < middle * 0.1 for x in sizes) if sizes else 0), t
    parted = frame.withColumn("record_count", F.lit(1))
    assert "Join" not in plan(stats.skew(stats.partition_stats(parted)))


def test_records_are_written_by_code_made_for_their_schema():
    schema = {"type": "record", "name": "r", "fields": [
        {"name": "i", "type": "long"}, {"name": "u", "type": ["null", "string"]}, {"name": "w", "type": ["long", "null"]}, {"name": "b", "type": "bytes"}, {"name": "d", "type": "double"}, {"name": "t", "type": "boolean"}, {"name": "n", "type": "null"},
        {"name": "in", "type": {"type": "record", "name": "q", "fields": [{"name": "day", "type": ["null", "int"]}, {"name": "m", "type": {"type": "map", "values": "long"}}]}}, {"name": "o", "type": ["null", {"type": "record", "name": "s", "fields": [{"name": "x", "type": "int"}]}]},
    ]}
    numbers = [0, -1, 63, 64, 1023, 1024, *(s * (1 << k) + j for k in (13, 20, 27, 28, 34, 35, 62) for j in (-1, 0) for s in (1, -1))]
    rows = [{"i": i, "u": None if i % 3 else f"ü{i}", "w": None if i % 2 else i, "b": b"\0" * (k * 9), "d": i / 3, "t": i % 2 == 0, "n": None, "in": {"day": None if k % 2 else k, "m": {"a": i} if k % 3 else {}}, "o": {"x": k} if k % 4 else None} for k, i in enumerate(numbers)]
    _, encode = avro._writer(json.dumps(schema), "null")
    assert encode.__name__ == "encode"
    assert encode(rows) == b"".join(map(avro.encoder(schema), rows))
    for codec in ("null", "deflate"):
        out = io.BytesIO()
        avro.write(out, schema, rows, codec)
        assert list(avro.records(io.BytesIO(out.getvalue()))) == rows
    assert avro._writer(json.dumps(schema["fields"][1]["type"]), "null")[1]([None, "x"]) == b"\0\2\2x"
    assert avro._writer(json.dumps(["long", "string"]), "null")[1]([3]) == b"\0\6"


def test_references_and_migration_read_wanted_fields_only(spark, root):
    catalog = catalogs.LocalCatalog(root)
    assert "entry_pos" not in plan(audit.references(audit.tables_of(spark, catalog)))
    found = audit.migration(spark, catalog)
    assert "entry_pos" not in plan(found)
    assert {(r.table_id, r.data_file_count, r.total_data_bytes) for r in found.collect()} == {(f"a.t{t}", 1, 5) for t in range(4)}
