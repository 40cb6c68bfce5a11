"""WebHDFS and S3 stores against small servers of their protocols."""

import json
import os
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
import test_tables as t

from lakescope.plans import audit
from lakescope.sources import catalogs, objects, stores


def served(handler):
    server = ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


@pytest.fixture(scope="module")
def namenode(tmp_path_factory):
    """A folder behind WebHDFS; OPEN goes to a data node by a redirect, as in a real one."""
    root = str(tmp_path_factory.mktemp("hdfs"))
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def reply(self, code, body=b""):
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self):
            url = urllib.parse.urlsplit(self.path)
            q = dict(urllib.parse.parse_qsl(url.query))
            at = root + urllib.parse.unquote(url.path.removeprefix("/webhdfs/v1").removeprefix("/node"))
            seen.append((q["op"], q.get("user.name")))
            status = lambda p, name: {"pathSuffix": name, "type": "DIRECTORY" if os.path.isdir(p) else "FILE", "length": os.path.getsize(p), "modificationTime": int(os.path.getmtime(p) * 1000)}
            if "forbidden" in at:
                self.reply(403)
            elif not os.path.exists(at):
                self.reply(404)
            elif q["op"] == "LISTSTATUS":
                rows = [status(f"{at}/{n}", n) for n in sorted(os.listdir(at))] if os.path.isdir(at) else [status(at, "")]
                self.reply(200, json.dumps({"FileStatuses": {"FileStatus": rows}}).encode())
            elif q["op"] == "GETFILESTATUS":
                self.reply(200, json.dumps({"FileStatus": status(at, "")}).encode())
            elif url.path.startswith("/webhdfs"):
                self.send_response(307)
                self.send_header("Location", self.path.replace("/webhdfs/v1", "/node", 1))
                self.send_header("Content-Length", "0")
                self.end_headers()
            else:
                with open(at, "rb") as f:
                    f.seek(int(q.get("offset", 0)))
                    self.reply(200, f.read(int(q.get("length", -1))))

    server = served(Handler)
    yield root, stores.Stores(f"http://127.0.0.1:{server.server_address[1]}/webhdfs/v1/", "reader"), seen
    server.shutdown()


@pytest.fixture
def session(spark):
    kept = []
    yield lambda s: (s.set(spark), kept.append(s), spark)[-1]
    for name in ("webhdfs.url", "webhdfs.user", "s3.endpoint", "s3.region"):
        spark.conf.unset(stores.SETTINGS + name)


def test_webhdfs_audit(session, namenode):
    root, s, seen = namenode
    spark = session(s)
    base = t.table(root, "far", [t.entry("hdfs://nn/db/far/data/a b.parquet"), t.entry("hdfs://nn/db/far/data/b.parquet", day=2)], location="hdfs://nn/db/far")
    t.save(f"{base}/metadata/snap-1.avro", t.LIST, [{**{f["name"]: 1 for f in t.LIST["fields"]}, "manifest_path": "hdfs://nn/db/far/metadata/m0.avro", "content": 0}])
    rows = spark.createDataFrame([(k, f"u{k}@mail.example.org") for k in range(50)], "id long, email string")
    rows.coalesce(1).write.parquet(f"{base}/tmp")
    part = next(f for f in os.listdir(f"{base}/tmp") if f.endswith(".parquet"))
    os.replace(f"{base}/tmp/{part}", f"{base}/data/a b.parquet")
    with open(f"{base}/data/.lost", "wb") as f:
        f.write(b"x" * 10)
    os.utime(f"{base}/data/.lost", (1, 1))

    def send(request):
        return {"metadata-location": "hdfs://nn/db/far/metadata/v10.metadata.json", "metadata": {}}

    c = catalogs.RestCatalog("http://r/", "p", send=send)
    report = audit.audit(spark, c, "db.far").first()
    assert report["branch_found"] and report["table_id"] == "db.far"
    stat = audit.statistics(audit.tables_of(spark, c, "db.far"), t.NOW).first()
    assert (stat["data_files"], stat["data_bytes"], stat["manifest_count"]) == (2, 512 << 20, 1)
    files, found = audit.pii(spark, c, "db.far", fraction=1.0)
    assert files == 2 and [(r["column"], r["pii_type"]) for r in found] == [("email", "EMAIL")]
    lost = audit.orphans(spark, c, "db.far")
    assert lost["candidates"] == 1 and lost["preview"][0]["uri"] == "hdfs://nn/db/far/data/.lost" and lost["total_bytes"] == 10
    assert {u for _, u in seen} == {"reader"}


def test_webhdfs_files(namenode):
    root, s, _ = namenode
    os.makedirs(f"{root}/deep/x/y/z")
    body = bytes(range(256)) * 9000
    for name in ("deep/top", "deep/x/y/z/ü 1%"):
        with open(f"{root}/{name}", "wb") as f:
            f.write(body)
    assert sorted(u for files in s.walk("hdfs://nn/deep") for u, _, _ in files) == ["hdfs://nn/deep/top", "hdfs://nn/deep/x/y/z/ü 1%"]
    assert s.level("hdfs://nn/deep/top")[0][0][0] == "hdfs://nn/deep/top"
    f = s.seekable("hdfs://nn/deep/x/y/z/ü 1%")
    assert f.seek(-5, os.SEEK_END) == len(body) - 5 and f.read() == body[-5:] and f.read() == b""
    assert f.seek(3) == 3 and f.read(1 << 21) == body[3 : 3 + (1 << 21)]
    assert s.open("hdfs://nn/deep/top").read() == body
    for uri, kind in (("hdfs://nn/none", FileNotFoundError), ("hdfs://nn/forbidden", OSError)):
        for ask in (s.open, s.seekable, s.level):
            with pytest.raises(kind):
                ask(uri)


def test_s3(monkeypatch):
    """The settings reach the client: a listing and a read of a server of one bucket."""
    for k, v in {"AWS_ACCESS_KEY_ID": "k", "AWS_SECRET_ACCESS_KEY": "s", "AWS_EC2_METADATA_DISABLED": "true", "no_proxy": "127.0.0.1"}.items():
        monkeypatch.setenv(k, v)
    stored = {"wh/a/m.avro": b"abc", "wh/a/d/.f": b"12345", "wh/b": b"no"}
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def reply(self, code, body=b"", kind="application/xml"):
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.send_header("Last-Modified", "Mon, 01 Jan 2024 00:00:00 GMT")
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        def do_GET(self):
            url = urllib.parse.urlsplit(self.path)
            q, key = dict(urllib.parse.parse_qsl(url.query)), url.path.removeprefix("/bucket").lstrip("/")
            seen.append(self.headers.get("Authorization", ""))
            if key:
                body = stored.get(key)
                self.reply(404) if body is None else self.reply(200, body, "application/octet-stream")
                return
            lead, files, folders = q.get("prefix", ""), "", set()
            for k, v in stored.items():
                if k.startswith(lead):
                    name, mark, _ = k[len(lead):].partition("/")
                    if mark and q.get("delimiter"):
                        folders.add(lead + name + "/")
                    else:
                        files += f"<Contents><Key>{k}</Key><Size>{len(v)}</Size><LastModified>2024-01-01T00:00:00.000Z</LastModified></Contents>"
            folders = "".join(f"<CommonPrefixes><Prefix>{f}</Prefix></CommonPrefixes>" for f in sorted(folders))
            self.reply(200, f'<?xml version="1.0"?><ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><Name>bucket</Name><IsTruncated>false</IsTruncated>{files}{folders}</ListBucketResult>'.encode())

        do_HEAD = do_GET

    server = served(Handler)
    s = stores.Stores(s3_endpoint=f"http://127.0.0.1:{server.server_address[1]}", s3_region="eu-north-1")
    try:
        assert s.serves("s3://bucket/wh") and not s.serves("s3a://bucket/wh") and not s.serves("hdfs://nn/x")
        found = sorted(f for files in s.walk("s3://bucket/wh/a/") for f in files)
        assert found == [("s3://bucket/wh/a/d/.f", 5, 1704067200000), ("s3://bucket/wh/a/m.avro", 3, 1704067200000)]
        assert s.open("s3://bucket/wh/a/m.avro").read() == b"abc"
        with pytest.raises(FileNotFoundError):
            s.open("s3://bucket/wh/none")
        assert any("eu-north-1" in x for x in seen)
    finally:
        server.shutdown()


def test_unknown_scheme_and_depth(session, tmp_path):
    spark = session(stores.Stores())
    os.makedirs(tmp_path / "a/b/c/d")
    for name in ("0", "a/1", "a/b/2", "a/b/c/3", "a/b/c/d/4"):
        (tmp_path / name).write_text("x")
    os.symlink(tmp_path / "0", tmp_path / "a/link")
    frame = spark.createDataFrame([("t", str(tmp_path)), ("u", f"file://{tmp_path}/a/"), ("v", f"{tmp_path}/none")], "table_id string, prefix string")
    rows = sorted((r["table_id"], r["uri"]) for r in objects.listed(spark, frame).collect())
    assert rows == [("t", f"{tmp_path}/{n}") for n in ("0", "a/1", "a/b/2", "a/b/c/3", "a/b/c/d/4")] + [("u", f"file://{tmp_path}/a/{n}") for n in ("1", "b/2", "b/c/3", "b/c/d/4")]
    with pytest.raises(Exception, match="nowhere"):
        objects.listed(spark, spark.createDataFrame([("t", "nowhere://x/y")], "table_id string, prefix string")).collect()


def test_audits_release_what_they_read(session, tmp_path):
    spark = session(stores.Stores())
    spark.catalog.clearCache()
    root = str(tmp_path)
    t.table(root, "a", [t.entry("x.parquet")])
    c, kept = catalogs.LocalCatalog(root), []
    cached = lambda: spark._jsparkSession.sharedState().cacheManager().numCachedEntries()
    for _ in range(3):
        audit.release(kept)
        assert audit.audit(spark, c, "db.a", kept=kept).count() == 1
        assert cached() == 1
    audit.release(kept)
    assert cached() == 0
    audit.bench_start(spark, c, "db.a", folder=f"{root}/bench")
    with open(f"{root}/db/a/metadata/v10.metadata.json") as f:
        doc = json.load(f)
    t.save(f"{root}/db/a/metadata/m0.avro", t.ENTRY, [t.entry("x.parquet"), t.entry("y.parquet")])
    with open(f"{root}/db/a/metadata/v10.metadata.json", "w") as f:
        json.dump({**doc, "last-updated-ms": 1}, f)
    assert audit.bench_compare(spark, c, "db.a", folder=f"{root}/bench")
    assert cached() == 0
