"""Catalogs: which tables there are and where their metadata is. Work is on the driver, over names only; local folders are listed by tasks."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from abc import ABC, abstractmethod
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import parse_table_id
from .stores import dealt

ENTRY = "table_id string, namespace string, name string, metadata_location string, properties map<string,string>"
#: Columns of a local listing: those of entries, and what kept a table from being one.
LISTED = ["table_id", "namespace", "name", "metadata_location", "error", "message"]
# The keys under which catalogs keep a table's metadata location.
LOCATION_KEYS = ("metadata_location", "metadata-location", "MetadataLocation")


class NotFound(LookupError):
    """There is no such table, or it has no metadata."""


@dataclass(frozen=True)
class Entry:
    namespace: str
    name: str
    metadata_location: str
    properties: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def table_id(self) -> str:
        return f"{self.namespace}.{self.name}" if self.namespace else self.name


def location_of(properties: dict[str, str]) -> str:
    return next((properties[k] for k in LOCATION_KEYS if properties.get(k)), "")


def is_iceberg(properties: dict[str, str]) -> bool:
    kind = properties.get("table_type") or ""
    return kind.upper() == "ICEBERG" if kind else bool(location_of(properties))


class Catalog(ABC):
    name = "catalog"

    @abstractmethod
    def load(self, namespace: str, table: str) -> Entry: ...

    @abstractmethod
    def tables(self, namespace: str) -> list[tuple[str, str]]: ...

    def entries(self, spark: SparkSession, table: str = "", namespace: str = "") -> DataFrame:
        """One table, or a namespace's; the table wins."""
        names = [parse_table_id(table)] if table else self.tables(namespace)
        found = [self.load(*n) for n in names]
        return spark.createDataFrame([(e.table_id, e.namespace, e.name, e.metadata_location, e.properties) for e in found], ENTRY)


def version(file_name: str) -> tuple[int, str]:
    """Orders metadata files: by the number in front (v12. or 00012-), then by name."""
    m = re.match(r"v?(\d+)", file_name)
    return (int(m[1]) if m else -1), file_name


class LocalCatalog(Catalog):
    """<root>/<namespace...>/<table>/metadata/*.metadata.json. compat takes the name that sorts last, as text."""

    name = "localfs"

    def __init__(self, root: str, compat: bool = False):
        self.root, self.compat = root.removeprefix("file://").rstrip("/") or "/", compat

    def load(self, namespace: str, table: str) -> Entry:
        for parts in (namespace.replace(".", "/"), namespace):
            folder = "/".join(p for p in (self.root, parts, table, "metadata") if p)
            if os.path.isdir(folder):
                names = [n for n in os.listdir(folder) if n.endswith(".metadata.json")]
                if names:
                    return Entry(namespace, table, f"{folder}/{max(names, key=None if self.compat else version)}")
        raise NotFound(f"{namespace}.{table}: no metadata below {self.root}")

    def tables(self, namespace: str) -> list[tuple[str, str]]:
        out = []
        top = "/".join(p for p in (self.root, namespace.replace(".", "/")) if p)
        for folder, below, _ in os.walk(top):
            if "metadata" in below:
                parts = os.path.relpath(folder, self.root).split("/")
                below.clear()
                if parts != ["."]:
                    out.append((".".join(parts[:-1]), parts[-1]))
            below.sort()
        return sorted(out)

    def entries(self, spark: SparkSession, table: str = "", namespace: str = "") -> DataFrame:
        """One table, or a namespace's. Two levels of folders are dealt out, and tasks look for tables below; the driver gets entries only."""
        if table:
            return super().entries(spark, table)
        top = "/".join(p for p in (self.root, namespace.replace(".", "/")) if p)

        def level(batches):
            for batch in batches:
                for folder in batch.column(0).to_pylist():
                    is_table, below = self._level(folder)
                    yield pa.record_batch([pa.array([folder] if is_table else below, pa.string())], names=["folder"])

        def below(batches):
            for batch in batches:
                rows, left = [], batch.column(0).to_pylist()
                while left:
                    folder = left.pop()
                    is_table, inner = self._level(folder)
                    left += inner
                    if is_table and (parts := os.path.relpath(folder, self.root).split("/")) != ["."]:
                        space, name = ".".join(parts[:-1]), parts[-1]
                        try:
                            e = self.load(space, name)
                            rows.append((e.table_id, space, name, e.metadata_location, None, None))
                        except (NotFound, OSError) as e:
                            rows.append((name, space, name, None, type(e).__name__, str(e)))
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * 6, names=LISTED)

        folders = spark.createDataFrame([(top,)], "folder string")
        for _ in range(2):
            folders = dealt(folders, "folder").mapInArrow(level, "folder string")
        found = dealt(folders, "folder").mapInArrow(below, ", ".join(f"{c} string" for c in LISTED)).toArrow().sort_by([("namespace", "ascending"), ("name", "ascending")])
        if bad := found.filter(pc.is_valid(found["error"])).slice(0, 1).to_pylist():
            raise (NotFound if bad[0]["error"] == "NotFound" else OSError)(bad[0]["message"])
        kept = spark.createDataFrame(found.select(LISTED[:4]), ", ".join(f"{c} string" for c in LISTED[:4]))
        return kept.withColumn("properties", F.create_map().cast("map<string,string>"))

    @staticmethod
    def _level(folder: str) -> tuple[bool, list[str]]:
        """Whether a folder is a table's; if not, the folders in it. As in a walk, links are not followed and what cannot be read is empty."""
        try:
            with os.scandir(folder) as found:
                below = [f for f in found if f.is_dir()]
        except OSError:
            return False, []
        is_table = any(f.name == "metadata" for f in below)
        return is_table, [] if is_table else [f.path for f in below if not f.is_symlink()]


class GlueCatalog(Catalog):
    """AWS Glue, by a client with get_table and get_paginator; boto3's is made if none is given."""

    name = "glue"

    def __init__(self, client=None, catalog_id: str = ""):
        if client is None:
            import boto3

            client = boto3.client("glue")
        self.client, self.extra = client, {"CatalogId": catalog_id} if catalog_id else {}

    def load(self, namespace: str, table: str) -> Entry:
        try:
            got = self.client.get_table(DatabaseName=namespace, Name=table, **self.extra)["Table"]
        except Exception as e:
            if type(e).__name__ == "EntityNotFoundException" or getattr(e, "response", {}).get("Error", {}).get("Code") == "EntityNotFoundException":
                raise NotFound(f"{namespace}.{table}") from e
            raise
        properties = got.get("Parameters") or {}
        if not location_of(properties):
            raise NotFound(f"{namespace}.{table}: no metadata_location")
        return Entry(namespace, table, location_of(properties), properties)

    def tables(self, namespace: str) -> list[tuple[str, str]]:
        if not namespace:
            raise ValueError("a namespace is required")
        pages = self.client.get_paginator("get_tables").paginate(DatabaseName=namespace, **self.extra)
        return [(namespace, t["Name"]) for page in pages for t in page["TableList"] if is_iceberg(t.get("Parameters") or {})]


class HiveCatalog(Catalog):
    """The metastore that Spark's session is connected to, Kerberos included (spark.kerberos.principal and keytab)."""

    name = "hive"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def load(self, namespace: str, table: str) -> Entry:
        name = ".".join(f"`{p}`" for p in (namespace or "default", table))
        if not self.spark.catalog.tableExists(f"{namespace or 'default'}.{table}"):
            raise NotFound(f"{namespace}.{table}")
        properties = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        if not location_of(properties):
            raise NotFound(f"{namespace}.{table}: no metadata_location")
        return Entry(namespace, table, location_of(properties), properties)

    def tables(self, namespace: str) -> list[tuple[str, str]]:
        return [(namespace, t.name) for t in self.spark.catalog.listTables(namespace or "default") if not t.isTemporary]


class RestCatalog(Catalog):
    """An Iceberg REST catalog; all pages of a listing are read. Auth: bearer token, a raw header, or client credentials."""

    name = "rest"

    def __init__(self, url: str, prefix: str = "", token: str = "", header: str = "", oauth: tuple[str, str, str] | None = None, send=None, clock=time.time):
        self.base = url.rstrip("/") + "/v1/" + (prefix.strip("/") + "/" if prefix else "")
        self.token, self.header, self.oauth, self.clock = token, header, oauth, clock
        self.send = send or self._send
        self.until = 0.0

    @staticmethod
    def _send(request: urllib.request.Request) -> dict:
        with urllib.request.urlopen(request, timeout=30) as r:
            return json.load(r)

    def authorization(self) -> str:
        if self.oauth and self.clock() >= self.until:
            url, client, secret = self.oauth
            body = urllib.parse.urlencode({"grant_type": "client_credentials", "client_id": client, "client_secret": secret, "scope": "catalog"})
            got = self.send(urllib.request.Request(url, body.encode(), {"Content-Type": "application/x-www-form-urlencoded"}))
            self.token, self.until = got["access_token"], self.clock() + (got.get("expires_in") or 3600) - 30
        return self.header or (f"Bearer {self.token}" if self.token else "")

    def get(self, path: str) -> dict:
        auth = self.authorization()
        try:
            return self.send(urllib.request.Request(self.base + path, headers={"Authorization": auth} if auth else {}))
        except urllib.error.HTTPError as e:
            if e.code == 404:
                raise NotFound(path) from e
            raise

    def load(self, namespace: str, table: str) -> Entry:
        got = self.get(f"namespaces/{self._space(namespace)}/tables/{urllib.parse.quote(table, safe='')}")
        return Entry(namespace, table, got["metadata-location"], (got.get("metadata") or {}).get("properties") or {})

    @staticmethod
    def _space(namespace: str) -> str:
        return urllib.parse.quote(namespace.replace(".", "\x1f"), safe="")

    def tables(self, namespace: str) -> list[tuple[str, str]]:
        out, page = [], ""
        while True:
            got = self.get(f"namespaces/{self._space(namespace)}/tables" + (f"?pageToken={urllib.parse.quote(page)}" if page else ""))
            out += [(".".join(t["namespace"]), t["name"]) for t in got.get("identifiers", [])]
            page = got.get("next-page-token") or ""
            if not page:
                return out


def catalog(kind: str, spark: SparkSession | None = None, **options) -> Catalog:
    """By kind: localfs or local (root), glue (client, catalog_id), hive, rest, polaris or unity (url, ...)."""
    kind = kind.lower()
    if kind in ("localfs", "local", ""):
        return LocalCatalog(options.get("root") or os.environ.get("LAKESCOPE_CATALOG_ROOT") or ".", options.get("compat", False))
    if kind == "glue":
        return GlueCatalog(options.get("client"), options.get("catalog_id", ""))
    if kind == "hive":
        return HiveCatalog(spark)
    if kind in ("rest", "polaris", "unity"):
        known = {k: options[k] for k in ("url", "prefix", "token", "header", "oauth", "send") if options.get(k)}
        return RestCatalog(**({"token": os.environ.get("LAKESCOPE_REST_TOKEN", "")} | known))
    raise ValueError(f"unknown catalog {kind!r}")
