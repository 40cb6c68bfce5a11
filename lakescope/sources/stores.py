"""Stores of files: local folders, WebHDFS, S3, and what else Arrow's file systems know.

A Stores value holds settings only, so tasks carry it and make their own clients. It is read from the session:
spark.lakescope.webhdfs.url, spark.lakescope.webhdfs.user, spark.lakescope.s3.endpoint, spark.lakescope.s3.region.
"""

from __future__ import annotations

import io
import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession

#: Seconds that a request to a name node may take.
TIMEOUT = 60
SETTINGS = "spark.lakescope."

#: A stored file: URI, bytes, time of change in milliseconds.
File = tuple[str, int, int]


def scheme_of(uri: str) -> str:
    at = uri.find("://")
    return uri[:at].lower() if at > 0 else ""


def local_path(uri: str) -> str | None:
    """The path of a local URI or of a bare path; none for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if scheme_of(uri) else uri


def dealt(frame: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows that stand for files, over all the session's shuffle partitions: small as they are, they would else be joined into one task."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class _Ranges(io.RawIOBase):
    """A file of WebHDFS, read by ranges."""

    def __init__(self, stores: Stores, uri: str):
        self.stores, self.uri, self.at = stores, uri, 0
        with stores.asked(uri, "GETFILESTATUS") as answer:
            self.length = int(json.load(answer)["FileStatus"]["length"])

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.length}[whence]
        return self.at

    def readinto(self, buffer) -> int:
        size = min(len(buffer), self.length - self.at)
        if size <= 0:
            return 0
        with self.stores.asked(self.uri, "OPEN", offset=self.at, length=size) as answer:
            body = answer.read(size)
        buffer[: len(body)] = body
        self.at += len(body)
        return len(body)


@dataclass(frozen=True)
class Stores:
    webhdfs_url: str = ""
    webhdfs_user: str = ""
    s3_endpoint: str = ""
    s3_region: str = ""

    @classmethod
    def of(cls, spark: SparkSession) -> Stores:
        return cls(*(spark.conf.get(SETTINGS + f.name.replace("_", "."), "") for f in fields(cls)))

    def set(self, spark: SparkSession) -> None:
        """Write the settings that are not empty into the session."""
        for f in fields(self):
            if value := getattr(self, f.name):
                spark.conf.set(SETTINGS + f.name.replace("_", "."), value)

    def serves(self, uri: str) -> bool:
        """Whether the URI is read with these settings and not with Spark's own file systems."""
        return scheme_of(uri) == "s3" or self._by_http(uri)

    def _by_http(self, uri: str) -> bool:
        return bool(self.webhdfs_url) and scheme_of(uri) == "hdfs"

    def asked(self, uri: str, op: str, **query):
        """The answer of the name node (or the data node it names) for one operation; a missing file is FileNotFoundError."""
        path = uri.split("://", 1)[1]
        path = path[path.index("/"):] if "/" in path else "/"
        query = {"op": op, **({"user.name": self.webhdfs_user} if self.webhdfs_user else {}), **query}
        url = f"{self.webhdfs_url.rstrip('/')}{urllib.parse.quote(path)}?{urllib.parse.urlencode(query)}"
        try:
            return urllib.request.urlopen(url, timeout=TIMEOUT)
        except urllib.error.HTTPError as e:
            if e.code == 404:
                raise FileNotFoundError(uri) from e
            raise OSError(f"webhdfs {op} {uri}: status {e.code}") from e

    def arrow(self, uri: str):
        """Arrow's file system for a URI and the path in it; an unknown scheme is an error."""
        from pyarrow import fs

        if scheme_of(uri) == "s3" and (self.s3_endpoint or self.s3_region):
            scheme, _, host = self.s3_endpoint.rpartition("://")
            made = {"endpoint_override": host, "scheme": scheme or "https"} if host else {}
            return fs.S3FileSystem(**made, **({"region": self.s3_region} if self.s3_region else {})), uri.split("://", 1)[1]
        return fs.FileSystem.from_uri(uri)

    def open(self, uri: str) -> BinaryIO:
        """A file for one pass; those of other stores are read whole."""
        if (path := local_path(uri)) is not None:
            return open(path, "rb")
        if self._by_http(uri):
            with self.asked(uri, "OPEN") as answer:
                return io.BytesIO(answer.read())
        store, path = self.arrow(uri)
        with store.open_input_stream(path) as f:
            return io.BytesIO(f.read())

    def seekable(self, uri: str):
        """A file of which parts are read."""
        if (path := local_path(uri)) is not None:
            from pyarrow import fs

            return fs.LocalFileSystem().open_input_file(path)
        if self._by_http(uri):
            return io.BufferedReader(_Ranges(self, uri), 1 << 20)
        store, path = self.arrow(uri)
        return store.open_input_file(path)

    def level(self, folder: str) -> tuple[list[File], list[str]]:
        """What lies right in a folder: files, hidden ones included, and folders. URIs keep the folder's own beginning.

        A local or S3 folder that is not there is empty; one of WebHDFS is FileNotFoundError. Links are left out.
        """
        if (path := local_path(folder)) is not None:
            return self._local_level(path, "file://" if folder.startswith("file://") else "")
        if self._by_http(folder):
            with self.asked(folder, "LISTSTATUS") as answer:
                body = json.load(answer)
            if "RemoteException" in body:
                raise OSError(body["RemoteException"].get("message", ""))
            found = [(folder.rstrip("/") + ("/" + s["pathSuffix"] if s["pathSuffix"] else ""), s) for s in body["FileStatuses"]["FileStatus"]]
            files = [(uri, int(s.get("length") or 0), int(s.get("modificationTime") or 0)) for uri, s in found if s["type"] == "FILE"]
            return files, [uri for uri, s in found if s["type"] == "DIRECTORY"]
        from pyarrow import fs

        store, path = self.arrow(folder)
        lead = folder[: folder.index("://") + 3]
        found = store.get_file_info(fs.FileSelector(path.rstrip("/"), allow_not_found=True))
        files = [(lead + f.path, f.size or 0, f.mtime_ns // 1_000_000 if f.mtime_ns else 0) for f in found if f.is_file]
        return files, [lead + f.path for f in found if f.type == fs.FileType.Directory]

    @staticmethod
    def _local_level(path: str, lead: str) -> tuple[list[File], list[str]]:
        files, folders = [], []
        try:
            with os.scandir(path) as found:
                for f in found:
                    if f.is_dir(follow_symlinks=False):
                        folders.append(lead + f.path)
                    elif f.is_file(follow_symlinks=False):
                        at = f.stat(follow_symlinks=False)
                        files.append((lead + f.path, at.st_size, int(at.st_mtime * 1000)))
        except (FileNotFoundError, NotADirectoryError):
            pass
        return files, folders

    def walk(self, folder: str) -> Iterator[list[File]]:
        """The files below a folder at any depth, one folder's at a time."""
        left = [folder]
        while left:
            files, folders = self.level(left.pop())
            left += folders
            if files:
                yield files
