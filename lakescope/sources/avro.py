"""Avro object container files: a decoder, a small writer for fixtures, and manifests as DataFrames.

Spark's own Avro source is a separate artifact, so manifests are decoded in Arrow-batched tasks: a task reads
the files of its partition of a table of paths, one after another, and streams rows out. Fields that an audit
does not use are skipped without being built.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import islice
from operator import itemgetter
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .stores import Stores, dealt

MAGIC = b"Obj\x01"
#: What ends the blocks of written files.
SYNC = b"\x5a" * 16


class Reader:
    """Values of an Avro schema from bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def long(self) -> int:
        shift = out = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return (out >> 1) ^ -(out & 1)
            shift += 7

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the file ends within a value")
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, schema: Any, names: dict) -> Any:
        if isinstance(schema, list):
            return self.value(schema[self.long()], names)
        kind = schema["type"] if isinstance(schema, dict) else schema
        match kind:
            case "null":
                return None
            case "boolean":
                return self.take(1) == b"\x01"
            case "int" | "long":
                return self.long()
            case "float":
                return struct.unpack("<f", self.take(4))[0]
            case "double":
                return struct.unpack("<d", self.take(8))[0]
            case "bytes":
                return self.take(self.long())
            case "string":
                return self.take(self.long()).decode("utf-8", "replace")
            case "record" | "error":
                names[schema["name"]] = schema
                return {f["name"]: self.value(f["type"], names) for f in schema["fields"]}
            case "enum":
                names[schema["name"]] = schema
                return schema["symbols"][self.long()]
            case "fixed":
                names[schema["name"]] = schema
                return self.take(schema["size"])
            case "array":
                return [x for n in self.blocks() for x in (self.value(schema["items"], names) for _ in range(n))]
            case "map":
                return {self.value("string", names): self.value(schema["values"], names) for n in self.blocks() for _ in range(n)}
        if isinstance(kind, dict | list):
            return self.value(kind, names)
        if kind in names:
            return self.value(names[kind], names)
        raise ValueError(f"unknown type {kind!r}")

    def blocks(self) -> Iterator[int]:
        while n := self.long():
            if n < 0:
                self.long()
                n = -n
            yield n


def _inflate(codec: str, data: bytes) -> bytes:
    if codec == "null":
        return data
    if codec == "deflate":
        return zlib.decompress(data, -15)
    if codec == "snappy":
        out = pa.Codec("snappy")
        size = shift = at = 0
        while True:  # the length in front of a snappy block
            b = data[at]
            at += 1
            size |= (b & 0x7F) << shift
            if b < 0x80:
                break
            shift += 7
        return out.decompress(data[:-4], size, asbytes=True)
    if codec == "zstandard":
        return pa.input_stream(pa.BufferReader(data), compression="zstd").read()
    raise ValueError(f"codec {codec!r} is not known")


def _far(data: bytes, at: int, first: int) -> tuple[int, int]:
    """A whole number of several bytes after its first one, and where it ends."""
    out, shift = first & 0x7F, 7
    while (b := data[at]) > 0x7F:
        at += 1
        out |= (b & 0x7F) << shift
        shift += 7
    out |= b << shift
    return (out >> 1) ^ -(out & 1), at + 1


def _end(data: bytes, at: int, n: int) -> int:
    if n < 0 or at + n > len(data):
        raise ValueError("the file ends within a value")
    return at + n


class _Source:
    """Lines of a Python function that reads one schema's values; a schema that holds itself is an error."""

    def __init__(self):
        self.lines, self.names, self.open, self.count, self.given = [], {}, set(), 0, {"_far": _far, "_end": _end, "_f": struct.Struct("<f").unpack, "_d": struct.Struct("<d").unpack}

    def new(self) -> str:
        self.count += 1
        return f"v{self.count}"

    def add(self, depth: int, *lines: str) -> None:
        self.lines += ("    " * depth + line for line in lines)

    def long(self, to: str, depth: int) -> None:
        self.add(depth, "b = data[at]; at += 1", f"if b < 128: {to} = (b >> 1) ^ -(b & 1)", f"else: {to}, at = _far(data, at, b)")

    def taken(self, n: str, to: str, depth: int) -> None:
        self.add(depth, f"e = _end(data, at, {n}); {to} = data[at:e]; at = e")

    def blocks(self, depth: int) -> tuple[str, int]:
        """Loops over an array's or map's items; gives the depth of their body."""
        n = self.new()
        self.add(depth, "while True:")
        self.long(n, depth + 1)
        self.add(depth + 1, f"if not {n}: break", f"if {n} < 0:")
        self.long("size", depth + 2)
        self.add(depth + 2, f"{n} = -{n}")
        self.add(depth + 1, f"for _ in range({n}):")
        return n, depth + 2

    def skip(self, schema: Any, depth: int) -> None:
        """Passes over a value; what its reading would find wrong is still found."""
        if isinstance(schema, list):
            k = self.new()
            self.long(k, depth)
            for i, branch in enumerate(schema):
                self.add(depth, f"{'el' if i else ''}if {k} == {i} or {k} == {i - len(schema)}:")
                self.skip(branch, depth + 1)
            self.add(depth, "else: raise IndexError('no such branch')")
            return
        kind = schema["type"] if isinstance(schema, dict) else schema
        if not isinstance(kind, str):
            return self.skip(kind, depth)
        match kind:
            case "null":
                self.add(depth, "pass")
            case "int" | "long":
                self.add(depth, "while data[at] > 127: at += 1", "at += 1")
            case "bytes" | "string":
                self.long("n", depth)
                self.add(depth, "e = at + n", "if n < 0 or e > length: _end(data, at, n)", "at = e")
            case "record" | "error":
                with self.inside(schema):
                    self.add(depth, "pass")
                    for f in schema["fields"]:
                        self.skip(f["type"], depth)
            case "array":
                _, inner = self.blocks(depth)
                self.skip(schema["items"], inner)
            case "map":
                _, inner = self.blocks(depth)
                self.skip("string", inner)
                self.skip(schema["values"], inner)
            case _ if kind in self.names:
                self.skip(self.names[kind], depth)
            case _:
                self.value(schema, self.new(), depth)

    @contextmanager
    def inside(self, record: dict) -> Iterator[None]:
        self.names[record["name"]] = record
        if record["name"] in self.open:
            raise RecursionError
        self.open.add(record["name"])
        yield
        self.open.discard(record["name"])

    def value(self, schema: Any, to: str, depth: int) -> None:
        if isinstance(schema, list):
            k = self.new()
            self.long(k, depth)
            for i, branch in enumerate(schema):  # as an index, a negative one counts from the end
                self.add(depth, f"{'el' if i else ''}if {k} == {i} or {k} == {i - len(schema)}:")
                self.value(branch, to, depth + 1)
            self.add(depth, "else: raise IndexError('no such branch')")
            return
        kind = schema["type"] if isinstance(schema, dict) else schema
        if not isinstance(kind, str):
            return self.value(kind, to, depth)
        if kind in ("record", "error", "enum", "fixed"):
            self.names[schema["name"]] = schema
        match kind:
            case "null":
                self.add(depth, f"{to} = None")
            case "boolean":
                self.taken("1", to, depth)
                self.add(depth, f"{to} = {to} == b'\\x01'")
            case "int" | "long":
                self.long(to, depth)
            case "float" | "double":
                self.taken("4" if kind == "float" else "8", to, depth)
                self.add(depth, f"{to} = _{kind[0]}({to})[0]")
            case "bytes" | "string":
                self.long("n", depth)
                self.taken("n", to, depth)
                if kind == "string":
                    self.add(depth, f"{to} = {to}.decode('utf-8', 'replace')")
            case "fixed":
                self.taken(str(int(schema["size"])), to, depth)
            case "enum":
                self.given[f"_{to}"] = schema["symbols"]
                self.long("n", depth)
                self.add(depth, f"{to} = _{to}[n]")
            case "record" | "error":
                own = [(f["name"], self.new(), f["type"]) for f in schema["fields"]]
                with self.inside(schema):
                    for _, v, t in own:
                        self.value(t, v, depth)
                self.add(depth, f"{to} = {{{', '.join(f'{name!r}: {v}' for name, v, _ in own)}}}")
            case "array":
                self.add(depth, f"{to} = []")
                _, inner = self.blocks(depth)
                item = self.new()
                self.value(schema["items"], item, inner)
                self.add(inner, f"{to}.append({item})")
            case "map":
                self.add(depth, f"{to} = {{}}")
                _, inner = self.blocks(depth)
                key, item = self.new(), self.new()
                self.value("string", key, inner)
                self.value(schema["values"], item, inner)
                self.add(inner, f"{to}[{key}] = {item}")
            case _:
                if kind not in self.names:
                    raise KeyError(kind)
                self.value(self.names[kind], to, depth)


@lru_cache(64)
def _decoder(text: str) -> Callable[[bytes, int], Iterator[Any]]:
    """A function from a block and its number of records to them, made for one schema: its fields are read in straight code.

    Schemas that hold themselves, nest deeper than Python's blocks or name unknown types are read by Reader.
    """
    schema, source = json.loads(text), _Source()

    def plainly(data: bytes, n: int) -> Iterator[Any]:
        block, names = Reader(data), {}
        for _ in range(n):
            yield block.value(schema, names)

    try:
        source.add(0, "def decode(data, count):")
        source.add(1, "at = 0", "for _ in range(count):")
        source.value(schema, "out", 2)
        source.add(2, "yield out")
        exec("\n".join(source.lines), source.given)
    except (RecursionError, KeyError, SyntaxError, TypeError):
        return plainly
    return source.given["decode"]


def _blocks(stream: BinaryIO) -> Iterator[tuple[str, bytes, int]]:
    """A container file's schema, a block and its number of records, for each block."""
    r = Reader(stream.read())
    if r.take(4) != MAGIC:
        raise ValueError("not an Avro container file")
    meta = r.value({"type": "map", "values": "bytes"}, {})
    schema, codec, sync = meta["avro.schema"].decode(), meta.get("avro.codec", b"null").decode(), r.take(16)
    while r.at < len(r.data):
        n, size = r.long(), r.long()
        yield schema, _inflate(codec, r.take(size)), n
        if r.take(16) != sync:
            raise ValueError("a block does not end with the file's marker")


def records(stream: BinaryIO) -> Iterator[dict]:
    """The records of a container file, block by block."""
    for schema, block, n in _blocks(stream):
        yield from _decoder(schema)(block, n)


def _zigzag(n: int) -> bytes:
    n = (n << 1) ^ (n >> 63)
    if 1 << 28 <= n < 1 << 35:  # as sizes of files are
        return bytes((n & 0x7F | 0x80, n >> 7 & 0x7F | 0x80, n >> 14 & 0x7F | 0x80, n >> 21 & 0x7F | 0x80, n >> 28))
    out = bytearray()
    while n & ~0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


_SMALL = {n: _zigzag(n) for n in range(-64, 1024)}


def _long(n: int) -> bytes:
    return _SMALL.get(n) or _zigzag(n)


def _bytes(v: str | bytes) -> bytes:
    data = v.encode() if isinstance(v, str) else v
    return _long(len(data)) + data


def encoder(s: Any) -> Callable[[Any], bytes]:
    """A function from a schema's values to bytes; of a union, the first branch that is null as the value is."""
    if isinstance(s, list):
        null, other = (next(((_long(i), encoder(x)) for i, x in enumerate(s) if (x == "null") == is_null), None) for is_null in (True, False))

        def union(v: Any) -> bytes:
            lead, put = null if v is None else other
            return lead + put(v)

        return union
    kind = s["type"] if isinstance(s, dict) else s
    match kind:
        case "null":
            return lambda v: b""
        case "boolean":
            return lambda v: bytes([bool(v)])
        case "int" | "long":
            return _long
        case "float" | "double":
            return struct.Struct("<f" if kind == "float" else "<d").pack
        case "bytes" | "string":
            return _bytes
        case "record":
            fields = [(f["name"], encoder(f["type"])) for f in s["fields"]]
            return lambda v: b"".join([put(v[name]) for name, put in fields])
        case "array":
            item = encoder(s["items"])
            return lambda v: (_long(len(v)) + b"".join(map(item, v)) if v else b"") + b"\0"
        case "map":
            value = encoder(s["values"])
            return lambda v: (_long(len(v)) + b"".join(_bytes(a) + value(b) for a, b in v.items()) if v else b"") + b"\0"
    return encoder(kind)


def _put(s: Any, value: str, depth: int, lines: list[str], given: dict) -> None:
    """Adds the lines that append a value's bytes; types that are no records of plain values are left to encoder."""
    def add(*more: str) -> None:
        lines.extend("    " * depth + line for line in more)

    kind = s["type"] if isinstance(s, dict) else s
    if isinstance(s, list):
        null, other = (next(((_long(i), x) for i, x in enumerate(s) if (x == "null") == is_null), None) for is_null in (True, False))
        if not null or not other:
            raise KeyError("union")
        v = f"v{len(lines)}"
        add(f"{v} = {value}", f"if {v} is None: add({null[0]!r})", "else:", f"    add({other[0]!r})")
        return _put(other[1], v, depth + 1, lines, given)
    match kind:
        case "int" | "long":
            add(f"n = {value}", "add(small(n) or zigzag(n))")
        case "bytes" | "string":
            add(f"x = {value}", "if isinstance(x, str): x = x.encode()", "n = len(x)", "add(small(n) or zigzag(n))", "add(x)")
        case "record":
            v = f"v{len(lines)}"
            add(f"{v} = {value}")
            for f in s["fields"]:
                _put(f["type"], f"{v}[{f['name']!r}]", depth, lines, given)
        case _:
            given[f"put{len(lines)}"] = encoder(s)
            add(f"add(put{len(lines)}({value}))")


@lru_cache(64)
def _writer(text: str, codec: str) -> tuple[bytes, Callable[[list], bytes]]:
    """A file's head, and a function from records to a block's bytes made for one schema: fields are written in straight code."""
    schema, lines, given = json.loads(text), [], {"small": _SMALL.get, "zigzag": _zigzag}
    head = MAGIC + encoder({"type": "map", "values": "bytes"})({"avro.schema": text, "avro.codec": codec}) + SYNC
    try:
        _put(schema, "r", 2, lines, given)
        exec("\n".join(["def encode(rows):", "    out = []", "    add = out.append", "    for r in rows:", *lines, "        pass", "    return b''.join(out)"]), given)
    except (KeyError, SyntaxError, TypeError):
        put = encoder(schema)
        return head, lambda rows: b"".join(map(put, rows))
    return head, given["encode"]


def write(stream: BinaryIO, schema: dict, rows: list[dict], codec: str = "deflate") -> None:
    """Rows as a container file of one block; null or deflate."""
    head, encode = _writer(json.dumps(schema), codec)
    body = encode(rows)
    if codec == "deflate":
        z = zlib.compressobj(wbits=-15)
        body = z.compress(body) + z.flush()
    stream.write(head + _long(len(rows)) + _long(len(body)) + body + SYNC)


def _int(*values: Any) -> int:
    """The first value that is there as a whole number; anything else is 0."""
    for v in values:
        if type(v) is int:
            return v
        if isinstance(v, dict) and len(v) == 1:
            v = next(iter(v.values()))
        if isinstance(v, bool | int | float):
            return int(v)
        if v is not None:
            return 0
    return 0


def _text(*values: Any) -> str:
    for v in values:
        if type(v) is str:
            return v
        if isinstance(v, dict) and len(v) == 1:
            v = next(iter(v.values()))
        if isinstance(v, bytes):
            return v.decode("utf-8", "replace")
        if v is not None:
            return v if isinstance(v, str) else ""
    return ""


def plain(v: Any) -> str | None:
    """A partition value as text: whole numbers plain, floats in the shortest form with a two-digit exponent."""
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, bytes):
        return "[" + " ".join(map(str, v)) + "]"
    if isinstance(v, float):
        out = repr(v).removesuffix(".0")
        if v and not 1e-4 <= abs(v) < 1e21:
            out = f"{v:e}"
            digits, _, power = repr(v).partition("e") if "e" in repr(v) else (out.partition("e")[0].rstrip("0").rstrip("."), "", out.partition("e")[2])
            out = f"{digits.removesuffix('.0')}e{int(power):+03d}"
        return {"inf": "+Inf", "-inf": "-Inf", "nan": "NaN"}.get(out, out)
    return str(v)


def manifest_row(r: dict) -> tuple:
    """path, length, spec_id, content, sequence and snapshot numbers, then added, existing, deleted counts of files and rows."""
    return (
        _text(r.get("manifest_path")), _int(r.get("manifest_length")), _int(r.get("partition_spec_id")), _int(r.get("content")), _int(r.get("sequence_number")),
        _int(r.get("min_sequence_number")), _int(r.get("added_snapshot_id")),
        *(_int(r.get(f"{k}_data_files_count"), r.get(f"{k}_files_count")) for k in ("added", "existing", "deleted")),
        *(_int(r.get(f"{k}_rows_count")) for k in ("added", "existing", "deleted")),
    )


def file_row(r: dict) -> tuple | None:
    """status, snapshot, sequence, content, path, format, partition, rows and bytes of an entry; none without a data file."""
    d = r.get("data_file")
    if not isinstance(d, dict):
        return None
    partition = d.get("partition") if isinstance(d.get("partition"), dict) else {}
    return (
        _int(r.get("status")), _int(r.get("snapshot_id")), _int(r.get("sequence_number"), r.get("data_sequence_number")), _int(d.get("content")),
        _text(d.get("file_path"), d.get("path")), _text(d.get("file_format")), [(k, plain(v)) for k, v in partition.items()], _int(d.get("record_count")), _int(d.get("file_size_in_bytes")),
    )


#: Columns that can be read of entries without the rest, each with its type and its field; a partition's key is made of its values.
FIELDS = {
    "status": ("int", ("status",)), "content": ("int", ("data_file", "content")), "record_count": ("long", ("data_file", "record_count")),
    "file_size_bytes": ("long", ("data_file", "file_size_in_bytes")), "file_path": ("string", ("data_file", "file_path")), "partition_key": ("string", ("data_file", "partition")),
}
#: Entries in one batch of such columns.
BATCH = 1 << 15


def key(names: tuple[str, ...], values: tuple) -> str:
    """A partition's key as partition_key makes it of its map: k=v pairs by key, joined by slashes; a null value is <nil>."""
    return "/".join(f"{n}={'<nil>' if (text := plain(v)) is None else text}" for n, v in sorted(zip(names, values, strict=True), key=itemgetter(0)))


def _kinds(t: Any) -> set[str]:
    """The names of a type, or of a union's branches; of logical types that of what they are kept as."""
    if isinstance(t, list):
        return set().union(*map(_kinds, t))
    return {t} if isinstance(t, str) else _kinds(t["type"])


def _record(t: Any) -> dict:
    """A type that is a record, and nothing else."""
    if _kinds(t) != {"record"} or isinstance(t, list):
        raise KeyError("record")
    return t if t["type"] == "record" else _record(t["type"])


@lru_cache(64)
def _narrow(text: str, wanted: tuple[str, ...]) -> Callable | None:
    """A function made for one schema, that appends wanted columns of a block's next records and passes over the rest.

    It takes the block, where to begin, how many records, the keys' places met so far, the keys, and what appends to each
    column, and gives where it ended. None for schemas whose wanted fields have other types than the format's.
    """
    schema, source, found = json.loads(text), _Source(), {}
    places = {FIELDS[c][1]: c for c in wanted}

    def fields(record: dict, path: tuple[str, ...]) -> None:
        with source.inside(record):
            for f in record["fields"]:
                place = (*path, f["name"])
                if place == ("data_file",):
                    found["data_file"] = ""
                    fields(_record(f["type"]), place)
                elif (c := places.get(place)) is None:
                    source.skip(f["type"], 2)
                elif c == "partition_key":
                    own = {}
                    with source.inside(inner := _record(f["type"])):
                        for g in inner["fields"]:
                            own[g["name"]] = v = source.new()
                            source.value(g["type"], v, 2)
                            if not (_kinds(g["type"]) - {"null"} in ({"int"}, {"long"}, {"string"}, {"boolean"})):  # equal values of other types may differ as text
                                source.add(2, f"{v} = _plain({v})")
                    source.given |= {"_plain": plain, "_key": key, "_names": tuple(own)}
                    source.add(2, f"k = ({''.join(f'{v}, ' for v in own.values())})", "p = places.get(k)", "if p is None:", "    p = places[k] = len(keys)", "    keys.append(_key(_names, k))")
                    found[c] = "p"
                elif _kinds(f["type"]) <= ({"string"} if c == "file_path" else {"int", "long", "null"}):
                    v = source.new()
                    source.value(f["type"], v, 2)
                    found[c] = f"{v} or 0" if "null" in _kinds(f["type"]) else v
                else:
                    raise KeyError(c)

    try:
        source.add(0, f"def decode(data, at, count, places, keys, {', '.join(wanted)}):")
        source.add(1, "length = len(data)", "for _ in range(count):")
        fields(_record(schema), ())
        if "data_file" not in found or ("file_path" in wanted and "file_path" not in found):
            return None
        if "partition_key" in wanted and "partition_key" not in found:
            source.given["_key"] = key
            source.add(2, "p = places.get(())", "if p is None:", "    p = places[()] = len(keys)", "    keys.append('')")
            found["partition_key"] = "p"
        source.add(2, *(f"{c}({found.get(c, '0')})" for c in wanted))
        source.add(1, "return at")
        exec("\n".join(source.lines), source.given)
    except (RecursionError, KeyError, SyntaxError, TypeError):
        return None
    return source.given["decode"]


class _Columns:
    """Columns of entries as they are read, and the rows of paths they belong to."""

    def __init__(self, wanted: tuple[str, ...], schema: pa.Schema):
        self.wanted, self.schema = wanted, schema
        self.clear()

    def clear(self) -> None:
        self.owners, self.counts, self.length, self.keys, self.places = [], [], 0, [], {}
        self.columns = [[] if c == "file_path" else array("q" if FIELDS[c][0] == "long" else "i") for c in self.wanted]

    def take(self, owner: tuple, blocks: Iterator[tuple[str, bytes, int]]) -> Iterator[pa.RecordBatch]:
        """A file's entries; batches come out as they are full. Entries read before a file turns out to be bad stay."""
        for schema, block, n in blocks:
            decode, at = _narrow(schema, self.wanted), 0
            rest = None if decode else filter(None, map(file_row, _decoder(schema)(block, n)))
            while n > 0:
                step = min(n, BATCH - self.length)
                try:
                    if decode:
                        at = decode(block, at, step, self.places.setdefault(decode, {}), self.keys, *(c.append for c in self.columns))
                    else:
                        self.plainly(islice(rest, step))
                finally:
                    self.owners.append(owner)
                    self.counts.append(len(self.columns[-1]) - self.length)
                    self.length = len(self.columns[-1])
                n -= step
                if self.length >= BATCH:
                    yield self.batch()

    def plainly(self, rows: Iterator[tuple]) -> None:
        for status, _, _, content, path, _, partition, records, size in rows:
            got = {"status": status, "content": content, "record_count": records, "file_size_bytes": size, "file_path": path}
            if "partition_key" in self.wanted:
                got["partition_key"] = len(self.keys)
                self.keys.append(key(tuple(k for k, _ in partition), tuple(v for _, v in partition)))
            for c, column in zip(self.wanted, self.columns, strict=True):
                column.append(got[c])

    def batch(self) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(self.owners)), self.counts)
        out = [pa.array(c, f.type).take(pa.array(owner)) for c, f in zip(zip(*self.owners, strict=True), self.schema, strict=False)]
        for c, column in zip(self.wanted, self.columns, strict=True):
            if c == "file_path":
                out.append(pa.array(column, pa.string()))
            else:
                whole = pa.Array.from_buffers(pa.int64() if column.typecode == "q" else pa.int32(), len(column), [None, pa.py_buffer(column)])
                out.append(pa.array(self.keys, pa.string()).take(whole) if c == "partition_key" else whole)
        self.clear()
        return pa.record_batch(out, schema=self.schema)


KEYS = "table_id string, snapshot_id long, base string, manifest_pos int"
MANIFESTS = "manifest_path string, manifest_length long, partition_spec_id int, content int, sequence_number long, min_sequence_number long, added_snapshot_id long, added_files int, existing_files int, deleted_files int, added_rows long, existing_rows long, deleted_rows long"
FILES = "status int, entry_snapshot_id long, sequence_number long, content int, file_path string, file_format string, partition map<string,string>, record_count long, file_size_bytes long"


def _scanned(paths: DataFrame, keep: list[str], row, schema: str, pos: str, skip_bad: bool) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    kept = paths.select(*keep, "path")
    full = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + f", {pos} int, {schema}"
    arrow = _arrow(_parse_datatype_string(full))
    stores = Stores.of(paths.sparkSession)

    def run(batches):
        def rows():
            for batch in batches:
                for *key, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    try:
                        with stores.open(path) as f:
                            for k, r in enumerate(records(f)):
                                if (out := row(r)) is not None:
                                    yield (*key, k, *out)
                    except (OSError, ValueError, IndexError):
                        if not skip_bad:
                            raise

        held = []
        for r in rows():
            held.append(r)
            if len(held) >= 5000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                held = []
        columns = list(zip(*held, strict=True)) or [[] for _ in arrow]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return dealt(kept, "path").mapInArrow(run, full)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def manifest_lists(paths: DataFrame, skip_bad: bool = False) -> DataFrame:
    """paths(..., path) of manifest lists -> their manifests, with the other columns and manifest_pos."""
    return _scanned(paths, [c for c in paths.columns if c != "path"], manifest_row, MANIFESTS, "manifest_pos", skip_bad)


def manifest_files(paths: DataFrame, skip_bad: bool = False) -> DataFrame:
    """paths(..., path) of manifests -> their entries, with the other columns and entry_pos. Each path is read as often as it is given."""
    return _scanned(paths, [c for c in paths.columns if c != "path"], file_row, FILES, "entry_pos", skip_bad)


def entry_columns(paths: DataFrame, wanted: tuple[str, ...], skip_bad: bool = False) -> DataFrame:
    """paths(..., path) of manifests -> their entries, with the other columns and the wanted ones of FIELDS; the rest is passed over."""
    from pyspark.sql.types import _parse_datatype_string

    kept = paths.select(*(c for c in paths.columns if c != "path"), "path")
    full = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), *(f"{c} {FIELDS[c][0]}" for c in wanted)])
    arrow, stores = _arrow(_parse_datatype_string(full)), Stores.of(paths.sparkSession)

    def run(batches):
        held = _Columns(wanted, arrow)
        for batch in batches:
            for *owner, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    with stores.open(path) as f:
                        yield from held.take(tuple(owner), _blocks(f))
                except (OSError, ValueError, IndexError):
                    if not skip_bad:
                        raise
        if held.length:
            yield held.batch()

    return dealt(kept, "path").mapInArrow(run, full)
