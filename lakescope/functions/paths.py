"""Identifiers, URIs and sizes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def table_id_parts(text: Column) -> Column:
    """struct(namespace, name): split at the first dot, else the first slash, neither of them leading."""
    t = F.trim(text)
    dot, slash = F.instr(t, "."), F.instr(t, "/")
    at = F.when(dot > 1, dot).when((dot == 0) & (slash > 1), slash).when((dot == 1) & (slash > 1), slash).otherwise(0)
    return F.struct(
        F.when(at > 0, F.substring(t, F.lit(1), at - 1)).otherwise("").alias("namespace"),
        F.when(at > 0, F.substring(t, at + 1, F.length(t))).otherwise(t).alias("name"),
    )


def table_id(namespace: Column, name: Column) -> Column:
    return F.concat_ws(".", F.nullif(namespace, F.lit("")), name)


def parse_table_id(text: str) -> tuple[str, str]:
    """table_id_parts for one driver-side text; an empty one is an error."""
    t = text.strip()
    if not t:
        raise ValueError("a table id must not be empty")
    for mark in ".", "/":
        if (at := t.find(mark)) > 0:
            return t[:at], t[at + 1 :]
    return "", t


def scheme_of(uri: Column) -> Column:
    """The lower-cased text before ://, or an empty one."""
    return F.when(F.instr(uri, "://") > 1, F.lower(F.substring_index(uri, "://", 1))).otherwise("")


def split_uri(uri: Column) -> Column:
    """struct(scheme, host, path), without decoding the path; a bare path has scheme file."""
    scheme = scheme_of(uri)
    rest = F.regexp_replace(uri, "^[^:]*://", "")
    host = F.when(scheme != "", F.substring_index(rest, "/", 1)).otherwise("")
    path = F.when(scheme != "", F.regexp_replace(rest, "^[^/]*", "")).otherwise(uri)
    return F.struct(F.when(scheme == "", "file").otherwise(scheme).alias("scheme"), host.alias("host"), path.alias("path"))


def resolve(base: Column, ref: Column) -> Column:
    """A reference as the metadata file at base means it: itself if absolute, else beside base."""
    absolute = ref.contains("://") | ref.startswith("/")
    return F.when(ref == "", "").when(absolute, ref).otherwise(F.concat(F.regexp_replace(base, "/[^/]*$", ""), F.lit("/"), ref))


def normalized(uri: Column) -> Column:
    """One trailing slash and the file scheme removed, in either of its spellings."""
    return F.regexp_replace(F.regexp_replace(uri, "/$", ""), "^file:(//|(?=/))", "")


def protected(uri: Column) -> Column:
    """Whether a basename is of table metadata: *.metadata.json, snap-*.avro or version-hint.text*."""
    return F.substring_index(uri, "/", -1).rlike(r"(\.metadata\.json$|^snap-.*\.avro$|^version-hint\.text)")


def default_prefix(location: Column) -> Column:
    return F.concat(F.regexp_replace(location, "/+$", ""), F.lit("/data"))


def sanitized(name: Column) -> Column:
    """Bytes of a file name outside letters, digits, dot, dash and underscore become underscores."""
    return F.regexp_replace(F.decode(F.encode(name, "UTF-8"), "ISO-8859-1"), "[^A-Za-z0-9_.-]", "_")


def hundredths(amount: Column, unit: int) -> Column:
    """amount / unit as text with two decimals, halves to even, in whole-number arithmetic."""
    n = amount.cast("decimal(38,0)") * 100
    q, r = F.floor(n / unit).cast("decimal(38,0)"), n % unit
    up = (r * 2 > unit) | ((r * 2 == unit) & (q % 2 == 1))
    q = (q + F.when(up, 1).otherwise(0)).cast("long")
    return F.concat(F.floor(q / 100).cast("long").cast("string"), F.lit("."), F.lpad((q % 100).cast("string"), 2, "0"))


def human_bytes(size: Column) -> Column:
    """B, or KB, MB, GB and TB by powers of 1,024 with two decimals."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**power, F.concat(hundredths(size, 1024**power), F.lit(f" {unit}"))).otherwise(out)
    return out


def truncated(text: Column, n: int) -> Column:
    """Texts of over n bytes cut to n - 1, without trailing blanks, and an ellipsis."""
    cut = F.decode(F.substring(F.encode(text, "UTF-8"), 1, n - 1), "UTF-8")
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(F.regexp_replace(cut, " +$", ""), F.lit("…")))


def duration_text(ms: Column) -> Column:
    """Whole days, else hours, else minutes; 0s for nothing."""
    def whole(unit: int, mark: str) -> Column:
        return F.concat(F.floor(ms / unit).cast("long").cast("string"), F.lit(mark))

    return F.when(ms <= 0, "0s").when(ms >= 86_400_000, whole(86_400_000, "d")).when(ms >= 3_600_000, whole(3_600_000, "h")).otherwise(whole(60_000, "m"))


def delta_text(before: Column, after: Column) -> Column:
    d = after - before
    return F.when(d == 0, "(no change)").when(d > 0, F.concat(F.lit("(+"), d.cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("("), d.cast("string"), F.lit(")")))


def partition_key(partition: Column) -> Column:
    """k=v pairs by key, joined by slashes; a null value is <nil>; no partition is an empty key."""
    pair = F.transform(F.array_sort(F.map_keys(partition)), lambda k: F.concat(k, F.lit("="), F.coalesce(partition[k], F.lit("<nil>"))))
    return F.coalesce(F.array_join(pair, "/"), F.lit(""))
