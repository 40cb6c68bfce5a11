"""The audit's frames as projections of a star schema's tables, so each operator has data of any size to run on.

lineitem rows stand for manifest entries, events for snapshots, orders for stored objects, customers for tables
with properties. Each function is a plain projection of one scan: filters and columns reach the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stores import dealt

#: The clock of all queries.
NOW_MS = 1_709_251_200_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(column: str) -> Column:
    """Epoch milliseconds of a time without zone, whatever the session's zone is."""
    since = f"({column} - TIMESTAMP_NTZ'1970-01-01 00:00:00')"
    return F.expr(f"extract(DAY FROM {since}) * 86400000L + extract(HOUR FROM {since}) * 3600000L + extract(MINUTE FROM {since}) * 60000L + cast(floor(extract(SECOND FROM {since}) * 1000) as bigint)")


def files(spark: SparkSession, sf_dir: str, key: str = "month") -> DataFrame:
    """Manifest entries. key: month, quantity or part, for little, some and much skew."""
    keys = {
        "month": F.concat(F.lit("ship_month="), F.date_format("l_shipdate", "yyyy-MM")),
        "quantity": F.concat(F.lit("q="), F.floor(F.sqrt("l_quantity")).cast("int").cast("string")),
        "part": F.concat(F.lit("p="), F.floor(F.log2(F.col("l_partkey") + 1)).cast("int").cast("string")),
    }
    content = F.when(F.col("l_linenumber") == 6, 1).when((F.col("l_linenumber") == 5) & (F.col("l_returnflag") == "R"), 2).otherwise(0)
    return _read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("sales."), F.lower("l_linestatus")).alias("table_id"), F.when(F.col("l_linenumber") % 7 == 0, 2).otherwise(1).alias("status"), content.alias("content"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") * 40).alias("file_size_bytes"), F.col("l_quantity").cast("long").alias("record_count"), keys[key].alias("partition_key"),
        (F.col("l_orderkey") % 1000).cast("int").alias("manifest_pos"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("entry_pos"),
        F.concat(F.when(F.col("l_returnflag") == "R", "hdfs://nn/w/f").otherwise("s3://b/w/f"), F.col("l_orderkey").cast("string")).alias("file_path"),
    )


def snapshots(spark: SparkSession, sf_dir: str, by: str = "user_id") -> DataFrame:
    """Commits; errors take bytes away, all other events add some."""
    gone = F.col("event_type") == "error"
    lead = "user." if by == "user_id" else "type."
    return _read(spark, sf_dir, "events").select(
        F.concat(F.lit(lead), F.col(by).cast("string")).alias("table_id"), F.col("event_id").alias("pos"), F.col("event_id").alias("snapshot_id"), _millis("ts").alias("timestamp_ms"),
        F.floor("value").cast("long").alias("added_files"), F.when(gone, 0).otherwise(F.floor(F.col("value") * 30)).cast("long").alias("added_bytes"),
        F.when(gone, F.floor(F.col("value") * 100)).otherwise(0).cast("long").alias("removed_bytes"),
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest for each order and line status."""
    return _read(spark, sf_dir, "lineitem").select(F.concat(F.lit("sales."), F.lower("l_linestatus")).alias("table_id"), F.col("l_orderkey").alias("manifest_path")).distinct()


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored objects, in two spellings of their URIs; some without a time, some by names of metadata."""
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 2 == 0, "file:///wh/o=").otherwise("/wh/o="), k.cast("string"), F.when(k % 40 == 3, ".metadata.json").when(k % 3 == 0, "/").otherwise(""))
    when = F.when(k % 5 == 0, 0).otherwise(_millis("o_orderdate"))
    return _read(spark, sf_dir, "orders").select(F.lit("wh.orders").alias("table_id"), name.alias("uri"), F.floor(F.col("o_totalprice") * 1000).cast("long").alias("size_bytes"), when.alias("updated_at_ms"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.lit("wh.orders").alias("table_id"), F.concat(F.lit("/wh/o="), F.col("l_orderkey").cast("string")).alias("uri"))


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with locations of four kinds, a version and some properties."""
    k = F.col("c_custkey")
    lead = F.element_at(F.array(F.lit("hdfs://nn/w/"), F.lit("s3://b/w/"), F.lit("/user/hive/w/"), F.lit("file:///w/")), (k % 4 + 1).cast("int"))
    properties = F.when(k % 6 == 0, F.create_map(F.lit("write.metadata.path"), F.lit("m"), F.lit("owner"), F.lit("o"))).when(k % 10 == 1, F.create_map(F.lit("write.distribution-mode"), F.lit("hash")))
    return _read(spark, sf_dir, "customer").select(
        F.concat(F.lower("c_mktsegment"), F.lit("."), k.cast("string")).alias("table_id"), F.lower("c_mktsegment").alias("namespace"), (k % 3 + 1).cast("int").alias("format_version"),
        F.concat(lead, k.cast("string")).alias("location"), F.when(k % 9 == 0, "").otherwise(F.concat(F.lit("s3://b/m/"), k.cast("string"))).alias("metadata_location"), properties.alias("properties"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of three kinds of text and of columns made from customers.

    Rows are dealt to all tasks before anything is made or looked for in them: a file of few row groups would give few tasks.
    """
    docs = dealt(_read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select(F.lit("t.documents").alias("table_id"), F.lit("text").alias("column"), F.col("text").alias("value"))
    pages = dealt(_read(spark, sf_dir, "pages").select("page_id", "html"), "page_id").select(F.lit("t.pages").alias("table_id"), F.lit("html").alias("column"), F.col("html").alias("value"))
    talk = dealt(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn").select(F.lit("t.talk").alias("table_id"), F.lit("text").alias("column"), F.col("text").alias("value"))
    k = F.col("c_custkey")

    def digits(n: int, salt: int):
        return F.lpad(F.pmod(k * salt + salt, F.lit(10**n)).cast("string"), n, "0")

    made = {
        "email": F.concat(F.lit("u"), k.cast("string"), F.when(k % 7 == 0, "(at)x.org").otherwise("@mail.example.org")),
        "ssn": F.concat(digits(3, 7), F.lit("-"), digits(2, 3), F.lit("-"), digits(4, 17)),
        "card": F.concat(F.lit("4"), digits(15, 982_451_653)),
        "phone": F.concat(F.lit("+1"), digits(10, 7_919)),
        "tfn": F.concat(digits(3, 11), F.lit(" "), digits(3, 13), F.lit(" "), digits(3, 19)),
        "aadhaar": F.concat(F.lit("2"), digits(3, 23), F.lit(" "), digits(4, 29), F.lit(" "), digits(4, 31)),
        "key": F.concat(F.lit("Zq7-"), F.md5(k.cast("string").cast("binary")), F.lit("XyW")),
    }
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in made.items())))
    customers = dealt(_read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.lit("t.customer").alias("table_id"), pairs.alias("x")).select("table_id", "x.*")
    return docs.unionByName(pages).unionByName(talk).unionByName(customers).filter("value is not null")


# The same frames in SQL, by name, for the twins of the queries.
SQL = {
    "files": """SELECT 'sales.' || lower(l_linestatus) AS table_id, CASE WHEN l_linenumber % 7 = 0 THEN 2 ELSE 1 END AS status,
        CASE WHEN l_linenumber = 6 THEN 1 WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN 2 ELSE 0 END AS content, CAST(round(l_extendedprice * 100) AS BIGINT) * 40 AS file_size_bytes,
        CAST(l_quantity AS BIGINT) AS record_count, 'ship_month=' || strftime(l_shipdate, '%Y-%m') AS month_key, 'q=' || CAST(CAST(floor(sqrt(l_quantity)) AS INTEGER) AS VARCHAR) AS quantity_key,
        'p=' || CAST(CAST(floor(log2(l_partkey + 1)) AS INTEGER) AS VARCHAR) AS part_key, CAST(l_orderkey % 1000 AS INTEGER) AS manifest_pos, l_orderkey * 8 + l_linenumber AS entry_pos,
        CASE WHEN l_returnflag = 'R' THEN 'hdfs://nn/w/f' ELSE 's3://b/w/f' END || l_orderkey AS file_path FROM lineitem""",
    "snapshots": """SELECT 'user.' || user_id AS table_id, 'type.' || event_type AS type_id, event_id AS pos, event_id AS snapshot_id, epoch_us(ts) // 1000 AS timestamp_ms, CAST(floor(value) AS BIGINT) AS added_files,
        CAST(CASE WHEN event_type = 'error' THEN 0 ELSE floor(value * 30) END AS BIGINT) AS added_bytes, CAST(CASE WHEN event_type = 'error' THEN floor(value * 100) ELSE 0 END AS BIGINT) AS removed_bytes FROM events""",
    "manifests": "SELECT DISTINCT 'sales.' || lower(l_linestatus) AS table_id, l_orderkey AS manifest_path FROM lineitem",
    "objects": """SELECT 'wh.orders' AS table_id, CASE WHEN o_orderkey % 2 = 0 THEN 'file:///wh/o=' ELSE '/wh/o=' END || o_orderkey || CASE WHEN o_orderkey % 40 = 3 THEN '.metadata.json' WHEN o_orderkey % 3 = 0 THEN '/' ELSE '' END AS uri,
        CAST(floor(o_totalprice * 1000) AS BIGINT) AS size_bytes, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE epoch_us(o_orderdate) // 1000 END AS updated_at_ms FROM orders""",
    "refs": "SELECT DISTINCT '/wh/o=' || l_orderkey AS uri_norm FROM lineitem",
    "tables": """SELECT lower(c_mktsegment) || '.' || c_custkey AS table_id, lower(c_mktsegment) AS namespace, CAST(c_custkey % 3 + 1 AS INTEGER) AS format_version,
        (['hdfs://nn/w/', 's3://b/w/', '/user/hive/w/', 'file:///w/'])[c_custkey % 4 + 1] || c_custkey AS location, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 's3://b/m/' || c_custkey END AS metadata_location,
        CASE WHEN c_custkey % 6 = 0 THEN ['write.metadata.path=m'] WHEN c_custkey % 10 = 1 THEN ['write.distribution-mode=hash'] ELSE [] END AS properties FROM customer""",
    "cells": """SELECT 't.documents' AS table_id, 'text' AS "column", text AS value FROM documents UNION ALL SELECT 't.pages', 'html', html FROM pages UNION ALL SELECT 't.talk', 'text', text FROM conversations
        UNION ALL SELECT 't.customer', 'email', 'u' || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN '(at)x.org' ELSE '@mail.example.org' END FROM customer
        UNION ALL SELECT 't.customer', 'ssn', lpad(CAST((c_custkey * 7 + 7) % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST((c_custkey * 3 + 3) % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST((c_custkey * 17 + 17) % 10000 AS VARCHAR), 4, '0') FROM customer
        UNION ALL SELECT 't.customer', 'card', '4' || lpad(CAST((c_custkey * 982451653 + 982451653) % 1000000000000000 AS VARCHAR), 15, '0') FROM customer
        UNION ALL SELECT 't.customer', 'phone', '+1' || lpad(CAST((c_custkey * 7919 + 7919) % 10000000000 AS VARCHAR), 10, '0') FROM customer
        UNION ALL SELECT 't.customer', 'tfn', lpad(CAST((c_custkey * 11 + 11) % 1000 AS VARCHAR), 3, '0') || ' ' || lpad(CAST((c_custkey * 13 + 13) % 1000 AS VARCHAR), 3, '0') || ' ' || lpad(CAST((c_custkey * 19 + 19) % 1000 AS VARCHAR), 3, '0') FROM customer
        UNION ALL SELECT 't.customer', 'aadhaar', '2' || lpad(CAST((c_custkey * 23 + 23) % 1000 AS VARCHAR), 3, '0') || ' ' || lpad(CAST((c_custkey * 29 + 29) % 10000 AS VARCHAR), 4, '0') || ' ' || lpad(CAST((c_custkey * 31 + 31) % 10000 AS VARCHAR), 4, '0') FROM customer
        UNION ALL SELECT 't.customer', 'key', 'Zq7-' || md5(CAST(c_custkey AS VARCHAR)) || 'XyW' FROM customer""",
}
