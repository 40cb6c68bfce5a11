"""Table metadata documents, and the frames that follow from them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import normalized, partition_key, resolve, scheme_of
from ..operators.cost import ADDED, REMOVED, summary_long
from ..operators.writepattern import summary_files
from . import avro
from .stores import Stores, dealt

#: Names of the format, with dashes. Types of schema fields are kept as raw JSON.
SCHEMA = """
`format-version` int, `table-uuid` string, location string, `last-updated-ms` bigint, `last-column-id` int, `current-schema-id` int, `schemas` array<struct<`schema-id`:int,type:string,fields:array<struct<id:int,name:string,required:boolean,type:string,doc:string>>>>,
`default-spec-id` int, `partition-specs` array<struct<`spec-id`:int,fields:array<struct<`source-id`:int,`field-id`:int,name:string,transform:string>>>>, `last-partition-id` int, properties map<string,string>, `current-snapshot-id` bigint,
snapshots array<struct<`snapshot-id`:bigint,`parent-snapshot-id`:bigint,`sequence-number`:bigint,`timestamp-ms`:bigint,`manifest-list`:string,manifests:array<string>,summary:map<string,string>,`schema-id`:int>>,
`snapshot-log` array<struct<`timestamp-ms`:bigint,`snapshot-id`:bigint>>, `metadata-log` array<struct<`timestamp-ms`:bigint,`metadata-file`:string>>, `sort-orders` array<struct<`order-id`:int,fields:array<struct<transform:string,`source-id`:int,direction:string,`null-order`:string>>>>, `default-sort-order-id` int,
refs map<string,struct<`snapshot-id`:bigint,type:string,`min-snapshots-to-keep`:int,`max-snapshot-age-ms`:bigint,`max-ref-age-ms`:bigint>>, statistics array<struct<`snapshot-id`:bigint,`statistics-path`:string,`file-size-in-bytes`:bigint>>
"""

#: Characters of documents in one batch.
CHUNK = 1 << 22


def _texts(entries: DataFrame, stores: Stores) -> DataFrame:
    """entries(..., metadata_location) with their documents as text, read by the tasks that hold the entries."""
    at = entries.columns.index("metadata_location")

    def run(batches):
        for batch in batches:
            texts, size, first = [], 0, 0
            for k, path in enumerate(batch.column(at).to_pylist()):
                with stores.open(path) as f:
                    texts.append(f.read().decode("utf-8-sig"))
                size += len(texts[-1])
                if size >= CHUNK or k + 1 == batch.num_rows:
                    yield pa.record_batch([*(c.slice(first, len(texts)) for c in batch.columns), pa.array(texts, pa.string())], names=[*batch.schema.names, "_text"])
                    texts, size, first = [], 0, k + 1

    return dealt(entries, "metadata_location").mapInArrow(run, T.StructType([*entries.schema.fields, T.StructField("_text", T.StringType())]))


def read(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """entries(table_id, namespace, metadata_location, properties) -> one row per table with its document.

    A document that does not parse fails the read; a version that is missing or not 1 to 3 is told by valid. Documents
    are read where their entries lie, and only schemes come to the driver; those of Spark's own file systems (s3a, and
    hdfs without WebHDFS) are read by their names, which the driver lists.
    """
    stores, own, scheme = Stores.of(spark), entries.withColumnRenamed("properties", "catalog_properties"), scheme_of(F.col("metadata_location"))
    found = {r[0] for r in entries.select(scheme).distinct().collect()} - {None}
    other = [x for x in found if x not in ("", "file") and not stores.serves(f"{x}://")]
    texts = _texts(own.filter(~scheme.isin(*other)) if other else own.filter("metadata_location IS NOT NULL"), stores)
    out = texts.withColumn("_d", F.from_json("_text", SCHEMA, {"mode": "FAILFAST"})).select(*own.columns, "_d.*")
    if other:
        named = own.filter(scheme.isin(*other)).withColumn("_at", normalized(F.col("metadata_location")))
        docs = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json([r[0] for r in named.select("metadata_location").distinct().collect()])
        out = out.unionByName(named.join(docs.withColumn("_at", normalized(F.col("_metadata.file_path"))), "_at").drop("_at"))
    for dashed in ("format-version", "current-snapshot-id"):
        out = out.withColumnRenamed(dashed, dashed.replace("-", "_"))
    return out.withColumns({
        "valid": F.coalesce(F.col("format_version").between(1, 3), F.lit(False)), "current_snapshot_id": F.coalesce("current_snapshot_id", F.lit(0)),
        "location": F.coalesce("location", F.lit("")), "properties": F.coalesce("properties", "catalog_properties", F.create_map().cast("map<string,string>")),
    })


def _described(s: DataFrame) -> DataFrame:
    """(table_id, metadata_location, pos, s) -> what a snapshot says."""
    summary = F.col("s.summary")
    return s.select(
        "table_id", "metadata_location", "pos", F.col("s.snapshot-id").alias("snapshot_id"), F.col("s.parent-snapshot-id").alias("parent_snapshot_id"),
        F.coalesce("s.timestamp-ms", F.lit(0)).alias("timestamp_ms"), F.coalesce("s.manifest-list", F.lit("")).alias("manifest_list"), F.col("s.manifests").alias("manifests"),
        summary_files(summary).alias("added_files"), summary_long(summary[ADDED]).alias("added_bytes"), summary_long(summary[REMOVED]).alias("removed_bytes"),
    )


def snapshots(tables: DataFrame) -> DataFrame:
    """A row per snapshot, with its place in the document and what its summary says."""
    return _described(tables.select("table_id", "metadata_location", F.posexplode("snapshots").alias("pos", "s")))


def lists(tables: DataFrame) -> DataFrame:
    """The manifest lists that any snapshot names, or manifests given in the document, each once a table; snapshot_id is 0."""
    s = tables.select("table_id", "metadata_location", F.explode("snapshots").alias("s"))
    once = s.select("table_id", "metadata_location", F.coalesce("s.manifest-list", F.lit("")).alias("manifest_list"), F.col("s.manifests").alias("manifests")).distinct()
    return once.withColumn("snapshot_id", F.lit(0).cast("long"))


def refs(tables: DataFrame) -> DataFrame:
    r = tables.select("table_id", F.explode("refs").alias("ref_name", "r"))
    return r.select("table_id", "ref_name", F.col("r.snapshot-id").alias("snapshot_id"), F.col("r.type").alias("type"))


def wanted_snapshot(branch: str | None) -> Column:
    """The id that a branch (or tag) names, else the current one; 0 for none."""
    return F.coalesce(F.col("refs")[branch]["snapshot-id"], F.lit(0)) if branch else F.col("current_snapshot_id")


def resolved(tables: DataFrame, branch: str | None = None) -> DataFrame:
    """The snapshot that an audit looks at: the first with the wanted id. Tables without one have no row.

    It is looked up in its document, without an exchange.
    """
    found = tables.select("table_id", "metadata_location", "snapshots", wanted_snapshot(branch).alias("_want")).filter("_want <> 0")
    found = found.withColumn("pos", (F.array_position(F.col("snapshots")["snapshot-id"], F.col("_want")) - 1).cast("int")).filter("pos >= 0")
    return _described(found.select("table_id", "metadata_location", "pos", F.get("snapshots", F.col("pos")).alias("s")))


def manifests(snaps: DataFrame, skip_bad: bool = False) -> DataFrame:
    """Manifests of snapshots: of their lists, or given in the document (version 1, content data)."""
    at = F.col("metadata_location")
    listed = snaps.filter("manifest_list <> ''").select("table_id", "snapshot_id", at.alias("base"), resolve(at, F.col("manifest_list")).alias("path"))
    read_ = avro.manifest_lists(listed, skip_bad)
    inline = snaps.filter("manifest_list = ''").select("table_id", "snapshot_id", at.alias("base"), F.posexplode("manifests").alias("manifest_pos", "manifest_path"))
    fill = {f.split()[0]: f.split()[1] for f in avro.MANIFESTS.split(", ")[1:]}
    inline = inline.withColumns({k: F.lit(0).cast(kind) for k, kind in fill.items()})
    return read_.unionByName(inline).withColumn("path", resolve(F.col("base"), F.col("manifest_path")))


def files(found: DataFrame, skip_bad: bool = False) -> DataFrame:
    """Entries of manifests(table_id, base, manifest_pos, path), with partition keys."""
    out = avro.manifest_files(found.select("table_id", "base", "manifest_pos", "path"), skip_bad)
    return out.withColumn("partition_key", partition_key(F.col("partition")))


def file_columns(found: DataFrame, wanted: tuple[str, ...], skip_bad: bool = False, keep: tuple[str, ...] = ("table_id",)) -> DataFrame:
    """Wanted columns of files, and those of their manifests to keep, for plans that need few: what is not asked for is neither decoded nor moved, and keys are made once a batch."""
    return avro.entry_columns(found.select(*keep, "path"), wanted, skip_bad)
