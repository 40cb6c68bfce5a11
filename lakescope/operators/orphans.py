"""Objects that no snapshot refers to: a set difference between a listing and all references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import normalized, protected

GRACE_MS = 24 * 3_600_000


def active(*references: DataFrame) -> DataFrame:
    """(table_id, uri) frames of metadata, manifest lists, manifests and files of every status -> distinct references."""
    out = references[0].select("table_id", "uri")
    for r in references[1:]:
        out = out.unionByName(r.select("table_id", "uri"))
    return out.filter("uri <> ''").select("table_id", normalized(F.col("uri")).alias("uri_norm")).distinct()


def past_grace(objects: DataFrame, now_ms: int, grace_ms: int = GRACE_MS) -> DataFrame:
    """Objects old enough to judge: an unknown time (0) and exactly the cutoff are."""
    return objects.filter((F.col("updated_at_ms") == 0) | (F.col("updated_at_ms") <= now_ms - grace_ms))


def referenced(objects: DataFrame, live: DataFrame) -> DataFrame:
    return objects.withColumn("uri_norm", normalized(F.col("uri"))).join(live.hint("merge"), ["table_id", "uri_norm"], "left_semi")


def orphans(objects: DataFrame, live: DataFrame, now_ms: int, grace_ms: int = GRACE_MS) -> DataFrame:
    """objects(table_id, uri, size_bytes, updated_at_ms) without referenced ones, recent ones and metadata; with age_ms.

    Metadata names are never candidates. An object without a time is as old as the epoch. References are many and their
    size is guessed from the documents', so they are never broadcast.
    """
    old = past_grace(objects, now_ms, grace_ms).filter(~protected(F.col("uri"))).withColumn("uri_norm", normalized(F.col("uri")))
    age = (F.lit(now_ms) - F.col("updated_at_ms")).cast("long")
    return old.join(live.hint("merge"), ["table_id", "uri_norm"], "left_anti").select("table_id", "uri", "size_bytes", "updated_at_ms", age.alias("age_ms"))


def totals(objects: DataFrame, candidates: DataFrame, live: DataFrame) -> DataFrame:
    """Per table: objects seen (grace or not), distinct references, candidates and their bytes."""
    seen = objects.groupBy("table_id").agg(F.count(F.lit(1)).alias("scanned_objects"))
    refs = live.groupBy("table_id").agg(F.count(F.lit(1)).alias("active_files"))
    found = candidates.groupBy("table_id").agg(F.count(F.lit(1)).alias("candidates"), F.sum("size_bytes").cast("long").alias("total_bytes"))
    out = seen.join(refs, "table_id", "full").join(found, "table_id", "full")
    return out.fillna(0)


def preview(candidates: DataFrame, n: int) -> DataFrame:
    """Each table's n largest candidates, ties by name; all for n = 0."""
    if not n:
        return candidates
    order = Window.partitionBy("table_id").orderBy(F.desc("size_bytes"), "uri")
    return candidates.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")
