"""Mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source; a water level over the sources gives each its target, at most CAP times its
size; a document is taken floor(rate) times, and once more with the probability of the rate's fraction,
decided by a hash of its id and a seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, text_of

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
#: Sources up to which their sums are broadcast (under 10 MB), and parts of a source beyond it.
FEW, SALT = 50_000, 64


def words(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size -> with target. Sources by code point, null last, weigh as the weights repeat.

    min(cap * size, level * weight), where level is the largest of (all - capped before) / (weights from here)
    over the sources in order of cap * size / weight: what resharing the excess until none is left ends in.
    The rows here are one per source, already aggregated: the level is one of all sources, so they meet in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * cap)
    by = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    s = s.withColumn("_level", (F.lit(share) * total - before) / rest)
    level = F.max("_level").over(everything)
    return s.withColumn("target", F.least(F.col("_cap").cast("double"), level * F.col("_w"))).drop("_w", "_cap", "_level")


def copies(docs: DataFrame, sizes: Column, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """The input's columns as a struct named row, with size, source_size, target and copies (how often the mix takes each).

    A null size is not allowed; a source without words has rate 0, a null source is a source, a null id counts as
    the text null. Repeated rows are taken alike, an empty table gives an empty result, and no column name clashes.
    The sources' sums are kept; up to FEW sources are broadcast, more are met by a join whose frequent keys are salted.
    """
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("string").alias("id"), F.col(source_col).alias("source"), sizes.alias("size"))
    t = stored(targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), **options))
    if t.count() <= FEW:
        met = d.join(F.broadcast(t), d["source"].eqNullSafe(t["source"])).drop("source")
    else:
        salted = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        d = d.withColumn("salt", F.pmod(F.xxhash64("id", "size"), F.lit(SALT)).cast("int"))
        met = d.join(salted, d["source"].eqNullSafe(salted["source"]) & (d["salt"] == salted["salt"])).drop("source", "salt")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.concat(F.coalesce(F.col("id"), F.lit("null")), F.lit(f":{seed}"))
    chance = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)
    return met.withColumn("rate", rate).select("row", "size", "source_size", "target", (F.floor("rate") + F.when(chance < F.col("rate") - F.floor("rate"), 1).otherwise(0)).alias("copies"))


def mix(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mixed corpus: each input row as often as it is taken, all columns kept; ids repeat with their rows.

    Null or empty text has size 0 and goes by its source's rate like any other row. Null sources are a source;
    columns pass through whatever their names are; an empty table gives an empty result.
    """
    out = copies(docs, words(text_col), **options).filter("copies > 0")
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("row.*")
