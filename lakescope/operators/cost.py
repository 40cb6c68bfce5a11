"""What snapshots cost over time: a running sum that never goes below zero, and what it costs to store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# List prices in dollars per GB and month, and the longest time without change before a snapshot is cold.
RATES = {"standard": 0.023, "infrequent-access": 0.0125, "glacier-instant": 0.004, "glacier-deep": 0.00099}
COLD_DAYS, GB, DAY_MS = 90, 1 << 30, 86_400_000
ADDED, REMOVED = "added-files-size", "removed-files-size"


class Rates:
    """Prices by storage class; an unknown class costs the standard price. A custom rate knows that class alone."""

    def __init__(self, name: str = "s3-standard", custom: float = 0.0):
        self.name = name if custom > 0 else "s3-standard"
        self.rates = {"standard": custom} if custom > 0 else dict(RATES)

    def rate(self, kind: str = "standard") -> float:
        return self.rates.get(kind, self.rates["standard"])

    def reclaimable(self, size: Column, kind: str = "standard") -> Column:
        """What bytes cost a month."""
        return size / F.lit(GB) * F.lit(self.rate(kind))


def summary_long(value: Column) -> Column:
    """A text of digits as a number; anything else is 0."""
    return F.coalesce(F.when(value.rlike(r"^[0-9]+\z"), value.try_cast("bigint")), F.lit(0))


def timeline(snapshots: DataFrame, now_ms: int, rates: Rates | None = None, cold_days: int = COLD_DAYS) -> DataFrame:
    """snapshots(table_id, pos, snapshot_id, timestamp_ms, added_bytes, removed_bytes) -> each snapshot's bytes and cost.

    max(0, c + added - removed) at each step equals the plain running sum less its running minimum, if that is
    below zero: two windows over one partitioning, so one exchange.
    """
    rates = rates or Rates()
    order = Window.partitionBy("table_id").orderBy("timestamp_ms", "pos").rowsBetween(Window.unboundedPreceding, 0)
    plain = snapshots.withColumn("_sum", F.sum(F.col("added_bytes") - F.col("removed_bytes")).over(order))
    held = plain.withColumn("cumulative_bytes", (F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(order))).cast("long"))
    age_days = F.floor((F.lit(now_ms) - F.col("timestamp_ms")) / DAY_MS)
    return held.select(
        "table_id", "snapshot_id", "timestamp_ms", "added_bytes", "removed_bytes", "cumulative_bytes",
        (F.col("cumulative_bytes") / F.lit(GB)).alias("cumulative_gb"),
        rates.reclaimable(F.col("cumulative_bytes")).alias("monthly_usd"),
        (F.lit(cold_days > 0) & (age_days >= cold_days)).alias("tier_candidate"),
    )
