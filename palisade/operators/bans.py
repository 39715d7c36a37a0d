"""Bookkeeping of bans: terms, extensions, restarts, deletions, lists for other systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# What a reason says to people.
REASON_TEXT = {"CriticalRisk": "Critical security risk", "RateLimit": "Rate limit exceeded", "ChallengeFailed": "Failed security challenge", "Manual": "Manual ban", "Coordinated": "Coordinated attack detected", "PromptInjection": "Prompt injection attempt"}


def expiry(created_epoch: Column, duration_secs: Column) -> Column:
    """When a ban ends; null, for ever, if its duration is 0 or missing."""
    return F.when(duration_secs > 0, created_epoch + duration_secs)


def reason_text(reason: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in REASON_TEXT.items() for x in kv]), reason), reason, F.lit("unknown"))


def numbered(bans: DataFrame, key: str, tie: str) -> DataFrame:
    """Adds nth: the number of the ban of its key since the count last restarted, as it does once a ban has run out before the next."""
    by = W.partitionBy(key).orderBy("created_epoch", tie)
    fresh = F.lag("created_epoch").over(by).isNull() | F.coalesce(F.lag("expires_epoch").over(by) < F.col("created_epoch"), F.lit(False))
    runs = bans.withColumn("_new", fresh.cast("int")).withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return runs.withColumn("nth", F.row_number().over(W.partitionBy(key, "_run").orderBy("created_epoch", tie)).cast("bigint")).drop("_new", "_run")


def folded(events: DataFrame, key: str, duration_secs: int) -> DataFrame:
    """events: key, reason, epoch, event_id. The entry of each key after all its bans, each for duration_secs: the last reason and expiry, the first time, how often."""
    last = F.max_by("reason", F.struct("epoch", "event_id"))
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("reason"), F.min("epoch").alias("created_epoch"), (F.max("epoch") + duration_secs).alias("expires_epoch"), F.count("*").alias("ban_count"))


def without(bans: DataFrame, keys: DataFrame, key: str = "ip") -> DataFrame:
    """bans less those of keys: unban, reset and unblock."""
    return bans.join(keys.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def export_sets(active: DataFrame) -> DataFrame:
    """family (v4 or v6) and ip of bans in force, as packet filters take them."""
    return active.where("ip IS NOT NULL").select(F.when(F.col("ip").contains(":"), "v6").otherwise("v4").alias("family"), "ip").distinct()
