"""Streaming twins of the rate windows: requests of every second, floods of an address, escalations as they come.

Rows later than the watermark's delay are dropped by the engine; ``split_late`` keeps them apart beforehand where they are wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def global_rates(requests: DataFrame, lateness: str = "10 minutes", baseline: int = 100) -> DataFrame:
    """Requests of every second of a stream with a column ts, once the watermark has passed it; an attack from more than five times the baseline."""
    n = requests.withWatermark("ts", lateness).groupBy(F.window("ts", "1 second")).agg(F.count("*").alias("n"))
    return n.select(F.col("window.start").alias("second"), "n", (F.col("n") > 5 * baseline).alias("under_attack"))


def address_rates(requests: DataFrame, length: str = "10 seconds", slide: str = "1 second", most: int = 30, lateness: str = "10 minutes") -> DataFrame:
    """Windows of a sliding length in which an address of a stream sent more than most requests."""
    n = requests.withWatermark("ts", lateness).groupBy("client_ip", F.window("ts", length, slide)).agg(F.count("*").alias("n"))
    return n.where(F.col("n") > most).select("client_ip", F.col("window.start").alias("start"), "n")


def split_late(requests: DataFrame, arrival: str, lateness_secs: int) -> tuple[DataFrame, DataFrame]:
    """(in time, late): rows by the time between ts and their arrival; a late one would pass no watermark of that delay for sure."""
    late = F.unix_micros(arrival) - F.unix_micros("ts") > lateness_secs * 1_000_000
    return requests.where(~F.coalesce(late, F.lit(False))), requests.where(F.coalesce(late, F.lit(False)))


def emit_escalations(scored: DataFrame, path: str, checkpoint: str, least: float = 0.6) -> StreamingQuery:
    """Appends rows of a stream whose score is least or more to a folder of JSON lines, each exactly once over restarts with the same checkpoint."""
    level = F.when(F.col("score") >= 0.8, "CRITICAL").otherwise("HIGH")
    rows = scored.where(F.col("score") >= least).withColumn("level", level)
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
