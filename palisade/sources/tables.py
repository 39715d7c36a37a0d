"""Table scans of one data folder, and the rule that a row delivered again counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, key: str) -> DataFrame:
    """One row for each value of key. Rows delivered again are equal in every column but the arrival, so any one may stay.

    The number of partitions is given, so that the few megabytes of a small table aren't put into one task for the detectors that follow.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key).dropDuplicates([key])
