"""Files beside the tables: log lines, ban lists, vocabularies, request streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.text import is_json

LOG = "timestamp string, level string, fields struct<message:string,level:string,ip:string,path:string,score:double,flags:string,reason:string,duration_secs:bigint,body:string,action:string>, target string, _bad string"
BAN = "ip string, reason string, created_epoch bigint, expires_epoch bigint, ban_count int"
REQUEST = "request_id bigint, ts timestamp, client_ip string, method string, path string, query_string string, headers map<string,string>, body string"


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log records of JSON lines; lines that are no JSON are left out, missing fields are null."""
    return spark.read.schema(LOG).option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL").drop("_bad")


# How an address is written. A group of colons stands for zeros once at most.
_V4 = "(?:(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)(?:\\.(?!$)|$)){4}"
_H = "[0-9a-fA-F]{1,4}"
_V6 = f"(?:(?:{_H}:){{7}}{_H}|(?=(?:[^:]*:){{2,7}}[^:]*$)(?!.*::.*::)(?:{_H}(?::{_H})*)?::(?:{_H}(?::{_H})*)?)"


def is_address(ip: Column) -> Column:
    """Whether a text is an IPv4 or IPv6 address; false for null."""
    return F.coalesce(ip.rlike(f"^{_V4}") | ip.rlike(f"^{_V6}$"), F.lit(False))


def ban_list(spark: SparkSession, path: str, now_epoch: int) -> DataFrame:
    """Bans of a JSON array that are in force: without expiry, or expiring after now. Entries that name no address are left out."""
    bans = spark.read.schema(BAN).option("multiLine", True).json(path)
    return bans.where((F.col("expires_epoch").isNull() | (F.col("expires_epoch") > now_epoch)) & is_address(F.col("ip")))


def adapted(raw: DataFrame) -> DataFrame:
    """Requests as they come over the wire: client_ip, method, headers (map), body (binary). Other columns stay.

    Header names go to lower case (of names that then agree the last stays); a missing method is GET, missing headers are
    none. Adds ip_error, body_kind (json, text if it is UTF-8, else binary; none), body_text (null for a binary body)
    and content_length.
    """
    pairs = F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e.key).alias("k"), e.value.alias("v")))
    lowered = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e.k), F.create_map(e.k, e.v)))
    text = F.try_validate_utf8(F.col("body").cast("string"))
    kind = F.when(F.col("body").isNull(), "none").when(text.isNull(), "binary").when(is_json(text), "json").otherwise("text")
    return raw.withColumns({"headers": lowered, "method": F.coalesce("method", F.lit("GET")), "ip_error": ~is_address(F.col("client_ip")), "body_kind": kind, "body_text": text, "content_length": F.coalesce(F.octet_length("body"), F.lit(0))})


def log_tail(spark: SparkSession, path: str) -> DataFrame:
    """A folder of log lines as a stream of lines coloured by level, as a terminal shows them."""
    x = spark.readStream.schema(LOG).option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL")
    code = F.when(F.col("level") == "ERROR", "31").when(F.col("level") == "WARN", "33").otherwise("32")
    return x.select("timestamp", "level", F.format_string("\x1b[%sm%s\x1b[0m %s", code, F.coalesce("level", F.lit("?")), F.coalesce("fields.message", F.lit(""))).alias("line"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Labelled samples (text, label, score) as JSON lines, positives in the folder's first part, negatives in its second."""
    parted = samples.select("text", "label", "score", (1 - F.col("label")).alias("part"))
    parted.write.mode("overwrite").partitionBy("part").json(path)


def write_bans(bans: DataFrame, path: str) -> None:
    bans.select("ip", "reason", "created_epoch", "expires_epoch", "ban_count").write.mode("overwrite").json(path)


def upserted(bans: DataFrame, new: DataFrame) -> DataFrame:
    """The ban table after an upsert: the latest ban of each address, and how many it has had."""
    both = bans.unionByName(new)
    last = F.max_by(F.struct("reason", "created_epoch", "expires_epoch"), "created_epoch").alias("b")
    return both.groupBy("ip").agg(last, F.sum(F.coalesce("ban_count", F.lit(1))).cast("int").alias("ban_count")).select("ip", "b.*", "ban_count")


def request_stream(spark: SparkSession, path: str) -> DataFrame:
    """Requests of a folder of JSON lines as a stream; header names in lower case."""
    return spark.readStream.schema(REQUEST).json(path).withColumn("headers", F.transform_keys("headers", lambda k, _: F.lower(k)))
