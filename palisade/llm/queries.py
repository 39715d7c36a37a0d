"""Queries over the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.copies import copy_sets
from palisade.llm.lookalike import look_classes, look_pairs, read_looks, record_forms
from palisade.llm.mixing import mixture, shares
from palisade.llm.packing import packed, unused
from palisade.llm.pii import personal_data, redacted
from palisade.llm.sentences import sentences
from palisade.llm.tokens import n_tokens
from palisade.session import spread, written
from palisade.sources.tables import table


def _samples_and_logs(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "logs").select(F.lit("logs").alias("record_table"), F.col("log_id").alias("id"), F.col("fields.body").alias("text")).where("text <> ''")
    return table(spark, d, "train").select(F.lit("train").alias("record_table"), F.col("sample_id").alias("id"), "text").unionByName(logs)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies of training samples and log bodies that differ only in how they are written."""
    _, members = copy_sets(_samples_and_logs(spark, d), "record_table", "id", "text")
    return members.where("copy_id <> keep_id").select(F.col("space").alias("record_table"), "keep_id", "copy_id")


def p1_contents(spark: SparkSession, d: str) -> DataFrame:
    """One record for each distinct content of a table, with the number of its copies."""
    contents, _ = copy_sets(_samples_and_logs(spark, d), "record_table", "id", "text")
    return contents.withColumnRenamed("space", "record_table")


def _bodies_and_samples(spark: SparkSession, d: str) -> DataFrame:
    bodies = table(spark, d, "requests").select(F.lit("requests").alias("record_table"), F.col("request_id").alias("id"), F.col("body").alias("text"))
    return bodies.unionByName(table(spark, d, "train").select(F.lit("train").alias("record_table"), F.col("sample_id").alias("id"), "text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of personal data in request bodies and training texts by its place."""
    found = personal_data(_bodies_and_samples(spark, d), "record_table", "id", "text")
    return found.withColumnsRenamed({"space": "record_table", "id": "record_id"})


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Request bodies and training texts with personal data replaced by typed placeholders."""
    clean = redacted(_bodies_and_samples(spark, d), "record_table", "id", "text")
    return clean.withColumnsRenamed({"space": "record_table", "id": "record_id"})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of request bodies and of training texts that differ but look the same."""
    return look_pairs(*read_looks(_bodies_and_samples(spark, d), "record_table", "id", "text")).withColumnRenamed("space", "record_table")


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Class and number of links of every request body and training text that looks like a differently written one."""
    return look_classes(*read_looks(_bodies_and_samples(spark, d), "record_table", "id", "text")).withColumnRenamed("space", "record_table")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every request body and training text."""
    return record_forms(*read_looks(_bodies_and_samples(spark, d), "record_table", "id", "text")).withColumnRenamed("space", "record_table")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source, size in tokens; written once, as several passes read it."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text", "source"))
    return written(docs.select("doc_id", "text", "source", n_tokens(F.col("text")).alias("size")), "tokens")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every piece of it, for each of the container sizes."""
    return packed(_sized(spark, d).select("doc_id", "size"), table(spark, d, "pack_sizes"))


def p6_unused(spark: SparkSession, d: str) -> DataFrame:
    """Containers and unused space for each of the container sizes."""
    return unused(p6_packed(spark, d))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used in the training mixture."""
    return mixture(_sized(spark, d), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Actual against target share of the tokens for each source."""
    return shares(p7_mixture(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every document by its place."""
    return sentences(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_contents, p3_found, p3_redacted, p4_found, p4_forms, p4_classes, p6_packed, p6_unused, p7_mixture, p7_shares, p8_found)}
#: JSON, tokenizers, scripts and numeric fitting are beyond SQL: these are tested against brute force instead.
ORACLE: dict[str, str] = {}
