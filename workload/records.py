"""Instruction records derived from the driver's tables; ``workload.oracle`` says the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskmill.functions.hashing import hash_key

LANGS = ("en", "fr", "de", "es")
NBSP = "\u00a0"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records; the label of a judged document is its output."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    labels = table(spark, sf, "labels")
    judged = docs.join(labels, "doc_id", "left")
    output = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad")
    task = F.when(F.col("toxic") == 1, "News Summarization").when(F.col("toxic") == 0, "Quality Detection")
    return judged.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("doc_id").alias("original_id"),
        F.col("text").alias("input"),
        output.alias("output"),
        F.col("source").alias("dataset"),
        task.alias("task"),
        "lang",
        F.concat(F.lit("Judge this text from "), "source").alias("instruction"),
    )


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as answered records: mostly right, some wrong, some no label at all, some null."""
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.lit("en").alias("lang"),
        F.col("o_orderstatus").alias("dataset"),
        F.col("o_orderpriority").alias("output"),
    )
    draw = F.pmod(hash_key(7, "id"), F.lit(10))
    answer = (
        F.when(draw < 6, F.concat(F.lit(f" {NBSP}"), F.lower("output"), F.lit("\n")))
        .when(draw < 8, "3-MEDIUM")
        .when(draw < 9, "junk")
    )
    return rows.withColumn("response", answer)


def orders_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    from taskmill.operators.records import clean_answers

    return clean_answers(orders(spark, sf))


def flags(spark: SparkSession, sf: str) -> DataFrame:
    """One multi-label record per order: its return flags, and a guess from the quantities."""
    letters = ("A", "N", "R")
    flag, guessed = F.col("l_returnflag"), (F.col("l_linenumber") != 7) & (F.col("l_quantity") > 25)

    def found(prefix: str, separator: str, *more: Column) -> Column:
        return F.concat_ws(separator, *[F.when(F.col(f"{prefix}{x}"), x) for x in letters], *more)

    return (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.max(F.ascii("l_linestatus")).alias("status"),
            *[F.max(flag == x).alias(f"true{x}") for x in letters],
            *[F.max((flag == x) & guessed).alias(f"guess{x}") for x in letters],
            F.max(F.col("l_linenumber") == 7).alias("junk"),
        )
        .select(
            F.col("l_orderkey").cast("string").alias("id"),
            F.lit("en").alias("lang"),
            F.concat(F.lit("Hostility-"), F.char("status")).alias("dataset"),
            found("true", ",").alias("output"),
            found("guess", " , ", F.when(F.col("junk"), "junk")).alias("response"),
        )
    )


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Summary records: the text of each document against the text of the next one."""
    # Texts on both sides: never a broadcast, however small the test tables are.
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").hint("merge")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("response"))
    return docs.join(following, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"),
        "lang",
        F.concat(F.lit("xlsum-"), "lang").alias("dataset"),
        F.col("text").alias("output"),
        "response",
    )


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """Summary records: each turn of a conversation against the turn after it."""
    turns = table(spark, sf, "conversations").hint("merge")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return turns.join(following, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.lit("en").alias("lang"),
        F.concat(F.lit("xlsum-"), "role").alias("dataset"),
        F.col("text").alias("output"),
        "response",
    )
