"""Corpus files: one folder per language, one per dataset, one JSON file per split."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskmill.operators.records import with_position
from taskmill.schema import INSTRUCTION, TRAINING
from taskmill.sources.arrays import PLACE, strict_array

LAYOUTS = ("array", "lines")


def decoded(part: Column) -> Column:
    """A path part as the name it stands for; paths are URL-encoded, with ``+`` left alone."""
    return F.url_decode(F.replace(part, F.lit("+"), F.lit("%2B")))


def _is_array(layout: str) -> bool:
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}, expected one of {LAYOUTS}")
    return layout == "array"


def _strict_lines(spark: SparkSession, schema: T.StructType) -> DataFrameReader:
    return spark.read.schema(schema).option("mode", "FAILFAST")


def read_corpus(
    spark: SparkSession,
    base: str,
    split: str = "train",
    langs: Sequence[str] = ("ar", "en", "hi"),
    layout: str = "array",
    schema: T.StructType = TRAINING,
) -> DataFrame:
    """All datasets of a split, tagged with ``folder_lang`` and ``folder``.

    Language and split select the files, which are JSON arrays or, with ``layout='lines'``, JSON Lines;
    both are read in parallel however large a file is. A record that does not parse fails the job.
    """
    paths = [f"{base}/{lang}/*/{split}.json" for lang in langs]
    if _is_array(layout):
        rows, path = strict_array(spark, paths, schema), F.col("file")
    else:
        rows, path = _strict_lines(spark, schema).json(paths), F.col("_metadata.file_path")
    # The split may be one file, or a folder of files as Spark writes it.
    place = rf"([^/]+)/([^/]+)/{re.escape(split)}\.json(/[^/]*)?$"
    return rows.select(
        *schema.names, decoded(F.regexp_extract(path, place, 1)).alias("folder_lang"),
        decoded(F.regexp_extract(path, place, 2)).alias("folder"),
    )


def read_records(
    spark: SparkSession, path: str, layout: str = "array", schema: T.StructType = INSTRUCTION
) -> DataFrame:
    """Records to score, with their ``position``: file, block and place. One that does not parse fails the job.

    Of several files the first by name comes first, whatever their sizes and however they are split.
    """
    if _is_array(layout):
        rows = strict_array(spark, path, schema)
        return rows.select(*schema.names, F.struct(*PLACE).alias("position"))
    return with_position(_strict_lines(spark, schema).json(path))


def write_corpus(
    df: DataFrame, path: str, files: int | None = None, position: str = "position"
) -> None:
    """Save a prepared corpus as parquet.

    A corpus that comes from ``shuffle`` lies in order already, so its files are written as the
    partitions are. ``files`` lays any other corpus out by its dense positions in that many files.
    """
    if files:
        rows = df.agg(F.max(position)).first()[0]
        slot = F.expr(f"cast(`{position}` * {files} div {(rows or 0) + 1} as int)")
        df = df.withColumn("__file", slot).repartitionById(files, "__file").drop("__file")
        df = df.sortWithinPartitions(position)
    df.write.mode("overwrite").parquet(path)


def read_prepared(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A saved corpus; the order is in its position column."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)

