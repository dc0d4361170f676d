"""The small support tables: task registry, label map and instruction bank."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The language names of a registry and their codes.
LANG_CODES = {"Arabic": "ar", "English": "en", "Hindi": "hi"}


def parse_registry(raw: DataFrame, codes: Mapping[str, str] = LANG_CODES) -> DataFrame:
    """One row per dataset and language, with a label array (null for summarization).

    ``lang`` may name several languages; a name without a code stays as it is.
    """
    names = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    lang = F.explode(F.split("lang", r",\s*"))
    return raw.withColumns(
        {"labels": F.from_json("labels", "array<string>"), "lang": lang}
    ).withColumn("lang", F.coalesce(F.try_element_at(names, F.col("lang")), "lang"))


def read_registry(spark: SparkSession, path: str, codes: Mapping[str, str] = LANG_CODES) -> DataFrame:
    """Tab-separated with a header: dataset, task, task_definition, lang, labels."""
    schema = "dataset string, task string, task_definition string, lang string, labels string"
    raw = spark.read.schema(schema).csv(path, sep="\t", header=True, quote="")
    return parse_registry(raw, codes)


def registry_labels(registry: DataFrame) -> DataFrame:
    return registry.select("dataset", "lang", F.explode("labels").alias("label"))


def parse_label_map(raw: DataFrame) -> DataFrame:
    """JSON objects native -> English as rows; keys may differ in case only."""
    pairs = F.from_json("value", "map<string,string>")
    return raw.select(F.explode(pairs).alias("native", "english"))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_label_map(spark.read.text(path, wholetext=True))


def parse_instructions(raw: DataFrame) -> DataFrame:
    """JSON objects dataset -> list of instructions as rows with their variant number."""
    bank = F.from_json("value", "map<string,array<string>>")
    return raw.select(F.explode(bank).alias("dataset", "variants")).select(
        "dataset", F.posexplode("variants").alias("variant", "instruction")
    )


def read_instructions(spark: SparkSession, path: str) -> DataFrame:
    return parse_instructions(spark.read.text(path, wholetext=True))
