"""Lookups on labels: true label sets, encoding, answer repair, translation, instructions, registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskmill.functions.hashing import hash_key
from taskmill.scale import fits, lookup, settle
from taskmill.schema import DATASET_KEY


def distinct_labels(
    df: DataFrame, by: Sequence[str] = tuple(DATASET_KEY), column: str = "output"
) -> DataFrame:
    return df.select(*by, F.col(column).alias("label")).distinct()


def label_codes(
    df: DataFrame, by: Sequence[str] = tuple(DATASET_KEY), column: str = "output"
) -> DataFrame:
    """The true labels of each dataset with their rank in code-point order and their number."""
    group = Window.partitionBy(*by)
    return distinct_labels(df, by, column).select(
        *by,
        "label",
        (F.row_number().over(group.orderBy("label")) - 1).alias("code"),
        F.count(F.lit(1)).over(group).cast("int").alias("n_labels"),
    )


def encode_labels(
    df: DataFrame,
    by: Sequence[str] = tuple(DATASET_KEY),
    columns: Sequence[str] = ("output", "response"),
    labels: DataFrame | None = None,
) -> DataFrame:
    """Add ``<column>_code``: the rank of a label among the true labels, null if it is none."""
    by = list(by)
    labels = settle(label_codes(df, by)) if labels is None else labels
    small = fits(labels)
    for column in columns:
        codes = labels.select(
            *by, F.col("label").alias(column), F.col("code").alias(f"{column}_code")
        )
        df = lookup(df, codes, by + [column], small=small)
    return df


def repair_answers(
    df: DataFrame,
    seed: int = 42,
    by: Sequence[str] = tuple(DATASET_KEY),
    id_col: str = "id",
    labels: DataFrame | None = None,
) -> DataFrame:
    """Replace a response that is no true label of its dataset by a seeded choice among them.

    Two passes: the true labels (combined before the shuffle), then lookups row by row.
    """
    by = list(by)
    labels = settle(label_codes(df, by)) if labels is None else labels
    known = labels.select(
        *by, F.col("label").alias("response"), F.lit(True).alias("__known")
    )
    number = labels.where("code = 0").select(*by, "n_labels")
    choice = labels.select(*by, F.col("code").alias("__pick"), F.col("label").alias("__choice"))

    # The three tables are parts of one, so one measurement is enough.
    small = fits(labels)
    rows = lookup(df, known, by + ["response"], small=small)
    rows = lookup(rows, number, by, small=small).withColumn(
        "__pick",
        F.when(
            F.col("__known").isNull(), F.pmod(hash_key(seed, id_col), F.col("n_labels")).cast("int")
        ),
    )
    rows = lookup(rows, choice, by + ["__pick"], small=small)
    answer = F.coalesce("__choice", "response").alias("response")
    return rows.select(*[answer if c == "response" else c for c in df.columns])


def translate_labels(
    df: DataFrame, label_map: DataFrame, column: str = "output", target: str = "output_en"
) -> DataFrame:
    """Add the English label; a label without one passes through."""
    table = label_map.select(F.col("native").alias(column), F.col("english").alias("__english"))
    rows = lookup(df, table, [column])
    return rows.withColumn(target, F.coalesce("__english", column)).drop("__english")


def assign_instructions(
    df: DataFrame,
    bank: DataFrame,
    seed: int = 42,
    id_col: str = "id",
    key: Sequence[str] = ("dataset",),
    target: str = "instruction",
) -> DataFrame:
    """Give every record one of the instruction variants of its dataset, by seeded choice.

    Records of a dataset without variants keep the instruction they have.
    """
    key = list(key)
    number = settle(bank.groupBy(*key).agg(F.count(F.lit(1)).alias("__variants")))
    table = bank.select(
        *key, F.col("variant").cast("bigint").alias("__variant"), F.col("instruction").alias("__chosen")
    )
    rows = lookup(df, number, key).withColumn(
        "__variant", F.pmod(hash_key(seed, id_col), F.col("__variants"))
    )
    rows = lookup(rows, table, key + ["__variant"])
    chosen = F.coalesce("__chosen", target) if target in df.columns else F.col("__chosen")
    return rows.withColumn(target, chosen).drop("__variants", "__variant", "__chosen")


def enrich(
    df: DataFrame, registry: DataFrame, columns: Sequence[str] = ("task", "task_definition", "labels")
) -> DataFrame:
    """Fill task, task definition and labels from the registry of datasets."""
    key = ["dataset", "lang"]
    table = registry.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    rows = lookup(df, table, key)
    filled = {
        c: F.coalesce(f"__{c}", c) if c in df.columns else F.col(f"__{c}") for c in columns
    }
    return rows.withColumns(filled).drop(*[f"__{c}" for c in columns])
