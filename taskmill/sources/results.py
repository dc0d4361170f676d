"""Scoring results and metrics on disk."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskmill.scale import stage
from taskmill.schema import RESULT
from taskmill.sources.corpus import decoded

CORRUPT = "_corrupt"


def read_results(
    spark: SparkSession,
    experiment_dir: str,
    layout: str = "objects",
    schema: T.StructType = RESULT,
    pattern: str = "*.json",
    once: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Result rows and quarantined records of an experiment: one folder of files per dataset.

    ``objects``: one JSON object per file, over any number of lines. ``lines``: JSON Lines.
    Records that do not parse come back in the second frame with their text and file. Files
    whose name does not match ``pattern`` are ignored. Each frame reads the files for itself; with
    ``once`` they are opened a single time, at once, and both frames come from what that pass staged.
    """
    if layout not in ("objects", "lines"):
        raise ValueError(f"unknown layout {layout!r}")
    whole = layout == "objects"
    place = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    raw = spark.read.text(f"{experiment_dir}/*", wholetext=whole, pathGlobFilter=pattern).select(
        F.col("value").alias("__text"),
        decoded(place).alias("experiment"),
        F.col("_metadata.file_path").alias("__file"),
    )
    blank = F.trim("__text") == ""
    if not whole:
        raw = raw.where(~blank)
    # Read as the only element of an array, so text after the object does not go unnoticed.
    parsed = F.from_json(
        F.concat(F.lit('{"records":['), F.col("__text"), F.lit("]}")),
        T.StructType([
            T.StructField("records", T.ArrayType(schema)), T.StructField(CORRUPT, T.StringType()),
        ]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT},
    )
    # Unpacked by a generator, so a filter on the outcome does not parse the text again.
    rows = raw.select("*", F.inline(F.array(parsed)))
    one = (F.size("records") == 1) & F.get("records", F.lit(0)).isNotNull()
    broken = F.col(CORRUPT).isNotNull() | blank | ~F.coalesce(one, F.lit(False))
    first = F.get("records", F.lit(0))
    if once:
        kept = rows.withColumn("broken", broken).select(
            "broken", "experiment", F.when(~F.col("broken"), first).alias("record"),
            *[F.when(F.col("broken"), F.col(c)).alias(c) for c in ("__file", "__text")],
        )
        rows, broken, first = stage(kept.hint("rebalance"), "results"), F.col("broken"), F.col("record")
    good = rows.where(~broken).select(*(first[name].alias(name) for name in schema.names), "experiment")
    bad = rows.where(broken).select("experiment", F.col("__file").alias("file"), F.col("__text").alias("text"))
    return good, bad


def batch_folder(results: str, batch: str) -> str:
    return f"{results.rstrip('/')}/of_batch={batch}"


def batches_of(spark: SparkSession, results: str) -> set[str]:
    """The batches whose results were written to the end."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(batch_folder(results, "*") + "/_SUCCESS")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return {f.getPath().getParent().getName().removeprefix("of_batch=") for f in files or []}


def write_responses(df: DataFrame, path: str, mode: str = "append") -> None:
    """Write results in folders by language and dataset; the committer adds a job's files as one.

    Rows are rebalanced by dataset: one file for a small dataset, many for a large one. The folders are
    named by copies of the columns, because a folder name cannot tell an empty text from a null.
    """
    copies = df.withColumns({"of_lang": F.col("lang"), "of_dataset": F.col("dataset")})
    copies.hint("rebalance", "lang", "dataset").write.mode(mode).partitionBy("of_lang", "of_dataset").json(path)


def read_responses(spark: SparkSession, path: str, schema: T.StructType = RESULT) -> DataFrame:
    """The results written so far; none if there are none yet."""
    try:
        return spark.read.schema(schema).json(path).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_metrics(documents: DataFrame, path: str) -> None:
    """One JSON metrics document per dataset (columns ``experiment`` and ``document``, a map of variants)."""
    documents.select("experiment", F.to_json("document").alias("value")).write.mode(
        "overwrite"
    ).partitionBy("experiment").text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The stored metrics documents: ``experiment`` and ``document``, a variant."""
    stored = spark.read.schema("value string, experiment string").text(path)
    return stored.select("experiment", F.parse_json("value").alias("document"))
