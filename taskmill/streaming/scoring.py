"""Score record files as they arrive, one committed micro-batch at a time."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from taskmill.plans.scoring import Predictor, score
from taskmill.schema import INSTRUCTION


def score_arriving(
    spark: SparkSession,
    source: str,
    results: str,
    predict: Predictor,
    checkpoint: str,
    schema: T.StructType = INSTRUCTION,
    format: str = "json",
    files_per_batch: int = 1000,
    parallelism: int | None = None,
) -> StreamingQuery:
    """Score all files present in ``source`` and stop; a restart goes on after the last batch.

    The checkpoint remembers finished files. A batch is named by the checkpoint and its number: run again
    after a failure it replaces what it wrote, and no row is answered twice.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def run(batch: DataFrame, number: int) -> None:
        score(batch, predict, results, parallelism=parallelism, batch=f"{stream}-{number}")

    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .format(format)
        .load(source)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
