"""Resumable batch scoring with a predictor the user supplies."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskmill.operators.records import first_of_duplicates, to_messages, with_position
from taskmill.scale import partitions
from taskmill.schema import RECORD_KEY
from taskmill.sources.ledger import Ledger, record_key
from taskmill.sources.results import batch_folder, batches_of, read_responses, write_responses

Predictor = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def with_responses(df: DataFrame, predict: Predictor, parallelism: int | None = None) -> DataFrame:
    """Add ``response``: the predictor gets batches of messages, once per partition.

    A predictor loads its model before its loop, so each Python worker loads it once per task. It has to
    answer every batch, in order, with one answer per row; anything else fails the job. Only the messages
    become pandas; the other columns pass through unchanged.
    ``parallelism`` spreads few but expensive rows over that many tasks.
    """
    columns = df.columns
    schema = T.StructType(df.schema.fields + [T.StructField("response", T.StringType())])
    rows = to_messages(df, "score")
    if parallelism:
        rows = rows.repartition(parallelism, *RECORD_KEY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[pa.RecordBatch] = deque()

        def messages() -> Iterator[pd.Series]:
            for batch in batches:
                waiting.append(batch)
                yield batch.column("messages").to_pandas()

        for answers in predict(messages()):
            if not waiting or len(answers) != waiting[0].num_rows:
                raise ValueError("the predictor has to yield one answer per row of each batch, in order")
            batch = waiting.popleft()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(answers, pa.string(), from_pandas=True)],
                schema=pa.schema([*(batch.schema.field(c) for c in columns), pa.field("response", pa.string())]),
            )
        if waiting or next(batches, None) is not None:
            raise ValueError("the predictor left batches without an answer")

    return rows.mapInArrow(run, schema)


def unscored(df: DataFrame, ledger: Ledger, position: str = "position", batch: str | None = None) -> DataFrame:
    """The first row of each record that the ledger does not have, with its key as ``__record``.

    Each task trims its copies, then the rows move once, into the ledger's buckets; the ledger is read by
    its key alone and does not move. Only under another number of shuffle partitions they move twice.
    """
    columns = [c for c in df.columns if c != position]
    first = first_of_duplicates(df.withColumn("__record", record_key(columns)), position, ["__record"])
    if partitions(df.sparkSession) != ledger.buckets:
        first = first.repartition(ledger.buckets, "__record")
    known = ledger.answered(batch)
    return first.join(known.hint("merge"), F.col("__record") == F.col("record"), "left_anti")


def recover(ledger: Ledger, schema: T.StructType) -> None:
    """Enter batches whose results were written but not entered, as after a job that died in between."""
    for batch in sorted(batches_of(ledger.spark, ledger.results) - ledger.done()):
        enter(ledger, batch, schema)


def enter(ledger: Ledger, batch: str, schema: T.StructType) -> None:
    """Enter the keys of the results that a batch has written."""
    written = read_responses(ledger.spark, batch_folder(ledger.results, batch), schema)
    columns = [c for c in schema.names if c != "response"]
    ledger.enter(written.select(record_key(columns).alias("record")), batch)


def score(
    df: DataFrame,
    predict: Predictor,
    results: str,
    position: str = "position",
    parallelism: int | None = None,
    batch: str | None = None,
) -> None:
    """Score the records without a result and add theirs; a second run adds nothing.

    Records are told apart by language, dataset and id, nulls included; those without an id by all their
    columns. Of several with one key the first counts. What has been answered is in a ledger below the
    results (``sources.ledger``), so earlier results are not read again.

    The results of a run lie in a folder of their own, named by ``batch``. A batch that is run again under
    its name replaces its folder and looks past its own entries, so a repeated micro-batch changes nothing.
    """
    ledger = Ledger(df.sparkSession, results)
    rows = df if position in df.columns else with_position(df, position)
    result = T.StructType(df.drop(position).schema.fields + [T.StructField("response", T.StringType())])
    if batch is None:
        recover(ledger, result)
        batch = uuid.uuid4().hex
    todo = unscored(rows, ledger, position, batch).drop(position, "__record")
    write_responses(with_responses(todo, predict, parallelism), batch_folder(results, batch), "overwrite")
    enter(ledger, batch, result)
