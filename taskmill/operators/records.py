"""Row-level operators on instruction records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskmill.functions import prompts, text
from taskmill.functions.prompts import ChatTemplate
from taskmill.schema import RECORD_KEY


def union(frames: Sequence[DataFrame]) -> DataFrame:
    """Datasets one after the other, aligned by column name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_position(df: DataFrame, position: str = "position") -> DataFrame:
    """The place of rows in their input: file, block of the file, and order within; files by name.

    Use it directly after a read, before anything moves rows. Rows of several tables, or from elsewhere than
    files, are in the order they are read.
    """
    one = df._jdf.queryExecution().analyzed().collectLeaves().size() == 1
    file = F.input_file_name() if one else F.lit("")
    block = F.input_file_block_start() if one else F.lit(-1).cast("bigint")
    place = F.struct(file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("place"))
    return df.withColumn(position, place)


def cast_ids(df: DataFrame, column: str = "original_id") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("string"))


def with_defaults(df: DataFrame) -> DataFrame:
    """Language, dataset and task columns where the corpus has none; nulls stay."""
    defaults = {"lang": "en", "dataset": "", "task": ""}
    absent = {name: F.lit(value) for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(absent) if absent else df


def render_prompt(df: DataFrame) -> DataFrame:
    """Add ``text``: the full training prompt of each record."""
    return with_defaults(df).withColumn("text", prompts.prompt())


def to_messages(df: DataFrame, variant: str = "native") -> DataFrame:
    """Add ``messages``: chats for training in the native or English track, or for scoring."""
    column = {
        "native": lambda: prompts.messages("native_instruction", "train", output="output"),
        "english": lambda: prompts.messages("instruction", "train", output="output_en"),
        "score": lambda: prompts.messages("instruction", "score"),
    }[variant]()
    return df.withColumn("messages", column)


def render_chat(df: DataFrame, template: ChatTemplate = ChatTemplate(), open_turn: bool = False) -> DataFrame:
    """Add ``Text``: the messages of a row as one string, the last turn left open for an answer if asked for."""
    return df.withColumn("Text", prompts.chat_text("messages", template, open_turn))


def clean_answers(
    df: DataFrame, columns: Sequence[str] = ("response", "output"), null_token: str = "none"
) -> DataFrame:
    return df.withColumns({c: text.clean(F.col(c), null_token) for c in columns})


def split_labels(df: DataFrame, columns: Sequence[str] = ("response", "output")) -> DataFrame:
    return df.withColumns({c: text.label_set(F.col(c)) for c in columns})


def first_of_duplicates(
    df: DataFrame, position: str, key: Sequence[str] = tuple(RECORD_KEY)
) -> DataFrame:
    """The first row of every key in input order.

    Each task keeps one row per key before the shuffle, so a key with many copies stays small.
    """
    order = Window.partitionBy(*key).orderBy(position)
    return df.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def pending(df: DataFrame, done: DataFrame, key: Sequence[str] = tuple(RECORD_KEY)) -> DataFrame:
    """Rows without a result yet; a null in the key is a value like any other."""
    names = {k: f"__done_{i}" for i, k in enumerate(key)}
    done = done.select(*(F.col(k).alias(name) for k, name in names.items()))

    def same(k: str, name: str) -> Column:
        a, b = F.col(k), F.col(name)
        # A plain comparison can use a partitioning by the key; nulls inside a struct are equal in it.
        return a.eqNullSafe(b) if df.schema[k].nullable or done.schema[name].nullable else a == b

    return df.join(done, reduce(lambda a, b: a & b, (same(*pair) for pair in names.items())), "left_anti")


def counts(df: DataFrame, by: Sequence[str] = ("lang", "dataset")) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def map_batches(df: DataFrame, function, schema, **bound) -> DataFrame:
    """Apply a function on iterators of pandas batches, with bound arguments, on every partition."""

    def run(batches):
        return function(batches, **bound)

    return df.mapInPandas(run, schema)
