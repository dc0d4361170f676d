"""Building blocks shared by the operators: settled tables and size-checked lookups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024

# The scratch paths made inside the ``cleared`` blocks that are open, one list for each.
_open: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only in a local session without one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="taskmill-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what was staged or settled inside; for jobs that have written their result by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def settle(df: DataFrame) -> DataFrame:
    """Compute a small table once, in reliable storage.

    What gets broadcast or consumed twice is settled first: it is not recomputed, an executor
    loss does not lose it, and the broadcast itself cannot run into its timeout while a long
    scan is still feeding it.
    """
    shared_folder(df.sparkSession)
    settled = df.checkpoint(eager=True)
    if _open:
        file = settled._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            _open[-1].append(file.get())
    return settled


def stage(df: DataFrame, label: str = "stage", by: Sequence[str] = ()) -> DataFrame:
    """Write a large intermediate as parquet under the shared folder and read it back.

    With ``by`` the table is partitioned by these columns, and filters on them select folders;
    rows are rebalanced first, so a folder gets as many files as its rows need.
    """
    path = scratch(df.sparkSession, label)
    rows = df.hint("rebalance", *by) if by else df
    rows.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def discard(*frames: DataFrame) -> None:
    """Remove the files of staged tables that nothing reads any more."""
    for df in frames:
        root = shared_folder(df.sparkSession).rstrip("/").rsplit("/", 1)[-1]
        for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
            if root in folder:
                remove(df.sparkSession, folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _row_bytes(df: DataFrame) -> Column:
    sizes = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.coalesce(F.octet_length(column), F.lit(0)) + 24)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sizes.append(2 * F.octet_length(F.to_json(F.struct(column))))
        else:
            sizes.append(F.lit(16))
    return reduce(lambda a, b: a + b, sizes, F.lit(16)).cast("bigint")


def fits(table: DataFrame, limit: int | None = None) -> bool:
    """Whether the measured size of a table allows broadcasting it."""
    limit = BROADCAST_BYTES if limit is None else limit
    return (table.agg(F.sum(_row_bytes(table))).first()[0] or 0) <= limit


def at_rest(df: DataFrame) -> bool:
    """Whether a table is only read or projected, so that it can be used twice without being computed twice."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias", "View"):
        node = node.children().apply(0)
    return node.children().isEmpty()


def heavy_keys(rows: DataFrame, on: Sequence[str], share: float) -> DataFrame:
    """The hashes of the keys that hold more than this share of the rows, as ``__heavy``; few, whatever the rows.

    They come from a mergeable sketch of frequent items: one pass over the keys, of which a task sends on
    a summary of bounded size.
    """
    most = int(1 / share) + 1
    key = F.xxhash64(*[F.col(f"`{c}`") for c in on])
    top = rows.select(key.alias("key")).agg(
        F.expr(f"approx_top_k(key, {most}, {8 * most})").alias("top"), F.count(F.lit(1)).alias("n")
    )
    found = top.select("n", F.inline("top")).where(F.col("count") > F.col("n") * share)
    return found.select(F.col("item").alias("__heavy"))


def lookup(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    null_safe: bool = False,
    limit: int | None = None,
    small: bool | None = None,
    share: float | None = None,
) -> DataFrame:
    """Join rows to a table with at most one row per key.

    The table is settled if it is not at rest, and measured, unless the caller knows from a larger one that
    it is ``small``: up to ``limit`` bytes it is broadcast and the rows do not move. Beyond that a sketch finds the heavy keys, those with
    more than ``share`` of the rows (a quarter of an even task's, unless given). Their rows, and those
    whose key is null and matches nothing, stay where they are and meet the few rows of the table that have
    a heavy key; all others are joined by a shuffle, in which no key is large.
    """
    on = list(on)
    keys = {name: f"__key_{name}" for name in on}
    if small is None and not at_rest(table):
        table = settle(table)
    table = table.withColumnsRenamed(keys)

    def equal(name: str) -> Column:
        a, b = F.col(f"`{name}`"), F.col(f"`{keys[name]}`")
        return a.eqNullSafe(b) if null_safe else a == b

    def joined(part: DataFrame, other: DataFrame) -> DataFrame:
        return part.join(other, reduce(lambda a, b: a & b, [equal(name) for name in on]), how).drop(*keys.values())

    if fits(table, limit) if small is None else small:
        return joined(rows, F.broadcast(table))
    share = 1 / (4 * partitions(rows.sparkSession)) if share is None else share
    heavy = settle(heavy_keys(rows, on, share))
    unmatched = F.lit(False) if null_safe else reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNull() for c in on])
    hashed = rows.withColumn("__hash", F.when(~unmatched, F.xxhash64(*[F.col(f"`{c}`") for c in on])))
    marked = hashed.join(F.broadcast(heavy), F.col("__hash") == F.col("__heavy"), "left")
    stays = F.col("__heavy").isNotNull() | F.col("__hash").isNull()
    kinds = dict(rows.dtypes)
    theirs = F.xxhash64(*[F.col(f"`{keys[name]}`").cast(kinds[name]) for name in on])
    few = settle(table.join(F.broadcast(heavy), theirs == F.col("__heavy"), "left_semi"))
    in_place = joined(marked.where(stays).drop("__hash", "__heavy"), F.broadcast(few))
    moved = joined(marked.where(~stays).drop("__hash", "__heavy"), table)
    return in_place.unionByName(moved)
