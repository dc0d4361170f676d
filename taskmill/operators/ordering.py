"""Seeded permutations with an exact global position and a single shuffle of the rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskmill.functions.hashing import KEY_BITS, hash_key, record_digest
from taskmill.scale import lookup, partitions, settle

LANGS = ("ar", "en", "hi")
MODES = ("none", "fully", "by_language", "by_task")

# A slice of the final order holds about this many rows at most, whatever the session's setting.
SLICE_ROWS = 1_000_000
# Copies of one row are made again by tasks of so many.
COPIES = 100_000


def lang_rank(langs: Sequence[str] = LANGS, column: str = "lang") -> Column:
    """The place of a language in the corpus order; other languages come last, by name."""
    rank = F.lit(len(langs))
    for index, lang in reversed(list(enumerate(langs))):
        rank = F.when(F.col(column) == lang, index).otherwise(rank)
    return rank


def with_copies(df: DataFrame, digest: str = "__digest", copy: str = "__copy") -> DataFrame:
    """Add a digest of the whole row, and a number that tells equal rows apart: from 0 up, each once.

    Equal rows cannot be told from each other, so those that repeat are counted, kept once and made again
    with a number each, in tasks of a bounded number. All others stay where they are.
    """
    rows = df.withColumn(digest, record_digest(df))
    many = settle(rows.groupBy(digest).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"))
    if many.isEmpty():
        return rows.withColumn(copy, F.lit(0).cast("bigint"))
    alone = lookup(rows, many.select(digest), [digest], "left_anti").withColumn(copy, F.lit(0).cast("bigint"))
    once = lookup(rows, many, [digest], "inner").dropDuplicates([digest])
    begun = once.withColumn("__begin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(COPIES).cast("bigint"))))
    until = F.least(F.col("__begin") + COPIES, F.col("__n")) - 1
    again = begun.repartition(digest, "__begin").withColumn(copy, F.explode(F.sequence(F.col("__begin"), until)))
    return alone.unionByName(again.select(*alone.columns))


def _positions(
    df: DataFrame, groups: dict[str, Column], seed: int, id_col: str | None, position: str, within: bool
) -> DataFrame:
    """Number the rows in the order (groups, key, id), over everything or within the groups.

    Keys are uniform, so a row's partition follows from its key and the row count of its group
    alone: partition p holds the p-th slice of the final order whatever the size of a group.
    The first pass counts the groups, the second the slices; both read the group and id columns
    only and combine before they shuffle. The rows move once, straight to their slice.
    """
    names = [f"__g{i}" for i in range(len(groups))] or ["__g0"]
    columns = list(groups.values()) or [F.lit(0)]
    if id_col is None:
        ties, rows = ["__digest", "__copy"], with_copies(df)
        key = hash_key(seed, F.concat_ws(":", "__digest", "__copy"))
    else:
        ties, rows, key = [id_col], df, hash_key(seed, id_col)
    keyed = rows.withColumns(dict(zip(names, columns))).withColumn("__key", key)

    # One row per group, so the running sum over all of them is small.
    sizes = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(*names).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    sizes = settle(
        sizes.select(
            *names,
            "__size",
            F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"),
            F.sum("__size").over(everything).alias("__total"),
        )
    )
    total = sizes.agg(F.max("__total")).first()[0] or 0
    parts = max(partitions(df.sparkSession), math.ceil(total / SLICE_ROWS))
    expected = F.col("__start") + F.col("__size") * (F.col("__key") / F.lit(float(2**KEY_BITS)))
    placed = lookup(keyed, sizes, names, "inner", null_safe=True).withColumn(
        "__part",
        F.least(F.floor(expected * parts / F.col("__total")), F.lit(parts - 1)).cast("int"),
    )

    # One row per slice: small by construction.
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    slices = settle(
        counts.select(
            F.col("__part").alias("__slice"),
            F.coalesce(
                F.sum("__n").over(
                    Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("__before"),
        )
    )
    in_slice = Window.partitionBy("__part").orderBy(*names, "__key", *ties)
    ranked = placed.repartitionById(parts, "__part").withColumn(
        "__rank", F.row_number().over(in_slice) - 1
    )
    number = F.col("__before") + F.col("__rank") - (F.col("__start") if within else F.lit(0))
    return ranked.join(
        F.broadcast(slices), F.col("__part") == F.col("__slice")
    ).select(*df.columns, number.cast("bigint").alias(position))


def shuffle(
    df: DataFrame,
    mode: str = "none",
    seed: int = 42,
    id_col: str | None = "id",
    langs: Sequence[str] = LANGS,
    position: str = "position",
    lang: str = "lang",
    dataset: str = "dataset",
) -> DataFrame:
    """Add the position of every row in the order a shuffling mode asks for.

    ``none`` keeps languages and datasets together (rows of a dataset stay permuted),
    ``by_language`` permutes within a language, ``by_task`` within a task and drops rows
    without one, ``fully`` permutes everything. The result is also laid out in this order.

    The key of a row is a hash of its id. Where ids repeat or are missing, ``id_col=None`` takes the whole
    row and the number of its copy instead: rows that share an id then lie apart, and equal rows too.
    """
    rank = lang_rank(langs, lang)
    if mode == "none":
        groups = {"rank": rank, "lang": F.col(lang), "dataset": F.col(dataset)}
    elif mode == "fully":
        groups = {}
    elif mode == "by_language":
        groups = {"rank": rank, "lang": F.col(lang)}
    elif mode == "by_task":
        df = df.where(F.col("task").isNotNull())
        groups = {"task": F.col("task")}
    else:
        raise ValueError(f"unknown mode {mode!r}, expected one of {MODES}")
    return _positions(df, groups, seed, id_col, position, within=False)


def permute(
    df: DataFrame,
    within: Sequence[str] = ("lang", "dataset"),
    seed: int = 42,
    id_col: str | None = "id",
    position: str = "position",
) -> DataFrame:
    """Add the position of every row in a seeded permutation of its group."""
    groups = {name: F.col(name) for name in within}
    return _positions(df, groups, seed, id_col, position, within=True)
