"""Lay records end to end into blocks of a fixed length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskmill.scale import lookup, settle

STRETCH = 1 << 20


def pack(
    df: DataFrame,
    length: str,
    block: int,
    by: Sequence[str] = (),
    position: str = "position",
    stretch: int = STRETCH,
) -> DataFrame:
    """Add ``start``, ``first_block`` and ``last_block`` of each record in position order.

    ``position`` is a unique integer within the group. Lengths are first summed per stretch of
    positions (combined before the shuffle); a record's start is the total before its stretch
    plus a running sum inside it, so no task ever holds more than ``stretch`` records of a group.
    """
    by = list(by)
    rows = df.withColumn("__stretch", F.expr(f"`{position}` div {stretch}"))
    sums = rows.groupBy(*by, "__stretch").agg(F.sum(length).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(
        sums.select(*by, "__stretch", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    )
    inside = (
        Window.partitionBy(*by, "__stretch")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    run = F.coalesce(F.sum(length).over(inside), F.lit(0))
    placed = lookup(rows, offsets, by + ["__stretch"], "inner", null_safe=True)
    placed = placed.withColumn("start", F.col("__before") + run)
    last = F.greatest(F.col("start"), F.col("start") + F.col(length) - 1)
    return placed.withColumns(
        {
            "first_block": F.expr(f"start div {block}"),
            "last_block": F.floor(last / F.lit(block)).cast("bigint"),
        }
    ).select(*df.columns, "start", "first_block", "last_block")
