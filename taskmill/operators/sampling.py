"""Exact seeded samples without sorting or shuffling the rows of a stratum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taskmill.functions.hashing import KEY_BITS, hash_key
from taskmill.functions.prompts import is_summarization
from taskmill.scale import lookup, settle

BUCKET_ROWS = 4096


def stratified_sample(
    df: DataFrame,
    samples: int,
    by: str | Column = "output",
    within: Sequence[str] = ("lang", "dataset"),
    seed: int = 42,
    id_col: str = "id",
    strict: bool = False,
) -> DataFrame:
    """Exactly ``samples`` rows of every dataset, shared out in proportion to its strata.

    Shares are floored and the rest goes to the largest fractions, ties by stratum name.
    ``samples <= 0`` or a dataset of at most ``samples`` rows passes through whole. ``strict``
    refuses a stratum of one row and a sample, or a remainder, smaller than the strata.
    """
    if samples <= 0:
        return df
    stratum = F.col(by) if isinstance(by, str) else by
    return _sample(df, samples, stratum, within, seed, id_col, "strata" if strict else None)


def uniform_sample(
    df: DataFrame,
    samples: int,
    within: Sequence[str] = ("lang", "dataset"),
    seed: int = 42,
    id_col: str = "id",
    on_short: str = "all",
) -> DataFrame:
    """Exactly ``samples`` rows of every dataset; a shorter one passes whole or is an error."""
    if on_short not in ("all", "error"):
        raise ValueError("on_short must be 'all' or 'error'")
    if samples <= 0:
        return df
    check = "short" if on_short == "error" else None
    return _sample(df, samples, F.lit(None).cast("string"), within, seed, id_col, check)


def sample_corpus(
    df: DataFrame,
    samples: int,
    within: Sequence[str] = ("lang", "dataset"),
    seed: int = 42,
    id_col: str = "id",
    strict: bool = False,
) -> DataFrame:
    """Sample every dataset of a corpus: summarization uniformly, the others by label."""
    if samples <= 0:
        return df
    stratum = F.when(~is_summarization("sample"), F.col("output"))
    return _sample(df, samples, stratum, within, seed, id_col, "corpus" if strict else None)


def allocate(sizes: DataFrame, samples: int, within: Sequence[str]) -> DataFrame:
    """Add ``take`` to a table of strata with their ``size``, in integer arithmetic."""
    group = Window.partitionBy(*within)
    total = F.sum("size").over(group)
    share, rest = F.expr(f"{samples} * size div __total"), F.expr(f"{samples} * size % __total")
    shared = sizes.withColumn("__total", total).withColumns({"__share": share, "__rest": rest})
    left = F.lit(samples) - F.sum("__share").over(group)
    order = F.row_number().over(group.orderBy(F.desc("__rest"), "stratum"))
    take = F.when(F.col("__total") <= samples, F.col("size")).otherwise(
        F.col("__share") + (order <= left).cast("int")
    )
    return shared.withColumn("take", take.cast("bigint")).drop("__share", "__rest").withColumnRenamed(
        "__total", "total"
    )


def _check(strata: DataFrame, samples: int, within: list[str], check: str) -> None:
    datasets = strata.groupBy(*within).agg(
        F.max("total").alias("rows"), F.count(F.lit(1)).alias("strata"), F.min("size").alias("least"),
        F.max(F.col("stratum").isNull()).alias("uniform"),
    )
    rows, count = F.col("rows"), F.col("strata")
    few = (rows > samples) & (
        (F.col("least") < 2) | (count > samples) | (rows - samples < count)
    )
    short = rows < samples
    broken = {
        "strata": few,
        "short": short,
        "corpus": F.when(F.col("uniform"), short).otherwise(few),
    }[check]
    found = datasets.where(broken).limit(20).collect()
    if found:
        raise ValueError(f"cannot sample {samples} rows of {[row.asDict() for row in found]}")


def _sample(
    df: DataFrame,
    samples: int,
    stratum: Column,
    within: Sequence[str],
    seed: int,
    id_col: str,
    check: str | None,
) -> DataFrame:
    """Keep the rows with the smallest keys of each stratum.

    Stratum sizes give the allocation. For strata that are cut, counts per key bucket (both
    combined before they are shuffled) find the one bucket where the cut lies, and only the ids
    of that bucket are ranked. The rows are then filtered against the exact cut and never move.
    """
    within = list(within)
    strata_key = within + ["stratum"]
    keyed = df.withColumns({"stratum": stratum, "__key": hash_key(seed, id_col)})
    sizes = keyed.groupBy(*strata_key).agg(F.count(F.lit(1)).alias("size"))
    strata = settle(allocate(sizes, samples, within))
    if check:
        _check(strata, samples, within, check)
    whole = strata.where("take = size").select(
        *strata_key,
        F.lit(2**62).alias("__cut"),
        F.lit(None).cast(df.schema[id_col].dataType).alias("__cut_id"),
        F.lit(0).cast("bigint").alias("__keep"),
        F.lit(False).alias("__tied"),
    )
    cuts = settle(_cuts(keyed, strata.where("take > 0 and take < size"), strata_key, id_col).unionByName(whole))

    rows = lookup(keyed, cuts, strata_key, "inner", null_safe=True)
    at_cut = (F.col("__key") == F.col("__cut")) & F.col(id_col).eqNullSafe(F.col("__cut_id"))
    # A missing id comes before all others, as it does in the order that found the cut.
    through = F.col(id_col).isNull() | F.coalesce(F.col(id_col) <= F.col("__cut_id"), F.lit(False))
    below = (F.col("__key") < F.col("__cut")) | ((F.col("__key") == F.col("__cut")) & through)
    if cuts.where("__tied").isEmpty():
        return rows.where(below).select(*df.columns)
    tied = _copies(rows.where(at_cut & F.col("__tied")), df.columns, strata_key)
    return rows.where(below & ~(at_cut & F.col("__tied"))).select(*df.columns).unionByName(tied)


def _cuts(keyed: DataFrame, strata: DataFrame, strata_key: list[str], id_col: str) -> DataFrame:
    """The key and id of the last row each stratum keeps."""
    # A bucket holds about BUCKET_ROWS rows, however large its stratum is.
    bits = F.ceil(F.log2(F.col("size") / BUCKET_ROWS))
    shift = (KEY_BITS - F.greatest(F.lit(0), bits)).cast("int")
    strata = strata.select(*strata_key, "take", shift.alias("__shift"))
    bucket = F.expr("shiftright(__key, __shift)")
    narrow = keyed.select(*strata_key, "__key", id_col)

    counts = (
        lookup(narrow, strata, strata_key, "inner", null_safe=True)
        .groupBy(*strata_key, "take", "__shift", bucket.alias("__bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    running = F.sum("n").over(Window.partitionBy(*strata_key).orderBy("__bucket"))
    bounds = settle(
        counts.withColumn("__through", running)
        .where("__through >= take and __through - n < take")
        .select(*strata_key, "__shift", "__bucket", F.expr("take - __through + n").alias("__need"))
    )

    # Ids are counted before they are ranked, so copies of one id are one row here.
    edge = (
        lookup(narrow, bounds, strata_key, "inner", null_safe=True)
        .where(bucket == F.col("__bucket"))
        .groupBy(*strata_key, "__need", "__key", id_col)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    through = F.sum("n").over(Window.partitionBy(*strata_key).orderBy("__key", id_col))
    return (
        edge.withColumn("__through", through)
        .where("__through >= __need and __through - n < __need")
        .select(
            *strata_key,
            F.col("__key").alias("__cut"),
            F.col(id_col).alias("__cut_id"),
            F.expr("__need - __through + n").alias("__keep"),
            (F.col("__through") > F.col("__need")).alias("__tied"),
        )
    )


def _copies(rows: DataFrame, columns: list[str], strata_key: list[str]) -> DataFrame:
    """Of rows that share the id at a cut, as many as fit: equal rows are counted, not gathered."""
    distinct = rows.groupBy(*dict.fromkeys(columns + strata_key), "__keep").agg(
        F.count(F.lit(1)).alias("__n")
    )
    order = Window.partitionBy(*strata_key).orderBy(F.xxhash64(*columns), *columns)
    before = F.sum("__n").over(order) - F.col("__n")
    keep = F.least(F.col("__n"), F.col("__keep") - F.col("__before"))
    return (
        distinct.withColumn("__before", before)
        .where(F.col("__before") < F.col("__keep"))
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), keep.cast("int"))))
        .select(*columns)
    )
