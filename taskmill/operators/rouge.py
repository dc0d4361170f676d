"""ROUGE-1, ROUGE-2, ROUGE-L and ROUGE-Lsum per row and per dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskmill.functions import rouge
from taskmill.functions.rouge import KEYS
from taskmill.functions.text import token_lines, tokens
from taskmill.schema import DATASET_KEY


def rouge_scores(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    reference: str = "output",
    candidate: str = "response",
) -> DataFrame:
    """Add the F-measure (0 to 100) of each key; rows never leave their partition.

    The n-gram keys by themselves are built-ins only. With a subsequence key all keys share its Arrow batch
    call, which counts what they need and no more.
    """
    texts = [F.coalesce(F.col(c), F.lit("")) for c in (reference, candidate)]
    sides = ("reference", "candidate")
    if {"rougeL", "rougeLsum"} & set(keys):
        rows = df.withColumn("__hits", rouge.hits_of(keys)(*map(token_lines, texts)))
        sizes = [F.col(f"__hits.{side}") for side in sides]
        hits = {key: F.col(f"__hits.{key}") for key in KEYS}
    else:
        rows = df.withColumns(dict(zip(("__reference", "__candidate"), map(tokens, texts))))
        sizes = [F.size(f"__{side}") for side in sides]
        hits = {
            f"rouge{n}": rouge.shared(*[rouge.ngrams(F.col(f"__{side}"), n) for side in sides]) for n in (1, 2)
        }
    added = {}
    for key in KEYS:
        if key in keys:
            fewer = 1 if key == "rouge2" else 0
            added[key] = rouge.f_measure(hits[key], *[F.greatest(size - fewer, F.lit(0)) for size in sizes])
    return rows.withColumns(added).drop("__hits", "__reference", "__candidate")


def rouge_metrics(
    df: DataFrame, by: Sequence[str] = tuple(DATASET_KEY), keys: Sequence[str] = KEYS
) -> DataFrame:
    """Mean scores of each dataset."""
    return rouge_scores(df, keys).groupBy(*by).agg(*[F.avg(k).alias(k) for k in keys])
