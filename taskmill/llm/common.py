"""Helpers that several of these operators share."""

from __future__ import annotations

import ctypes
import functools
import inspect
import os
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Where the public vocabulary files lie; only the driver reads them.
MODEL = os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")

# What the contracts call white space: the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"

# Odd constants of the window and finishing hashes (fixed values).
STEP, SECOND, MIX_A, MIX_B = (
    0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a column to a name inside an expression, so that lambdas do not compute it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words between white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def release() -> None:
    """Give freed memory back to the system. Workers outlive their tasks, and allocators keep what they had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(batches: Callable) -> Callable:
    """The same function on iterators of batches; when its task ends, its memory goes back."""

    @functools.wraps(batches)
    def run(rows):
        try:
            yield from batches(rows)
        finally:
            release()

    return run


def released_group(group: Callable) -> Callable:
    """The same function on a group, whose memory goes back before the next one comes."""

    @functools.wraps(group)
    def run(*tables):
        try:
            return group(*tables)
        finally:
            release()

    # Spark tells by the arguments whether a function wants the key.
    run.__signature__ = inspect.signature(group)
    return run


def slices(sizes: Sequence[int], at_once: int) -> list[tuple[int, int]]:
    """Ranges of rows of about this size together; a larger row is one by itself."""
    turn = np.cumsum(sizes) // at_once
    cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names of internal columns that none of the frame's columns has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        name = f"__{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        found.append(name)
    return found


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """The size of all texts: one narrow aggregation, for choosing numbers of partitions."""
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def mixed(x: np.ndarray) -> np.ndarray:
    """A finishing hash of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    """A 64-bit hash of every word."""
    if not words:
        return np.empty(0, np.uint64)
    column = np.empty(len(words), dtype=object)
    column[:] = words
    return pd.util.hash_array(column, categorize=False)


def window_hashes(hashes: np.ndarray, size: int, step: int = STEP) -> np.ndarray:
    """A hash of the words i to i + size - 1 for every i where such a window fits."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total, factor = np.zeros(n, np.uint64), 1
    for j in range(size):
        total += hashes[j : j + n] * np.uint64(factor)
        factor = factor * step % 2**64
    return mixed(total)


def pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers as byte planes: high bytes that hardly change compress to nothing."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending integers as the packed differences of neighbours."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def found_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of every value in the ascending ``known``, -1 where it is not there."""
    if not len(known):
        return np.full(len(values), -1)
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[place] == values, place, -1)
