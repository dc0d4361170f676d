"""A quality classifier that compares compressed sizes under two dictionaries."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskmill.llm.common import mixed, release, released
from taskmill.scale import lookup, settle

# The model is fitted on at most this many labelled rows of each class, half for the dictionaries,
# half for the calibration; which rows these are follows from a hash of the id alone.
FIT_ROWS = 4000
# A dictionary holds blocks of the whole fitted texts, those with the smallest hashes, up to this size and
# number. Both dictionaries are cut to the size of the smaller one, so that neither knows more.
DICTIONARY_BYTES = 512 * 1024
DICTIONARY_BLOCKS = 8192
# Texts are compressed in blocks of this size, so that the dictionaries count in long texts too.
BLOCK_BYTES = 1024
LEVEL = 3


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries and the weights that turn a size difference into a probability."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(**plain)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, **plain)


def size_differences(texts: Iterable[bytes | None], good: bytes, bad: bytes) -> Iterator[float]:
    """The bytes that the good dictionary saves over the bad one, by the square root of the bytes of a text.

    What chance adds up to grows with the root of the length, so this is a difference in units of its own
    noise: short and long texts can be measured by one scale.
    """
    by_good, by_bad = _compressor(good), _compressor(bad)
    for text in texts:
        text = text or b""
        saved = sum(len(by_bad.compress(b)) - len(by_good.compress(b)) for b in _blocks(text))
        yield saved / max(1.0, len(text)) ** 0.5


def _inputs(differences: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(differences)), differences], axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _calibrate(inputs: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic regression with a little shrinkage."""
    w = np.zeros(inputs.shape[1])
    for _ in range(60):
        p = _logistic(inputs @ w)
        slope = inputs.T @ (weight * (good - p)) - 1e-2 * w
        bend = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(x) for x in w)


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    fit_rows: int = FIT_ROWS,
) -> CompressionModel:
    """Fit on labelled documents: label 1 is good, 0 bad, other labels and null ids are left out.

    Of each class the ``fit_rows`` rows with the smallest hash of the id are used, whole: half of them for
    the dictionaries (``DICTIONARY_BYTES``), half for the calibration. If a class has no rows, both
    dictionaries are empty and every score is the share of good labels; without any labels it is one half.
    Rows that repeat a label count once, documents that share an id each.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__label")
    )
    totals = {row["__label"]: row["n"] for row in known.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("__id")
    picked = None
    for value in (0, 1):
        rows = known.where(F.col("__label") == value).dropDuplicates(["__id"]).orderBy(order, "__id").limit(fit_rows)
        picked = rows if picked is None else picked.unionByName(rows)
    # At most twice fit_rows rows, so these may go to every task.
    picked = settle(picked.withColumn("__part", F.pmod(F.xxhash64("__id", F.lit("part")), F.lit(2))))
    texts = lookup(
        docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("binary").alias("__text")), picked, ["__id"],
        "inner", small=True,
    )

    schema = pa.schema([("label", pa.int32()), ("key", pa.int64()), ("block", pa.binary())])

    def all_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label_, data in zip(batch.column(0), batch.column(1)):
                blocks = _blocks(data.as_py() or b"")
                if blocks:
                    keys = mixed(pd.util.hash_array(np.array([*blocks, b""], dtype=object), categorize=False))[:-1]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([label_.as_py()] * len(blocks), pa.int32()), pa.array((keys >> np.uint64(1)).astype(np.int64)),
                        pa.array(blocks, pa.binary()),
                    ], schema=schema)

    blocks = settle(texts.where("__part = 0").select("__label", "__text").mapInArrow(
        released(all_blocks), "label int, key bigint, block binary"
    ).dropDuplicates(["label", "key"]))
    known_blocks = [
        b"".join(bytes(r["block"]) for r in blocks.where(F.col("label") == value).orderBy("key").limit(DICTIONARY_BLOCKS).collect())
        for value in (0, 1)
    ]
    size = min(DICTIONARY_BYTES, *map(len, known_blocks))
    bad, good = (x[:size] for x in known_blocks)

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(size_differences((t.as_py() for t in batch.column(1)), good, bad))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["label", "difference"])

    rows = texts.where("__part = 1").select("__label", "__text").mapInArrow(
        released(differences), "label int, difference double"
    ).collect()
    if not rows:
        return CompressionModel(good, bad, (0.0, 0.0))
    label_ = np.array([r["label"] for r in rows], float)
    # Classes count as often as they do among all labels, whatever share of each was drawn.
    weight = np.where(label_ == 1, totals.get(1, 0) / max(1, label_.sum()), totals.get(0, 0) / max(1, (1 - label_).sum()))
    weight = weight * len(rows) / weight.sum()
    return CompressionModel(good, bad, _calibrate(_inputs(np.array([r["difference"] for r in rows])), label_, weight))


def score_quality(docs: DataFrame, model: CompressionModel, text: str = "text", score: str = "score") -> DataFrame:
    """Add the probability that a document is good, from the size difference of its whole text alone.

    Null and empty texts have a difference of 0 and its score. A text of any length is compressed block by
    block, to the end. Equal texts have equal scores; rows stay as they are, one for one; an old column
    of the name is replaced; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fitted = sent.value
        try:
            for texts in batches:
                found = np.fromiter(size_differences(texts, fitted.good, fitted.bad), float, len(texts))
                yield pd.Series(_logistic(_inputs(found) @ np.array(fitted.weights)))
        finally:
            release()

    return docs.withColumn(score, scores(F.col(text).cast("binary")))


def accuracy(scored: DataFrame, labels: DataFrame, threshold: float = 0.3) -> dict[int, float]:
    """The share of right predictions per class, over the labelled rows given."""
    rows = scored.join(labels.select("doc_id", "quality"), "doc_id").groupBy("quality").agg(
        F.avg(((F.col("score") >= threshold).cast("int") == F.col("quality")).cast("double")).alias("right")
    ).collect()
    return {r["quality"]: r["right"] for r in rows if r["right"] is not None and not math.isnan(r["right"])}
