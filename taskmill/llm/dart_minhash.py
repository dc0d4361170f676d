"""Near-duplicate classes with DartMinHash signatures, banded joining and exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taskmill.llm.common import STEP, mixed, release, released, slices, window_hashes, word_hashes
from taskmill.llm.decontamination import folded_words
from taskmill.scale import lookup, settle, stage

SHINGLE = 5
SIMILARITY = 0.8
# 40 bands of 6: two texts of similarity 0.8 share a band with probability 1 - 5e-6, of 0.5 with 0.47.
BANDS, ROWS = 40, 6
# Python works on about so many bytes of a column at a time.
BYTES_AT_ONCE = 1 << 20

# Time is cut into slabs: [0, 1/64), then doubling up to 1, then one unit each.
_FINE = 7
_U = 2.0**-53


def _slab(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of time slabs."""
    fine = index < _FINE
    end = np.where(fine, 2.0 ** (np.minimum(index, _FINE - 1) - (_FINE - 1.0)), index - _FINE + 2.0)
    begin = np.where(index == 0, 0.0, np.where(fine, end / 2, end - 1.0))
    return begin, end - begin


def _poisson(uniform: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The number of darts that a uniform draw stands for; the mean is one at most."""
    count = np.zeros(uniform.shape, np.int64)
    term = np.broadcast_to(np.exp(-mean), uniform.shape).copy()
    reached = term.copy()
    for n in range(1, 20):
        more = uniform >= reached
        if not more.any():
            break
        count += more
        term *= mean / n
        reached += term
    return count


def _darts(cells: np.ndarray, limits: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(time, hash) of the darts that land in the cells in the slabs from first to last.

    A cell is one unit of an element's weight; ``limits`` says how much of it belongs to the element.
    Everything about a dart follows from the cell and the slab, so it is the same dart in every text.
    """
    slabs = np.arange(first, last)
    begin, length = _slab(slabs)
    seeds = mixed(cells[:, None] ^ mixed(slabs.astype(np.uint64) + np.uint64(STEP))[None, :])
    count = _poisson((seeds >> np.uint64(11)) * _U, length[None, :])
    cell, slab = np.nonzero(count)
    number = count[cell, slab]
    seed = np.repeat(seeds[cell, slab], number)
    within = np.arange(len(seed)) - np.repeat(np.cumsum(number) - number, number)
    dart = mixed(seed + (within.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP))
    slab, cell = np.repeat(slab, number), np.repeat(cell, number)
    time = begin[slab] + length[slab] * ((mixed(dart) >> np.uint64(11)) * _U)
    part = limits[cell]
    if (part < 1).any():
        inside = (mixed(dart ^ np.uint64(STEP)) >> np.uint64(11)) * _U < part
        time, dart = time[inside], dart[inside]
    return time, dart


def signature(elements: np.ndarray, weights: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The earliest dart of each coordinate: two signatures agree in a coordinate with the probability
    of the weighted Jaccard similarity. Elements are distinct hashes with positive weights."""
    units = np.ceil(weights).astype(np.int64)
    element = np.repeat(np.arange(len(elements)), units)
    copy = np.arange(len(element)) - np.repeat(np.cumsum(units) - units, units)
    cells = mixed(elements[element] + copy.astype(np.uint64) * np.uint64(STEP))
    limits = np.minimum(1.0, weights[element] - copy)
    total = float(weights.sum())
    needed = size * (np.log(size) + 3.0) / total
    out = np.zeros(size, np.uint64)
    best = np.full(size, np.inf)
    first, last = 0, int(np.searchsorted(_slab(np.arange(_FINE))[0] + _slab(np.arange(_FINE))[1], needed)) + 1
    if needed > 1:
        last = _FINE + int(np.ceil(needed)) - 1
    while True:
        # Cells times slabs stay bounded: a long text has few slabs, a short one few cells.
        time, dart = _darts(cells, limits, first, last)
        if len(dart):
            place = (mixed(dart + np.uint64(1)) % np.uint64(size)).astype(np.uint16)
            order = np.argsort(place, kind="stable")
            place, time, dart = place[order], time[order], dart[order]
            begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            least = np.minimum.reduceat(time, begin)
            at = place[begin]
            hit = np.flatnonzero(time == np.repeat(least, np.diff(np.append(begin, len(place)))))
            winner = np.zeros(size, np.uint64)
            winner[place[hit]] = dart[hit]
            better = least < best[at]
            best[at[better]], out[at[better]] = least[better], winner[at[better]]
        if np.isfinite(best).all():
            return out
        first, last = last, last + max(1, (last - _FINE) // 2 if last > _FINE else 1)


def shingles(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct five-word shingles (one shorter one for fewer words) and how often each occurs."""
    hashes = window_hashes(word_hashes(words), min(SHINGLE, len(words)))
    found, counts = np.unique(hashes, return_counts=True)
    return found, counts.astype(np.float64)


def _cells(words: list[bytes]) -> bytes:
    """The text as a set of 40-bit hashes, one per shingle and copy, ascending and five bytes each."""
    found, counts = shingles(words)
    units = counts.astype(np.int64)
    copy = np.arange(int(units.sum())) - np.repeat(np.cumsum(units) - units, units)
    cells = np.unique(mixed(np.repeat(found, units) + copy.astype(np.uint64) * np.uint64(STEP)) >> np.uint64(24))
    return np.ascontiguousarray(cells.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _numbers(cells: bytes) -> np.ndarray:
    out = np.zeros((len(cells) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(cells, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def sketches(docs: DataFrame) -> DataFrame:
    """(id, content, bands) of each text: the hash of its words and of each band; no words, no content."""
    schema = pa.schema([("id", pa.int64()), ("content", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, bands, seen = [], [], {}
            for value in batch.column(1):
                words = folded_words(value.as_py())
                if not words:
                    contents.append(None)
                    bands.append(None)
                    continue
                content = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
                if content not in seen:
                    rows = signature(*shingles(words)).reshape(BANDS, ROWS)
                    total = np.arange(BANDS, dtype=np.uint64)
                    for i in range(ROWS):
                        total = mixed(total * np.uint64(STEP) + rows[:, i])
                    seen[content] = total.view(np.int64)
                contents.append(content)
                bands.append(seen[content])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(contents, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema
            )

    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(
        released(run), "id bigint, content binary, bands array<bigint>"
    )


def _cell_sets(docs: DataFrame) -> DataFrame:
    @F.pandas_udf("binary")
    def cells(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for texts in batches:
                for a, b in slices([len(t or b"") for t in texts], BYTES_AT_ONCE):
                    yield texts.iloc[a:b].map(lambda t: _cells(folded_words(t)))
        finally:
            release()

    return docs.select("id", cells(F.col("text").cast("binary")).alias("cells"))


def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b):
        x, y = _numbers(x), _numbers(y)
        common = len(np.intersect1d(x, y, assume_unique=True))
        out.append(common / max(1, len(x) + len(y) - common))
    return pd.Series(out, dtype="float64")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least ``least``, with it."""
    left = sets.select(F.col("id").alias("a"), F.col("cells").alias("__a"))
    right = sets.select(F.col("id").alias("b"), F.col("cells").alias("__b"))
    sizes = F.octet_length("__a"), F.octet_length("__b")
    both = pairs.join(left, "a").join(right, "b").where(
        F.least(*sizes) >= F.lit(least) * F.greatest(*sizes)
    )
    return both.select("a", "b", F.pandas_udf(_jaccard, "double")("__a", "__b").alias("similarity")).where(F.col("similarity") >= least)


def across_classes(sets: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different classes that may reach ``least``: none that does is missing.

    Two sets of sizes m and n that do have t = least / (1 + least) * (m + n) cells in common. With the cells
    of every set in one order, rarest first, their first common cell comes at places i and j (from 0) with
    min(m - i, n - j) >= t. So only the first places of each set are joined, and a cell that one class
    alone has there is not joined at all. Texts that lie just beyond ``least`` around a common origin have
    their own rare cells in these places, and so do not meet each other.
    """
    @F.pandas_udf("array<bigint>")
    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for cells in batches:
                for a, b in slices([len(c) for c in cells], BYTES_AT_ONCE):
                    yield cells.iloc[a:b].map(lambda c: _numbers(c).view(np.int64))
        finally:
            release()

    size = (F.octet_length("cells") / 5).cast("long")
    each = sets.join(classes, "id").select("id", "label", size.alias("size"), F.explode(numbers("cells")).alias("cell"))
    each = stage(each, "each")
    frequent = each.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = each.join(frequent, "cell")
    # Cells that no other set has are the rarest, so the shared ones come after all of them.
    order = Window.partitionBy("id").orderBy("n", "cell")
    placed = shared.withColumns({
        "__rank": F.row_number().over(order) - 1, "__of": F.count(F.lit(1)).over(Window.partitionBy("id")),
    }).withColumn("left", F.col("__of") - F.col("__rank")).where(F.col("left") >= F.col("size") * least - 1e-6)
    first = stage(placed.select("id", "label", "size", "cell", "left"), "first")
    mixed_ = first.groupBy("cell").agg(F.min("label").alias("__least"), F.max("label").alias("__most")).where(
        "__least <> __most"
    ).select("cell")
    one = first.join(mixed_, "cell")
    two = one.select("cell", *[F.col(c).alias(f"__{c}") for c in ("id", "label", "size", "left")])
    enough = F.least("left", "__left") >= (F.col("size") + F.col("__size")) * (least / (1 + least)) - 1e-6
    pairs = one.join(two, (one["cell"] == two["cell"]) & F.expr("id < __id and label <> __label") & enough)
    return pairs.select(F.col("id").alias("a"), F.col("__id").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every linked id: the smallest id that links lead to.

    Each round takes the smallest label among the neighbours, then the label of that label.
    """
    edges = settle(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("__b")).select(
        "id", F.least("id", "__b").alias("label")
    ))
    while True:
        near = edges.join(labels.withColumnsRenamed({"id": "b"}), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("label").alias("__near")
        )
        lower = labels.join(near, "id").select("id", F.col("label").alias("__old"), F.least("label", "__near").alias("__new"))
        jump = labels.select(F.col("id").alias("__new"), F.col("label").alias("__jump"))
        moved = settle(lower.join(jump, "__new", "left").select(
            "id", "__old", F.least("__new", F.coalesce("__jump", "__new")).alias("label")
        ))
        labels = moved.select("id", "label")
        if moved.where("label <> __old").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY,
) -> DataFrame:
    """One row per document: its id, and ``class_id``, the smallest id of its class.

    Documents are linked if the weighted Jaccard similarity of their five-word shingles (A-Z lowered,
    ASCII other than letters and digits taken as spaces, weight is the number of occurrences) is at least
    ``least``; classes are the connected components. Equal texts are one node from the start. A text of
    fewer than five words is one shingle; one without words, or null, is linked to nothing. Rows with
    words and equal ids are in one class; a null id gets a null class. Other columns are not read.

    Signatures choose whom to compare. In each bucket of a band all members are compared with one leader, the
    one that shares most buckets with others: the origin of a group of near copies, whatever its id.
    Members of buckets in which several classes remain are joined across classes by an exact prefix filter
    (see ``across_classes``), so no link is left out, and no pair within a class is looked at.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    seen = stage(sketches(rows.where(F.col("id").isNotNull())), "sketches")
    texts = seen.where("content is not null").groupBy("content").agg(
        F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")
    )
    buckets = stage(texts.select("rep", F.explode("bands").alias("key")), "bands")
    shared = settle(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    crowded = stage(lookup(buckets, shared, ["key"], "inner"), "buckets")
    # Who shares most buckets with others: the origin that near copies were made from, before any of them.
    central = crowded.groupBy("rep").agg(F.sum("n").alias("company"))
    crowded = stage(crowded.join(central, "rep").select("rep", "key", "company"), "crowded")

    nodes = crowded.select(F.col("rep").alias("id")).distinct()
    sets = stage(_cell_sets(lookup(rows, settle(nodes), ["id"], "inner")), "cells")

    # First every member of a bucket is compared with the bucket's leader.
    leaders = settle(crowded.groupBy("key").agg(F.max_by("rep", F.struct("company", -F.col("rep"))).alias("a")))
    led = lookup(crowded, leaders, ["key"], "inner").where("rep <> a")
    pairs = stage(led.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct(), "pairs")
    links = stage(verified(pairs, sets, least), "links")
    # Then whatever lies in a bucket with several classes is compared across classes.
    names = components(links).withColumnRenamed("id", "rep")
    labelled = stage(crowded.join(names, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labelled")
    mixed_ = settle(labelled.groupBy("key").agg(F.min("label").alias("__least"), F.max("label").alias("__most")).where(
        "__least <> __most"
    ).select("key"))
    unsettled = lookup(labelled, mixed_, ["key"], "left_semi").select(F.col("rep").alias("id"), "label").distinct()
    unsettled = stage(unsettled, "unsettled")
    across = stage(across_classes(sets, unsettled, least), "across")
    links = links.unionByName(stage(verified(across, sets, least), "links"))

    # Rows with one id but several texts join what these texts belong to.
    worded = seen.where("content is not null").select("id", "content")
    several = worded.groupBy("id").agg(F.count_distinct("content").alias("n")).where("n > 1").select("id")
    same = worded.join(several, "id").join(texts.select("content", "rep"), "content").where("id <> rep").select(
        F.col("rep").alias("a"), F.col("id").alias("b")
    )
    names = components(links.select("a", "b").unionByName(same))
    reps = texts.select("content", "rep").join(names.withColumnRenamed("id", "rep"), "rep", "left").select(
        "content", F.coalesce("label", "rep").alias("class_id")
    )
    # Texts without words have no content and stay as they are; a content of many copies is a heavy key.
    known = lookup(seen.select("id", "content"), stage(reps, "reps"), ["content"]).select(
        F.col("id").alias(doc_id), F.coalesce("class_id", "id").alias("class_id")
    )
    lost = rows.where("id is null").select(F.col("id").alias(doc_id), F.col("id").alias("class_id"))
    return known.unionByName(lost)
