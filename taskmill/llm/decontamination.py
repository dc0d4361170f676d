"""Benchmark decontamination as a prefix-filtered set join on word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from taskmill.llm.common import SECOND, mixed, released, slices, window_hashes, word_hashes
from taskmill.scale import settle, stage

WINDOW = 13
SHINGLE = 5
# Up to so many distinct shingles of the items are sent to every task as they are; of more a Bloom filter is
# sent, of sixteen bits a shingle up to this size. It lets some others through, which the joins drop.
EXACT_SHINGLES = 1 << 21
FILTER_BITS = 1 << 30
PROBES = 3
# Python works on about so many bytes of text at a time.
BYTES_AT_ONCE = 1 << 20

# Upper-case letters become lower-case, other ASCII characters that are no letter or digit a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)


def folded_words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def shingle_hashes(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the words i to i + size - 1, for every i; together they name a shingle."""
    hashes = word_hashes(words)
    return window_hashes(hashes, size), window_hashes(mixed(hashes ^ np.uint64(SECOND)), size, SECOND)


def _names(first: np.ndarray, second: np.ndarray) -> pa.Array:
    """Pairs of hashes as sixteen bytes each."""
    data = np.stack([first, second], axis=1).astype("<u8")
    offsets = np.arange(0, 16 * len(first) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Every item as (item, n, grams): its number of words and its shingles of five words in order.

    An item of fewer words is one shingle; an item without words is left out.
    """
    schema = pa.schema([("item", pa.string()), ("n", pa.int32()), ("grams", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, value in zip(batch.column(0), batch.column(1)):
                words = folded_words(value.as_py())
                if words:
                    grams = _names(*shingle_hashes(words, min(SHINGLE, len(words))))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([item.as_py()], pa.string()), pa.array([len(words)], pa.int32()),
                        pa.ListArray.from_arrays(pa.array([0, len(grams)], pa.int32()), grams),
                    ], schema=schema)

    return items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("binary").alias("text")) \
        .mapInArrow(released(run), "item string, n int, grams array<binary>")


@dataclass(frozen=True)
class ShingleFilter:
    """The shingles of the items by their first hash: all of them ascending, or bits of a Bloom filter."""

    sizes: tuple[int, ...]
    exact: np.ndarray | None
    bits: np.ndarray | None

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        if self.exact is not None:
            if not len(self.exact):
                return np.zeros(len(hashes), bool)
            place = np.minimum(np.searchsorted(self.exact, hashes), len(self.exact) - 1)
            return self.exact[place] == hashes
        found = np.ones(len(hashes), bool)
        for probe in range(PROBES):
            place = _place(hashes, probe, 64 * len(self.bits))
            found &= (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
        return found


def _place(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return mixed(hashes + np.uint64((probe + 1) * SECOND % 2**64)) & np.uint64(bits - 1)


def shingle_filter(known: DataFrame, exact_shingles: int = EXACT_SHINGLES, filter_bits: int = FILTER_BITS) -> ShingleFilter:
    """What tells whether a shingle may be one of the items, of bounded size however many there are."""
    sizes = tuple(sorted(r[0] for r in known.select(F.least("n", F.lit(SHINGLE))).distinct().collect()))
    grams = settle(known.select(F.explode("grams").alias("gram")).select(F.substring("gram", 1, 8).alias("hash")).distinct())
    n = grams.count()
    if n <= exact_shingles:
        found = b"".join(bytes(x) for x in grams.toArrow().column(0).to_pylist())
        return ShingleFilter(sizes, np.sort(np.frombuffer(found, "<u8").astype(np.uint64)), None)
    bits = 64
    while bits < min(16 * n, filter_bits):
        bits *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8").astype(np.uint64)
            place = np.concatenate([_place(hashes, probe, bits) for probe in range(PROBES)])
            word, bit = place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bit.view(np.int64))], names=["word", "bit"])

    words = grams.mapInArrow(released(places), "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return ShingleFilter(sizes, None, out)


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("row", F.monotonically_increasing_id())


def matching_shingles(rows: DataFrame, wanted: ShingleFilter) -> DataFrame:
    """Per (doc, text) its number of words and the places and names of shingles that pass the filter."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)
    schema = pa.schema([
        ("doc", to_arrow_type(rows.schema["doc"].dataType)), ("n_words", pa.int64()), ("pos", pa.list_(pa.int32())),
        ("gram", pa.list_(pa.binary())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for whole in batches:
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in whole.column(1)]
            for a, b in slices(sizes, BYTES_AT_ONCE):
                batch = whole.slice(a, b - a)
                counts, places, first, second, ends = [], [], [], [], [0]
                for value in batch.column(1):
                    words = folded_words(value.as_py())
                    found = 0
                    for size in wanted.sizes:
                        if len(words) < size:
                            continue
                        one, two = shingle_hashes(words, size)
                        at = np.flatnonzero(wanted.passes(one))
                        places.append(at)
                        first.append(one[at])
                        second.append(two[at])
                        found += len(at)
                    counts.append(len(words))
                    ends.append(ends[-1] + found)
                ends = pa.array(ends, pa.int32())
                none = [np.empty(0, np.uint64)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places or none).astype(np.int32))),
                    pa.ListArray.from_arrays(ends, _names(np.concatenate(first or none), np.concatenate(second or none))),
                ], schema=schema)

    doc_type = rows.schema["doc"].dataType.simpleString()
    return rows.select("doc", F.col("text").cast("binary")).mapInArrow(
        released(run), f"doc {doc_type}, n_words bigint, pos array<int>, gram array<binary>"
    )


def item_windows(items: DataFrame) -> DataFrame:
    """The distinct windows of every item: their length and the hashes of their shingles in order."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - WINDOW))
    size = F.least(F.col("n"), F.lit(WINDOW))
    width = size - F.least(F.col("n"), F.lit(SHINGLE)) + 1
    return items.select("item", size.alias("len"), "grams", width.alias("__w"), F.explode(starts).alias("start")) \
        .select("item", "len", F.slice("grams", F.col("start") + 1, F.col("__w")).alias("grams")).distinct()


def occurrences(staged: DataFrame, items: DataFrame) -> DataFrame:
    """Where item windows occur: (row, start, len, item), from the matching shingles of the documents.

    Exact containment needs every shingle of a window, so one prefix token, its rarest shingle in the
    corpus, is enough to find the candidates. The place of that token in the window gives the start; a
    candidate must lie inside the document and have, at their places, the shingles that cover the window.
    """
    hits = staged.select("row", "n_words", F.explode(F.arrays_zip("pos", "gram")).alias("h")).select(
        "row", "n_words", F.col("h.pos").alias("pos"), F.col("h.gram").alias("gram")
    )
    frequency = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    each = item_windows(items).select("item", "len", "grams", F.posexplode("grams").alias("off", "gram"))
    # Windows that cannot occur, having a shingle no document has, fall out of this join or of the cover.
    ranked = each.join(frequency, "gram")
    prefix = ranked.groupBy("item", "len", "grams").agg(
        F.min(F.struct("freq", "gram", "off")).alias("p"), F.count(F.lit(1)).alias("known")
    ).where(F.col("known") == F.size("grams")).select(
        "item", "len", "grams", F.col("p.gram").alias("gram"), F.col("p.off").alias("off")
    )
    # Equal windows of several items are looked for once.
    windows = settle(prefix.groupBy("len", "grams", "gram", "off").agg(F.collect_set("item").alias("items")))
    begin = F.col("pos") - F.col("off")
    candidates = hits.join(windows, "gram").where((begin >= 0) & (begin + F.col("len") <= F.col("n_words"))).select(
        "row", begin.alias("begin"), "len", "grams", "items"
    )
    cover = F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.ceil((F.size("grams") - 1) / SHINGLE).cast("int")),
        lambda i: F.least(i * SHINGLE, F.size("grams") - 1),
    ))
    wanted = candidates.select(
        "row", "begin", "len", "items", F.size(cover).alias("needed"), "grams", F.explode(cover).alias("j")
    ).select("row", "begin", "len", "items", "needed", (F.col("begin") + F.col("j")).alias("pos"),
             F.get("grams", F.col("j")).alias("gram"))
    verified = wanted.join(hits.select("row", "pos", "gram"), ["row", "pos", "gram"]).groupBy(
        "row", "begin", "len", "needed", "items"
    ).agg(F.count(F.lit(1)).alias("n")).where("n = needed")
    return verified.select("row", "begin", "len", "items")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    exact_shingles: int = EXACT_SHINGLES,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, items`` (sorted ids as strings) and the ``spans`` hit.

    Words are runs of letters and digits of ASCII, A-Z lowered, and all other characters. A window is 13
    consecutive words of an item, or a whole shorter item. Null and empty texts have no words and no
    hits; an empty benchmark hits nothing; repeated rows are judged each for itself; null item ids are
    ignored in ``items`` but their windows still hit. A very long text is one row and is read to its end.
    Other columns are not read, whatever their names.

    Texts are read once, however large the benchmark is. Shingles are told apart by 128 bits of two
    independent hashes of their words, and a window by all the shingles that cover it.
    """
    known = settle(item_shingles(items, item_id, item_text))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    # One pass over the texts. Rows get a number when they are written, so that rows with one id stay apart.
    staged = stage(_numbered(matching_shingles(rows, shingle_filter(known, exact_shingles, filter_bits))), "shingles")
    base, found = staged.select("row", "doc", "n_words"), occurrences(staged, known)

    by_start = Window.partitionBy("row").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.groupBy("row", "begin").agg(
        F.max("len").alias("len"), F.flatten(F.collect_list("items")).alias("items")
    ).withColumn("__upto", F.coalesce(F.max(F.col("begin") + F.col("len")).over(by_start), F.lit(0)))
    fresh = F.greatest(F.lit(0), F.col("begin") + F.col("len") - F.greatest("begin", "__upto"))
    hit = spans.groupBy("row").agg(
        F.sum(fresh).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.collect_list(F.struct("begin", "len"))).alias("spans"),
    )
    return base.select("row", F.col("doc").alias(doc_id), "n_words").join(hit, "row", "left").select(
        doc_id, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<begin:int,len:int>>")).alias("spans"),
    )


def contaminated(percent: int = 5):
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
